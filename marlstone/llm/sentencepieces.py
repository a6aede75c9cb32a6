"""Operator 8: SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from text into a white-space mark (checked when
the model loads), and the line feed is no part of any longer piece. A text so
falls into chunks, a run of marks with the characters after it, or one line
feed, that BPE segments independently: no merge can join two of them. Each
distinct chunk of a batch is segmented once, by the library, and the ids are
joined back by position. Decoding goes the same way: each distinct chunk is
decoded once, and texts are concatenated.

A whole shuffle of words into one global table would move a multiple of the
input; a table kept by each task moves nothing and needs no more memory than
its fixed number of chunks.

Cases: null counts as empty; an empty text gets the end id alone and decodes to
the empty text; texts of any length are taken in slices of a batch by bytes;
repeated rows and equal ids give equal rows; an empty table gives none; other
columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunk_table import ChunkTable, flattened
from .shared import by_bytes, id_text, offsets_of, released, texts_of

MARK = "▁"
#: Chunks of a text whose spaces are marks: marks with what follows them, a line feed, what follows a line feed.
CHUNK_RE = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")
_CUT = "\x01"
#: Chunks that go to the library in one call.
AT_ONCE = 10_000
_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """The model and, for encoding, a table of distinct chunks."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if MARK in piece.lstrip(MARK) or "\n" in piece:
                raise ValueError(f"piece {i} crosses a white-space mark or a line feed: chunks are not independent")
        self.lead = m.encode("\n")
        self.end_id = m.eos_id()
        self.table = ChunkTable(self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each chunk; what they decode to is noted beside them. A line feed before the chunk takes the mark that
        the library puts first, and the one that it takes away."""
        skip = len(self.lead)
        found = []
        for at in range(0, len(chunks), AT_ONCE):
            ids = self.model.encode(["\n" + c for c in chunks[at : at + AT_ONCE]], num_threads=1)
            self.table.notes += [t[1:] for t in self.model.decode(ids)]
            found += [x[skip:] for x in ids]
        return flattened(found)

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks in order and the offsets of each text's."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, _CUT)))
        plain = pc.if_else(odd, "", texts)
        marked = pc.replace_substring(pc.replace_substring(plain, " ", _CUT + MARK), "\n", f"{_CUT}\n{_CUT}")
        lists = pc.split_pattern(pc.if_else(pc.equal(plain, ""), "", pc.binary_join_element_wise(MARK, marked, "")), _CUT)
        flat, offsets = lists.flatten(), offsets_of(lists)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        flat, offsets = flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(odd_rows):
            return flat, offsets
        # Runs of spaces, marks in the text and the cutting character itself: cut by the pattern, then put in place.
        cut = [CHUNK_RE.findall(MARK + texts[int(i)].as_py().replace(" ", MARK)) for i in odd_rows]
        sizes, starts = np.diff(offsets), offsets[:-1].copy()
        sizes[odd_rows] = [len(x) for x in cut]
        starts[odd_rows] = len(flat) + np.cumsum(sizes[odd_rows]) - sizes[odd_rows]
        ends = np.cumsum(sizes)
        both = pa.concat_arrays([flat, pa.array([c for x in cut for c in x], pa.string())])
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return both.take(pa.array(at)), np.concatenate([[0], ends])

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Ids (with the end id) and the text that they decode to."""
        flat, offsets = self.chunks(texts)
        ids, ends, decoded = self.table.join(flat, offsets)
        n = len(texts)
        out = np.full(len(ids) + n, self.end_id, np.int32)
        sizes = np.diff(ends)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), sizes)] = ids
        lists = pa.ListArray.from_arrays(pa.array(ends + np.arange(n + 1), pa.int32()), pa.array(out))
        return lists, self.joined(decoded, offsets)

    @staticmethod
    def joined(decoded: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Texts from their chunks' texts, by position; the first mark of a text is the library's own and goes."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), decoded), "")
        return pc.if_else(pc.starts_with(whole, " "), pc.utf8_slice_codeunits(whole, 1), whole)


def pieces(model_path: str) -> Pieces:
    if model_path not in _loaded:
        _loaded[model_path] = Pieces(model_path)
    return _loaded[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (an array of int ending in the end id), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in by_bytes(batches, most=2 << 20):
            ids, decoded = model.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])
        model.table.clear()
        released()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, the SHA-256 of the decimal ids joined by one space, and that of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
