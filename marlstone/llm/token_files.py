"""Operator 7: token ids in Parquet files that can be read in part.

Documents go to range partitions by id and are sorted there, so that files and
rows stand in ascending order of ids. Each task encodes its texts with a table
of distinct words (a word here ends at a space, tab or line end, over which the
tokenizer cannot merge) and streams rows into the writer: memory follows a few
megabytes of text, not the partition.

File format: one Parquet row per document with ``doc_id``, ``part``, ``seq``
(place within the part), ``start_in_part``, ``n_tokens`` and ``ids``, a list of
int with the end id last. Row groups and pages have set sizes; ids are
dictionary-encoded, falling back to delta encoding (format version 2) where the
dictionary outgrows its page; the page index lets a reader with a range of
``doc_id`` skip pages, and one who wants only metadata never touches the ids.
The first token of a part in the whole sequence is the sum of the parts before
it, a table with one row per written part.

Cases: null counts as empty, and its row holds the end id alone; rows with equal
ids stand in the order of their texts, each with its own start; a null id comes
first; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chunk_table import ChunkTable, flattened
from .shared import by_bytes, id_text, offsets_of, released, texts_of

SCHEMA = "doc_id long, part int, seq long, start_in_part long, n_tokens long, ids array<int>"
#: Writer settings: bytes of a row group, of a data page and of a dictionary page, and rows of a page.
FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.writer.version": "PARQUET_2_0",
}
#: Words of letters that are encoded as one text, and texts that are encoded in one call.
JOINED, AT_ONCE = 100, 50
#: ASCII punctuation but the apostrophe, which opens contractions.
MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Words of ASCII letters and small Latin-1 letters: the tokenizer's normaliser and splitter leave them as they are.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Bytes of text in a part, and the least to which parts shrink so that every core has work.
PART_BYTES, LEAST_PART_BYTES = 128 << 20, 4 << 20
#: Distinct words that a task keeps.
TABLE_WORDS = 500_000
_loaded: dict[str, "Words"] = {}


class Words:
    """The tokenizer with a table of distinct words.

    The tokenizer splits at white space, and between a letter or digit and a run of punctuation marks that white
    space follows; it puts ASCII letters into lower case. Both are done before words are counted as distinct, and
    neither changes a token (texts that hold the opening of a special token are left as they are). Plain words go
    to the same model without normaliser and splitter, which have nothing to do on them.
    """

    def __init__(self, tokenizer_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.bare = Tokenizer.from_file(tokenizer_path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.table = ChunkTable(self._encode, TABLE_WORDS)

    def _each(self, words: list[str], bare: bool = False) -> list[list[int]]:
        """Ids of each of these; few at a time, as the library's results are large."""
        parts = (words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE))
        encode = (self.bare if bare else self.tokenizer).encode_batch_fast
        return [x.ids for part in parts for x in encode(part, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain words end in exactly one word-ending piece: they are encoded many at a time and told apart by it."""
        plain = np.fromiter((PLAIN(x) is not None for x in words), bool, len(words))
        ids: list[np.ndarray] = []
        lengths = np.zeros(len(words), np.int64)
        starts = np.zeros(len(words), np.int64)
        used = 0

        def put(at: np.ndarray, found: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal used
            lengths[at], starts[at] = sizes, used + np.cumsum(sizes) - sizes
            ids.append(found)
            used += len(found)

        at = np.flatnonzero(plain)
        groups = [at[i : i + JOINED] for i in range(0, len(at), JOINED)]
        for group, found in zip(groups, self._each([" ".join([words[i] for i in g.tolist()]) for g in groups], bare=True)):
            found = np.asarray(found, np.int32)
            stops = np.flatnonzero(self.ends_word[found]) + 1
            if len(stops) == len(group) and stops[-1] == len(found):
                put(group, found, np.diff(stops, prepend=0))
            else:
                put(group, *flattened(self._each([words[i] for i in group.tolist()])))
        at = np.flatnonzero(~plain)
        put(at, *flattened(self._each([words[i] for i in at.tolist()])))
        whole = np.concatenate(ids)
        order = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(whole))
        return whole[order], lengths

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the offsets of the texts."""
        spaced = texts
        for c in "\n\t\r":
            spaced = pc.replace_substring(spaced, c, " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            spaced = pc.replace_substring_regex(pc.ascii_lower(spaced), r"([\pL\pN])(" + MARKS + "+) ", r"\1 \2 ")
        lists = pc.split_pattern(spaced, " ")
        flat, offsets = lists.flatten(), offsets_of(lists)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.cumsum(full)])
        ids, ends, _ = self.table.join(flat.filter(pa.array(full)), kept[offsets - offsets[0]])
        n = len(texts)
        out = np.full(len(ids) + n, end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
        return out, ends + np.arange(n + 1)


def words(tokenizer_path: str) -> Words:
    if tokenizer_path not in _loaded:
        _loaded[tokenizer_path] = Words(tokenizer_path)
    return _loaded[tokenizer_path]


def part_count(rows: DataFrame) -> int:
    """Parts of ``PART_BYTES`` of text; smaller ones, as many as the session has shuffle partitions, if that is more."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(total / PART_BYTES), min(most, math.ceil(total / LEAST_PART_BYTES)))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode every text and write the files, in ``parts`` ranges of ids (default: by the bytes of all texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seq, start = words(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        for batch in by_bytes(batches, most=5 << 20):
            ids, ends = model.encode(texts_of(batch), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(seq + np.arange(n)),
                    pa.array(start + ends[:-1]),
                    pa.array(np.diff(ends)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                ],
                ["doc_id", "part", "seq", "start_in_part", "n_tokens", "ids"],
            )
            seq, start = seq + n, start + int(ends[-1])
        released()

    rows = id_text(docs, id_col, text_col)
    n = parts or part_count(rows)
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of written files with ``start``, the number of ids before them: doc_id, start, n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per written part: a count that the writer set, whatever the number of documents.
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(totals.select("part", before.alias("first")))
    return rows.join(firsts, "part").select("doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """The unsigned CRC-32 of each document's ids as little-endian unsigned 32-bit integers, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = offsets_of(lists)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(), "<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
