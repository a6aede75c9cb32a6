"""Operator 3: repeated passages, by compaction of a De Bruijn graph.

A window of k consecutive words is an edge of the graph. A first census finds
the windows whose hash occurs anywhere else, from 32 bits a window, sent in
bulk (see `census`). A second census, over these windows alone, has 64 bits of
another hash and, for each window, the words before and after it: it tells
which windows really repeat, which have one successor wherever they occur, and
which have one predecessor. Two adjoining windows belong to one nonbranching
path if the first has one successor and the second one predecessor, and then
they do so at every place: each document's repeated windows compact into a few
path occurrences (document, first word, length). Each is read again at its
source coordinates: a 128-bit BLAKE2 digest of the bytes of its words, one space
between them, verifies it. An occurrence whose words occur nowhere else, which
only a collision of the censuses' hashes can cause, is no repeat and stays; so
a collision (one in 2^64 for two windows) can leave a passage in the text, but
takes none away. What remains is cut from the texts at its source coordinates.

No task holds more than one chunk or one bucket; a passage that a third of all
documents share travels once for each chunk, and its occurrences meet in a
partial aggregation.

Cases: a null text has no words; a text of fewer than k words has no window and
keeps all; windows that overlap themselves in one text count as repeats; rows
with the same id and text are two documents; an empty table gives none; other
columns are left out.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import census
from .census import column, in_order
from .shared import released
from .wordhash import Words

SECOND = "bucket int, chunk int, hashes binary, after binary, before binary, many binary"
#: Marks beside a word's hash: no word there, or different words at different places.
_NONE, _MIXED = 1, 0
REPEATED, ONE_AFTER, ONE_BEFORE = 1, 2, 4


def _neighbours(words: Words, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of the word after and before each window."""
    w = np.maximum((words.hashes(1) >> np.uint64(32)).astype(np.uint32), 2)
    n = np.diff(offsets)
    at = np.repeat(words.first[:-1] - offsets[:-1], n) + np.arange(int(offsets[-1]))
    after, before = np.full(len(at), _NONE, np.uint32), np.full(len(at), _NONE, np.uint32)
    inner = np.ones(len(at), bool)
    inner[offsets[1:][n > 0] - 1] = False
    after[inner] = w[at[inner] + k]
    inner[:] = True
    inner[offsets[:-1][n > 0]] = False
    before[inner] = w[at[inner] - 1]
    return after, before


def _one(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For sorted groups that begin at ``starts``: their value if they have one alone, else ``_MIXED``."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    return np.where(low == high, low, _MIXED).astype(np.uint32)


class Chunk:
    """A chunk's documents and, as far as the answers are known, its windows."""

    def __init__(self, table: pa.Table, k: int):
        self.k, self.table = k, in_order(table)
        self.words = Words(column(self.table, "text"))

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, self.offsets = self.words.runs(self.k)
        distinct, self.inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        return distinct, counts

    def second(self, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the windows that may repeat: their places, and sorted by the other hash: the distinct ones, the words beside them, the counts."""
        self.first()
        self.at = np.flatnonzero(counts[self.inverse] > 1) if len(self.inverse) else np.zeros(0, np.int64)
        hashes = self.words.runs(self.k, 1)[0][self.at]
        after, before = _neighbours(self.words, self.offsets, self.k)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        number = np.zeros(len(ordered), np.int64)
        number[starts[1:]] = 1
        self.group = np.empty(len(ordered), np.int64)
        self.group[order] = np.cumsum(number)
        many = np.minimum(np.diff(np.concatenate([starts, [len(ordered)]])), 2).astype(np.uint8)
        return ordered[starts], _one(after[self.at][order], starts), _one(before[self.at][order], starts), many

    def paths(self, flags: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each occurrence of a path: ordinal of the document, first word, number of words, both halves of a digest of the words."""
        known = np.zeros(int(self.offsets[-1]), np.uint8)
        known[self.at] = flags[self.group]
        repeated = (known & REPEATED) > 0
        joined = np.zeros(len(known), bool)  # to the window before
        joined[1:] = repeated[1:] & repeated[:-1] & ((known[:-1] & ONE_AFTER) > 0) & ((known[1:] & ONE_BEFORE) > 0)
        firsts = self.offsets[:-1][np.diff(self.offsets) > 0]
        joined[firsts] = False
        starts = np.flatnonzero(repeated & ~joined)
        open_ = np.concatenate([joined[1:], [False]]) & repeated
        stops = np.flatnonzero(repeated & ~open_)
        doc = np.searchsorted(self.offsets, starts, side="right") - 1
        first = starts - self.offsets[doc]
        n = stops - starts + self.k
        return doc, first, n, *self._digests(self.words.first[doc] + first, n)

    def _digests(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        text, opens, closes = self.words.spaced()
        text = memoryview(text)
        spans = zip(opens[first].tolist(), closes[first + n - 1].tolist())
        digests = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in spans])
        return np.frombuffer(digests, "<i8").reshape(-1, 2).T


def _second_payload(chunk: int, parts: tuple[np.ndarray, ...], buckets: int) -> pa.Table:
    hashes, after, before, many = parts
    at = np.searchsorted(census.bucket_of(hashes, buckets), np.arange(buckets + 1)).tolist()
    rows = [(b, *(x[s:e].tobytes() for x in (hashes, after, before, many))) for b, (s, e) in enumerate(zip(at[:-1], at[1:])) if e > s]
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int32(), *[pa.binary()] * 4]
    b, h, x, y, m = (pa.array(c, kind) for c, kind in zip(cols, kinds))
    return pa.table({"bucket": b, "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": h, "after": x, "before": y, "many": m})


def _second_tally(table: pa.Table) -> pa.Table:
    whole = lambda name, kind: np.frombuffer(b"".join(column(table, name).to_pylist()), kind)
    hashes, after, before, many = whole("hashes", "<u8"), whole("after", "<u4"), whole("before", "<u4"), whole("many", np.uint8)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total = np.add.reduceat(many[order].astype(np.int64), starts)
    one = lambda v: _one(v[order], starts) > _NONE  # noqa: E731  a word, the same everywhere
    flags = (total > 1) * REPEATED + one(after) * ONE_AFTER + one(before) * ONE_BEFORE
    back = np.empty(len(hashes), np.uint8)
    back[order] = np.repeat(flags.astype(np.uint8), np.diff(np.concatenate([starts, [len(hashes)]])))
    cuts = np.concatenate([[0], np.cumsum([len(x) // 8 for x in column(table, "hashes").to_pylist()])]).tolist()
    return pa.table({"chunk": column(table, "chunk"), "bucket": column(table, "bucket"), "counts": pa.array([back[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})


def path_occurrences(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(chunk, ordinal, doc_id, start, n, content_a, content_b) of every occurrence of a nonbranching path of repeated windows."""
    first = census.replies(docs, buckets, lambda table: Chunk(table, k).first())

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, k)
        return _second_payload(column(left, "chunk")[0].as_py(), chunk.second(census.answers(right)), buckets)

    sent = docs.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(lambda left, right: released(send(left, right)), SECOND)
    second = sent.groupBy("bucket").applyInArrow(lambda table: released(_second_tally(table)), census.REPLY)
    both = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))

    def compact(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left, k)
        stage = column(right, "stage").to_numpy()
        chunk.second(census.answers(right.filter(pa.array(stage == 1))))
        doc, start, n, one, two = chunk.paths(census.answers(right.filter(pa.array(stage == 2))))
        ids = column(chunk.table, "doc_id").take(pa.array(doc))
        at = column(left, "chunk")[0].as_py()
        return pa.table({"chunk": np.full(len(doc), at, np.int32), "ordinal": doc.astype(np.int32), "doc_id": ids, "start": start, "n": n, "content_a": one, "content_b": two})

    schema = "chunk int, ordinal int, doc_id long, start long, n long, content_a long, content_b long"
    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(lambda left, right: released(compact(left, right)), schema)


def verified(occurrences: DataFrame) -> DataFrame:
    """The occurrences whose words are also those of another occurrence.

    Those that stand alone are found by counting contents (a partial aggregation, whatever the most frequent one) and
    leave by their coordinates, which are spread evenly."""
    at = ["chunk", "ordinal", "start"]
    counted = occurrences.groupBy("content_a", "content_b", "n").agg(F.count(F.lit(1)).alias("places"), *[F.min(c).alias(c) for c in at])
    return occurrences.join(counted.filter("places = 1").select(*at), at, "left_anti")


def remove_repeats(docs: DataFrame, k: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = census.CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words, joined by one space)."""
    dealt, buckets = census.chunked(docs, id_col, text_col, chunk_bytes)
    spans = verified(path_occurrences(dealt, k, buckets)).select("chunk", "ordinal", "start", "n")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        table = in_order(left)
        words = Words(column(table, "text"))
        change = np.zeros(len(words.starts) + 1, np.int64)
        at = words.first[column(right, "ordinal").to_numpy()] + column(right, "start").to_numpy()
        np.add.at(change, at, 1)
        np.add.at(change, at + column(right, "n").to_numpy(), -1)
        keep = np.cumsum(change[:-1]) == 0
        n = np.diff(words.first)
        left_over = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.first])
        return pa.table(
            {
                "doc_id": column(table, "doc_id"),
                "n_words": pa.array(n.astype(np.int64)),
                "n_removed": pa.array((n - left_over).astype(np.int64)),
                "kept": joined(words, keep),
            }
        )

    return dealt.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """For each text its kept words joined by one space, built by copying bytes."""
    starts, stops = words.starts[keep], words.stops[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    size = stops - starts + 1
    size[np.maximum(first[1:][np.diff(first) > 0] - 1, 0)] -= 1  # no space after a text's last word
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    length = stops - starts
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(ends[:-1], length) + at] = words.raw[np.repeat(starts, length) + at]
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(ends[first].astype(np.int32)), pa.py_buffer(out))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
