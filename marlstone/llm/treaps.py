"""Operator 12: ranked lexical search in inverted treaps.

Documents stand in shards of bounded size, in ascending order of ids. The list of
a term in a shard is a treap: a search tree by document that is also a heap by
impact, the part of a score that its count and the document's length make, so that
the root of any subtree holds the largest impact of a range of documents. It is
stored as the documents, their impacts, and for each the step to its parent.

A search goes through all treaps of an item's terms at once. A range of documents
carries, for each term, the topmost node that lies in it; the weighted sum of their
impacts bounds every score in the range, and a range whose bound cannot enter the
best k is dropped with its subtrees. Else the document of the node that counts most
is scored, and the range falls into what is before and what is after it. Ranges of
few documents are scored as a whole. This goes level by level for many items at once,
in arrays; the best k go with the task from shard to shard, so bounds get sharper.

An index is written once. It holds all terms of all documents; the number of
documents and of terms, on which impacts depend, are counted before. Items come in
blocks of bounded bytes; a block takes the lists of its terms, and the weights of
its terms are summed from their lengths. Each task returns its best k of each item.

Cases: null and empty texts, and texts without a term, are no documents; rows with
equal ids are documents of their own, and those with null ids come last among equal
scores; an item without terms, or without a hit, has no row; equal rows of items
count once, and an id with several texts has a list for each; empty tables give no
row; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import by_bytes, bytes_of, id_text, new_path, offsets_of, released, texts_of

#: A term: letters and digits of ASCII, and everything beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text and documents of a shard; documents of a range that is scored as a whole.
SHARD_BYTES, SHARD_DOCS, LEAF = 16 << 20, 1 << 14, 64
#: Bytes of a block of items, and nodes that the ranges of one call hold together.
BLOCK_BYTES, NODES = 2 << 20, 1 << 20
#: Results of an item.
TOP = 20

# Fixed values of the score: parts of a thousand.
SCALE, SATURATION, FLAT, LENGTHS = 1000, 12, 75, 25

#: Bytes as terms have them: capital letters small, what is in no term a space.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ROWS = "shard long, term string, count int, docs binary, impacts binary, up binary, ids array<long>"


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``n`` terms count, if ``docs`` documents have ``total`` terms."""
    m = FLAT + LENGTHS * n * docs // total
    return 1_000_000_000 * tf // (SCALE * tf + SATURATION * m)


def parents(priority: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The parent of each node in the treap of its run (``start`` to ``stop``), -1 for a root; of equal priorities the first is
    above. A node hangs from the lower of the nearest nodes above it on both sides, which are found by jumps: what lies
    between a node and where it points so far is below it, so it may point on to where that one points."""
    n = len(priority)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    at = np.flatnonzero(before >= start)
    while len(at := at[priority[before[at]] < priority[at]]):
        before[at] = before[before[at]]
        at = at[before[at] >= start[at]]
    at = np.flatnonzero(after < stop)
    while len(at := at[priority[after[at]] <= priority[at]]):
        after[at] = after[after[at]]
        at = at[after[at] < stop[at]]
    left, right = before >= start, after < stop
    up = np.where(left, before, np.where(right, after, -1))
    both = np.flatnonzero(left & right)
    lower = priority[before[both]] < priority[after[both]]
    up[both] = np.where(lower, before[both], after[both])
    return up


class Writer:
    """Collects the documents of one shard."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total = docs, total
        self.number: dict[str, int] = {}
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []
        self.rows = self.bytes = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        raw, ends = bytes_of(texts)
        spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_BYTES[raw]))
        lists = pc.split_pattern(spaced, " ")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slot = np.fromiter((self.number.setdefault(t, len(self.number)) if t else -1 for t in distinct), np.int64, len(distinct))
        term = slot[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets_of(lists)))
        doc, term = doc[term >= 0], term[term >= 0]
        lengths = np.bincount(doc, minlength=len(texts))
        full = np.flatnonzero(lengths)
        place = np.cumsum(lengths > 0) - 1 + self.rows
        keys, tf = np.unique(place[doc] << 32 | term, return_counts=True)
        self.parts.append((keys >> 32, keys & 0xFFFFFFFF, tf))
        self.ids.append(ids.take(pa.array(full)))
        self.lengths.append(lengths[full])
        self.rows += len(full)
        self.bytes += len(raw)

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, lengths = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        doc, term, tf = (np.concatenate(x) for x in zip(*self.parts))
        order = pc.array_sort_indices(ids).to_numpy()  # nulls last
        rank = np.empty(self.rows, np.int64)
        rank[order] = np.arange(self.rows)
        impact = impacts(tf, lengths[doc], self.docs, self.total)
        by = np.argsort(term << 32 | rank[doc], kind="stable")
        doc, term, impact = rank[doc][by], term[by], impact[by]
        first = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1])
        sizes = np.diff(first, append=len(term))
        up = parents(impact, np.repeat(first, sizes), np.repeat(first + sizes, sizes))
        step = np.where(up < 0, 0, up - np.arange(len(up)))
        names = np.array(list(self.number), object)
        cuts = pa.array(np.append(first, len(term)) * 4, pa.int32())
        binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, cuts.buffers()[1], pa.py_buffer(x.astype("<i4").tobytes())])
        columns = [pa.array(names[term[first]], pa.string()), pa.array(sizes.astype(np.int32)), binary(doc), binary(impact), binary(step)]
        schema = ["shard", "term", "count", "docs", "impacts", "up", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard)), *columns, pa.nulls(len(first), pa.list_(pa.int64()))], schema)
        empty = [pa.nulls(1, kind) for kind in (pa.binary(),) * 3]
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([self.rows], pa.int32()), *empty, own], schema)


class Index:
    """A written index: the folder, the number of documents with a term, and of their terms."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.schema(ROWS).parquet(f"{path}/lists")
        self.docs, self.total = spark.read.schema("docs long, total long").parquet(f"{path}/totals").first()


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """Write the index of all documents to ``path``."""
    rows = id_text(docs, id_col, text_col)
    terms = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TERM))
    totals = rows.select(terms.cast("long").alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    totals.coalesce(1).write.parquet(f"{path}/totals")
    known, total = rows.sparkSession.read.parquet(f"{path}/totals").first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer = TaskContext.get().partitionId() << 32, Writer(known, total)
        for batch in by_bytes(batches):
            for at in range(0, batch.num_rows, shard_docs):
                part = batch.slice(at, shard_docs)
                if writer.rows and (writer.rows + part.num_rows > shard_docs or writer.bytes >= shard_bytes):
                    yield from writer.batches(shard)
                    shard, writer = shard + 1, Writer(known, total)
                writer.add(part.column("doc_id"), texts_of(part))
        yield from writer.batches(shard)
        released()

    rows.mapInArrow(run, ROWS).write.option("compression", "zstd").parquet(f"{path}/lists")
    return Index(rows.sparkSession, path)


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_FOLD) for t in re.findall(TERM, text or "")]


class Questions:
    """A block of items with weighted terms: those of item q stand from ``first[q]`` to ``first[q + 1]``."""

    def __init__(self, items: list[tuple[int | None, Counter]]):
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, c in items for t in c})
        number = {t: i for i, t in enumerate(self.terms)}
        self.term = np.array([number[t] for _, c in items for t in c], np.int64)
        self.times = np.array([k for _, c in items for k in c.values()], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(c) for _, c in items])]).astype(np.int64)
        self.weight = np.zeros(len(self.term), np.int64)

    def weigh(self, docs: int, df: dict[str, int]) -> None:
        w = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in self.terms], np.int64)
        self.weight = w[self.term] * self.times if len(self.terms) else self.weight


class Best:
    """The best k of each item so far: (item, score, id), ids null where ``missing``."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        good = score >= self.least[item]
        new = [np.concatenate([old, x[good]]) for old, x in zip(self.columns, (item, score, ids, missing))]
        by = np.lexsort((new[2], new[3], -new[1], new[0]))
        item = new[0][by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        self.columns = [x[by][place < self.top] for x in new]
        last = place == self.top - 1
        self.least[item[last]] = new[1][by][last]


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by place: halves of them are exact in floating point."""
    low = np.bincount(at, weights=values & 0xFFFFFF, minlength=n).astype(np.int64)
    return low + (np.bincount(at, weights=values >> 24, minlength=n).astype(np.int64) << 24)


class Shard:
    """The treaps of a shard's terms, one after another."""

    def __init__(self, terms: list[int], docs: list[bytes], impact: list[bytes], up: list[bytes], ids: pa.Array):
        whole = lambda x: np.frombuffer(b"".join(x), "<i4").astype(np.int64)
        self.doc, self.impact, step = whole(docs), whole(impact), whole(up)
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        sizes = np.array([len(x) // 4 for x in docs], np.int64)
        self.run = np.repeat(np.arange(len(sizes)), sizes)
        self.key = self.run * len(self.ids) + self.doc
        self.term = np.array(terms, np.int64)
        nodes = np.arange(len(step))
        self.roots = nodes[step == 0]
        self.left, self.right = np.full(len(step), -1), np.full(len(step), -1)
        after = nodes[step < 0]
        self.right[after + step[after]] = after
        before = nodes[step > 0]
        self.left[before + step[before]] = before
        self.scored = 0

    def topmost(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The topmost node at or below each that lies in documents ``low`` to ``high``, -1 if none does."""
        node = node.copy()
        at = np.arange(len(node))
        while len(at):
            here = node[at]
            doc = self.doc[here]
            under, over = doc < low[at], doc >= high[at]
            node[at] = np.where(under, self.right[here], np.where(over, self.left[here], here))
            at = at[(under | over) & (node[at] >= 0)]
        return node

    def search(self, asked: Questions, best: Best) -> None:
        root = np.full(len(asked.terms), -1)
        root[self.term] = self.roots
        step = max(1, NODES * LEAF // (2 * max(len(self.ids), LEAF)))
        q = 0
        while q < len(asked.ids):  # so many items that their ranges' nodes are bounded
            last = max(q + 1, int(np.searchsorted(asked.first, asked.first[q] + step, side="right")) - 1)
            at = np.arange(asked.first[q], asked.first[last])
            item = np.repeat(np.arange(q, last), np.diff(asked.first[q : last + 1]))
            known = (root[asked.term[at]] >= 0) & (asked.weight[at] > 0)
            items, item = np.unique(item[known], return_inverse=True)
            if len(items):
                self._descend(items, np.zeros(len(items), np.int64), np.full(len(items), len(self.ids)), item, root[asked.term[at[known]]], asked.weight[at[known]], best)
            q = last

    def _descend(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, node: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Ranges of documents for items, and (of, node, weight): the topmost nodes in each range, in the order of ranges."""
        while len(item):
            value = self.impact[node] * weight
            first = np.searchsorted(of, np.arange(len(item)))
            bound = np.add.reduceat(value, first)
            alive = bound >= best.least[item]
            whole = alive & (high - low <= LEAF)
            if whole.any():
                self._score(item, low, high, of, node, weight, whole, best)
            split = np.flatnonzero(alive & ~whole)
            mine = (alive & ~whole)[of]
            number = np.cumsum(alive & ~whole) - 1
            of, node, weight, value = number[of[mine]], node[mine], weight[mine], value[mine]
            item, low, high = item[split], low[split], high[split]
            if not len(item):
                return
            first = np.searchsorted(of, np.arange(len(item)))
            top = value == np.maximum.reduceat(value, first)[of]
            chosen = np.full(len(item), np.iinfo(np.int64).max)
            np.minimum.at(chosen, of[top], self.doc[node[top]])
            # The document of the largest part is scored; what is before and after it goes on.
            at = np.searchsorted(self.key, key := self.run[node] * len(self.ids) + chosen[of])
            hit = self.key[np.minimum(at, len(self.key) - 1)] == key
            score = sums(of[hit], self.impact[at[hit]] * weight[hit], len(item))
            best.add(item, score, self.ids[chosen], self.missing[chosen])
            self.scored += len(item)
            before, after = self.topmost(node, low[of], chosen[of]), self.topmost(node, chosen[of] + 1, high[of])
            of = np.concatenate([2 * of, 2 * of + 1])
            node, weight = np.concatenate([before, after]), np.concatenate([weight, weight])
            kept = node >= 0
            by = np.argsort(of[kept], kind="stable")
            of, node, weight = of[kept][by], node[kept][by], weight[kept][by]
            ranges, of = np.unique(of, return_inverse=True)
            low, high = np.where(ranges % 2 == 0, low[ranges // 2], chosen[ranges // 2] + 1), np.where(ranges % 2 == 0, chosen[ranges // 2], high[ranges // 2])
            item = item[ranges // 2]

    def _score(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, of: np.ndarray, node: np.ndarray, weight: np.ndarray, whole: np.ndarray, best: Best) -> None:
        """Score every document of these ranges."""
        mine = whole[of]
        of, run, weight = of[mine], self.run[node[mine]], weight[mine]
        start = np.searchsorted(self.key, run * len(self.ids) + low[of])
        size = np.searchsorted(self.key, run * len(self.ids) + high[of]) - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(of * LEAF - low[of], size) + self.doc[at]
        scores = sums(cell, self.impact[at] * np.repeat(weight, size), len(item) * LEAF)
        found = np.flatnonzero(scores)
        own, doc = found // LEAF, found % LEAF + low[found // LEAF]
        best.add(item[own], scores[found], self.ids[doc], self.missing[doc])
        self.scored += len(found)


def _searched(asked: Questions, top: int):
    number = {t: i for i, t in enumerate(asked.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(asked.ids), top)
        shard, rows, ids = None, [], None

        def finish() -> None:
            if rows and ids is not None:
                Shard(*map(list, zip(*rows)), ids).search(asked, best)

        for batch in batches:
            for here, term, docs, impact, up, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "docs", "impacts", "up")), batch.column("ids")):
                if here != shard:
                    finish()
                    shard, rows, ids = here, [], None
                if term is None:
                    ids = own.values
                else:
                    rows.append((number[term], docs, impact, up))
        finish()
        item, score, doc, missing = best.columns
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=missing), pa.array(score)], ["item", "doc_id", "score"])
        released()

    return run


def search(index: Index, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by id."""
    spark = items.sparkSession
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.least(F.octet_length("text") + 16, F.lit(block_bytes)))).first()[0] or 0  # a longer item fills one
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Questions([(i, c) for i, t in part.collect() if (c := Counter(terms_of(t)))])
        words = F.broadcast(spark.createDataFrame([(t, True) for t in block.terms], "term string, asked boolean"))
        lengths = index.rows.select("term", "count").join(words, "term").groupBy("term").agg(F.sum("count").alias("df"))
        block.weigh(index.docs, {r.term: r.df for r in lengths.collect()})  # a row for each term of the block
        lists = index.rows.join(words, "term", "left").filter("asked OR term IS NULL").select("shard", "term", "docs", "impacts", "up", "ids")
        hits = lists.repartition("shard").sortWithinPartitions("shard").mapInArrow(_searched(block, top), "item int, doc_id long, score long")
        named = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long"))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = hits.withColumn("rank", rank).filter(F.col("rank") <= top).join(named, "item").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index the documents in the shared folder and search it for all items."""
    return search(build(docs, new_path(docs.sparkSession, "treaps")), items, top)
