"""A stored BM25 index: lists of documents by term, kept up to date by signed changes.

Rows are (bucket, term, chunk): the documents of a chunk of ids that have a term, each as the step from the one before
in 16 bits, with how often they have it and how long they are; and for each slice of ``SLICE`` ids the largest count and
the least length in it, which bound what the term can add to a score there whatever the statistics of the day. Folders
by bucket let a search read no more than its terms' buckets.

A change is written as signed rows: a text that goes with -1, one that comes with +1. The number of documents, their
total length and each term's documents are sums over signs, and so are scores, in which what came and went cancels. No
row is read to be written again; ``compacted`` writes an index anew from its own rows.

A search adds up, for each query and slice, the largest of its terms, scores the most promising slices, and then those
others whose bound still reaches the query's worst kept result. Bounds go with a task from chunk to chunk.

Cases: a null text has no words and counts as a document; rows with a null id are left out, as a result could not name
them; ids must be distinct among what is live (``add`` of an id that is there counts twice).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.ranking import DIGITS, ranked
from .lexical import _RARE, _TOKEN, B, K1, once, token_lengths

#: Ids of a chunk and of a slice, folders of terms, and tasks that write a folder at most.
CHUNK, SLICE, BUCKETS, SHARES = 1 << 14, 128, 16, 8
#: Slices that are scored before bounds decide, and bytes of a block of queries.
EAGER, BLOCK_BYTES = 4, 1 << 20
#: Scores of a task's matrix at a time.
CELLS = 1 << 22

ROW = ["term", "chunk", "sign", "n", "docs", "counts", "lengths", "slices", "most", "least"]
LISTS = "bucket int, term string, chunk long, sign int, n int, docs binary, counts binary, lengths binary, slices binary, most binary, least binary"
TOTALS = "documents long, tokens long"


def batch_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(text, term) of every token of a batch, the batch's distinct terms, and the number of tokens of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    # Texts with characters that are cut into bigrams, or that only a full lower-casing makes Latin, go one by one.
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, np.flatnonzero(_RARE[raw]), side="right") - 1] = True
    some = np.flatnonzero(odd)
    odd[some] = pc.match_substring_regex(texts.take(pa.array(some)), f"[İK{tx.CJK}]").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(_TOKEN[raw])), " ")
    coded = lists.values.dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    kept = ~odd[text]
    if "" in names:
        kept &= number != names.index("")
    text, number = text[kept], number[kept]
    if odd.any():
        slot = {t: i for i, t in enumerate(names)}
        own = [(d, slot.setdefault(t, len(slot))) for d in np.flatnonzero(odd).tolist() for t in tx.split_tokens(texts[d].as_py())]
        names = list(slot)
        more = np.array(own, np.int64).reshape(-1, 2)
        text, number = np.concatenate([text, more[:, 0]]), np.concatenate([number, more[:, 1]])
    return text, number, names, np.bincount(text, minlength=len(texts))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and tokens of each batch by sign."""
    for batch in batches:
        sign = batch.column("sign").to_numpy().astype(np.int64)
        tokens = int((sign * token_lengths(batch.column("text"))).sum())
        yield pa.RecordBatch.from_arrays([pa.array([int(sign.sum())]), pa.array([tokens])], ["documents", "tokens"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index, from documents that come by chunk and id: those of a chunk may come in several batches, whose
    lists stand in rows of their own."""
    for whole in batches:
        chunks = whole.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(whole.column("sign").to_numpy()) != 0)) + 1).tolist(), whole.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            batch = whole.slice(a, b - a)
            text, number, names, lengths = batch_tokens(batch.column("text"))
            ids = batch.column("doc_id").to_numpy() - chunks[a] * CHUNK
            keys, counts = np.unique((number * CHUNK + ids[text]), return_counts=True)
            if not len(keys):
                continue
            term, doc = np.divmod(keys, CHUNK)
            place = np.empty(CHUNK, np.int64)
            place[ids] = lengths
            first, packed = _packed(term, doc, counts, place[doc])
            own = [pa.array([names[t] for t in term[first].tolist()], pa.string()), pa.array(np.full(len(first), chunks[a])), pa.array(np.full(len(first), batch.column("sign")[0].as_py(), np.int32))]
            yield pa.RecordBatch.from_arrays(own + packed, ROW)


def _packed(own: np.ndarray, doc: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each list begins, and its columns from ``n`` on, from documents that come by list and place in its chunk."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
    steps = np.diff(doc, prepend=0)
    steps[first] = doc[first]
    part = own * (CHUNK // SLICE) + doc // SLICE
    head = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
    at, of = np.append(first, len(own)), np.searchsorted(head, np.append(first, len(part)))

    def binary(values: np.ndarray, kind: str, at: np.ndarray) -> pa.Array:
        raw = values.astype(kind)
        offsets = pa.array((at * raw.itemsize).astype(np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, offsets.buffers()[1], pa.py_buffer(raw.tobytes())])

    return first, [
        pa.array(np.diff(at).astype(np.int32)),
        binary(steps, "<u2", at),
        binary(counts, "<i4", at),
        binary(lengths, "<i4", at),
        binary(part[head] % (CHUNK // SLICE), "<u1", of),
        binary(np.maximum.reduceat(counts, head), "<i4", of),
        binary(np.minimum.reduceat(lengths, head), "<i4", of),
    ]


def _bucket(buckets: int):
    return F.pmod(F.hash("term"), F.lit(buckets)).cast("int")


def add(changes: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write changes (doc_id, text, sign) as a part of the index in ``folder``; the first part makes the index. What goes
    needs the text that it came with."""
    spark = changes.sparkSession
    rows = changes.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("sign").cast("int").alias("sign"))
    part = uuid.uuid4().hex
    each = rows.select("sign", "text").mapInArrow(_summed, TOTALS)
    sums = each.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "tokens")])
    dealt = rows.withColumn("chunk", F.shiftright("doc_id", CHUNK.bit_length() - 1)).repartition("chunk").sortWithinPartitions("chunk", "sign", "doc_id")
    lists = dealt.select("chunk", "sign", "doc_id", "text").mapInArrow(_listed, LISTS.removeprefix("bucket int, "))
    _write(_dealt(lists, buckets), folder, part)
    sums.coalesce(1).write.parquet(f"{folder}/totals/part={part}")  # a part is there once its totals are


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket, term and chunk; a bucket's terms go to several tasks, a term to one."""
    share = F.pmod(F.xxhash64("term"), F.lit(SHARES))
    return rows.withColumn("bucket", _bucket(buckets)).repartition("bucket", share).sortWithinPartitions("bucket", "term", "chunk")


def _write(dealt: DataFrame, folder: str, part: str) -> None:
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/lists/part={part}")


def build(corpus: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    add(corpus.select("doc_id", "text", F.lit(1).alias("sign")), folder, buckets)


def changed(before: DataFrame, after: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Replace documents: ``before`` has those that go as they were indexed, ``after`` those that come (doc_id, text)."""
    sides = [df.select("doc_id", "text", F.lit(sign).alias("sign")) for df, sign in ((before, -1), (after, 1))]
    add(sides[0].unionByName(sides[1]), folder, buckets)


def lists(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of the index's parts: of those alone whose totals are written."""
    whole = [r.part for r in spark.read.schema(f"{TOTALS}, part string").parquet(f"{folder}/totals").select("part").distinct().collect()]
    return spark.read.schema(f"{LISTS}, part string").parquet(f"{folder}/lists").filter(F.col("part").isin(whole)).drop("part")


def totals(spark: SparkSession, folder: str) -> tuple[int, int]:
    found = spark.read.schema(TOTALS).parquet(f"{folder}/totals").agg(F.sum("documents"), F.sum("tokens")).first()
    return int(found[0] or 0), int(found[1] or 0)


class Block:
    """Queries with the weights of their terms: those of query q stand from ``first[q]`` to ``first[q + 1]``."""

    def __init__(self, queries: list[tuple[int, list[str]]], top: int):
        self.top = top
        self.ids = np.array([q for q, _ in queries], np.int64)
        self.names = sorted({t for _, terms in queries for t in terms})
        number = {t: i for i, t in enumerate(self.names)}
        self.term = np.array([number[t] for _, terms in queries for t in terms], np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(terms) for _, terms in queries])]).astype(np.int64)
        self.idf = np.zeros(len(self.names))
        self.mean = 0.0

    def weigh(self, documents: int, tokens: int, df: dict[str, int]) -> None:
        each = np.array([df.get(t, 0) for t in self.names], np.float64)
        self.idf = np.where(each > 0, np.log(1 + (documents - each + 0.5) / (each + 0.5)), 0.0)
        self.mean = tokens / documents if documents else 0.0

    def part(self, term: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        ratio = length / self.mean if self.mean else np.ones(len(length))
        return self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * ratio))


class Kept:
    """The best of each query so far, and the least score that can still enter."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.query, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(queries, 10.0**-DIGITS / 2)

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        score = np.round(score, DIGITS)
        good = (score >= self.least[query]) & (score > 0)
        query, score, doc = (np.concatenate(x) for x in ((self.query, query[good]), (self.score, score[good]), (self.doc, doc[good])))
        by = np.lexsort((doc, -score, query))
        query = query[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score, self.doc = query[place < self.top], score[by][place < self.top], doc[by][place < self.top]
        last = place == self.top - 1
        self.least[query[last]] = score[by][last]


class Chunk:
    """The lists of one chunk for the terms of a block."""

    def __init__(self, chunk: int, rows: list[tuple], block: Block):
        self.base, self.block = chunk * CHUNK, block
        term, sign, docs, counts, lengths, slices, most, least = zip(*rows)
        whole = lambda x, kind: np.frombuffer(b"".join(x), kind).astype(np.int64)
        sizes = np.array([len(x) // 2 for x in docs])
        steps = whole(docs, "<u2")
        run = np.cumsum(steps)
        first = np.cumsum(sizes) - sizes
        doc = run - np.repeat(run[first] - steps[first], sizes)
        own = np.repeat(np.array(term), sizes)
        by = np.argsort(own * CHUNK + doc, kind="stable")
        self.key, self.sign = (own * CHUNK + doc)[by], np.repeat(np.array(sign), sizes)[by]
        self.value = block.part(own, whole(counts, "<i4"), whole(lengths, "<i4"))[by] * self.sign
        # The largest part of each term in each slice; only what came counts.
        number = np.array([len(x) for x in slices])
        bound = block.part(np.repeat(np.array(term), number), whole(most, "<i4"), whole(least, "<i4"))
        bound[np.repeat(np.array(sign), number) < 0] = 0
        self.bound = np.zeros((len(block.names), CHUNK // SLICE))
        np.maximum.at(self.bound, (np.repeat(np.array(term), number), whole(slices, "<u1")), bound)

    def search(self, kept: Kept) -> int:
        """Put the chunk's documents into ``kept``; how many slices were scored."""
        block, scored = self.block, 0
        step = max(1, CELLS // (CHUNK // SLICE * 64))
        for a in range(0, len(block.ids), step):
            b = min(a + step, len(block.ids))
            own = np.arange(block.first[a], block.first[b])
            each = np.diff(block.first[a : b + 1])
            reach = np.zeros((b - a, CHUNK // SLICE))
            full = np.flatnonzero(each)
            if not len(full):
                continue
            starts = (block.first[a:b] - block.first[a])[full]
            reach[full] = np.add.reduceat(self.bound[block.term[own]], starts, axis=0)
            reach += 2 * 10.0**-DIGITS  # more than rounding and the order of sums can add
            reach[reach <= 2 * 10.0**-DIGITS] = 0
            order = np.argsort(-reach, axis=1, kind="stable")
            for columns in (order[:, :EAGER], order[:, EAGER:]):
                query = np.repeat(np.arange(a, b), columns.shape[1])
                part = columns.ravel()
                good = (reach[query - a, part] > 0) & (reach[query - a, part] >= kept.least[query])
                query, part = query[good], part[good]
                for at in range(0, len(query), CELLS // (SLICE * 8)):
                    self._score(query[at : at + CELLS // (SLICE * 8)], part[at : at + CELLS // (SLICE * 8)], kept)
                scored += len(query)
        return scored

    def _score(self, query: np.ndarray, part: np.ndarray, kept: Kept) -> None:
        block = self.block
        asked = block.first[query + 1] - block.first[query]
        pair = np.repeat(np.arange(len(query)), asked)
        term = block.term[np.repeat(block.first[query] - (np.cumsum(asked) - asked), asked) + np.arange(len(pair))]
        low = term * CHUNK + part[pair] * SLICE
        start, stop = np.searchsorted(self.key, low), np.searchsorted(self.key, low + SLICE)
        size = stop - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        doc = self.key[at] % CHUNK
        cell = np.repeat(pair * SLICE, size) + doc % SLICE
        scores = np.bincount(cell, weights=self.value[at], minlength=len(query) * SLICE)
        there = np.bincount(cell, weights=self.sign[at], minlength=len(query) * SLICE)
        found = np.flatnonzero(there > 0)
        own = found // SLICE
        kept.add(query[own], scores[found], self.base + part[own] * SLICE + found % SLICE)


def _searched(block: Block):
    number = {t: i for i, t in enumerate(block.names)}
    columns = ("sign", "docs", "counts", "lengths", "slices", "most", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, chunk, rows = Kept(len(block.ids), block.top), None, []
        for batch in batches:
            for here, term, *rest in zip(*(batch.column(c).to_pylist() for c in ("chunk", "term", *columns))):
                if here != chunk:
                    if rows:
                        Chunk(chunk, rows, block).search(kept)
                    chunk, rows = here, []
                rows.append((number[term], *rest))
        if rows:
            Chunk(chunk, rows, block).search(kept)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[kept.query]), pa.array(kept.doc), pa.array(kept.score)], ["query_id", "doc_id", "score"])

    return run


def search(queries: DataFrame, folder: str, top: int = 10, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank): what ``lexical.bm25`` finds in the documents that are live, from the index alone.

    ``queries``: query_id, text; they go to the lists in blocks of bounded bytes."""
    spark = queries.sparkSession
    asked = once(queries.filter("query_id IS NOT NULL"), []).select("query_id", F.array_distinct(tx.tokens(F.col("text"))).alias("terms"))
    size = asked.agg(F.sum(F.least(F.lit(block_bytes), F.aggregate("terms", F.lit(16), lambda s, t: s + 8 + F.octet_length(t))))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    documents, tokens = totals(spark, folder)
    stored, found = lists(spark, folder), None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = Block(sorted((r.query_id, r.terms) for r in part.collect()), top)
        # A block's terms, which its bytes bound, and no more buckets than there are.
        words = spark.createDataFrame([(t,) for t in block.names], "term string").withColumn("bucket", _bucket(buckets))
        some = [r.bucket for r in words.select("bucket").distinct().collect()]
        own = stored.filter(F.col("bucket").isin(some)).join(F.broadcast(words), ["bucket", "term"])
        df = {r.term: r.df for r in own.groupBy("term").agg(F.sum(F.col("sign") * F.col("n")).alias("df")).collect()}
        block.weigh(documents, tokens, df)
        dealt = own.drop("bucket", "n").repartition("chunk").sortWithinPartitions("chunk")
        hits = dealt.mapInArrow(_searched(block), "query_id long, doc_id long, score double")
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, ["query_id"], top=top)


def compacted(spark: SparkSession, folder: str, into: str, buckets: int = BUCKETS) -> None:
    """Write the index anew, without what came and went: lists of one term and chunk meet, and equal rows of a document
    with signs that cancel go."""
    part = uuid.uuid4().hex
    documents, tokens = totals(spark, folder)
    _write(_dealt(lists(spark, folder).drop("bucket"), buckets).mapInArrow(_met, LISTS), into, part)
    spark.createDataFrame([(documents, tokens)], TOTALS).coalesce(1).write.parquet(f"{into}/totals/part={part}")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each term and chunk that has live documents, from rows that come by term and chunk. The last of a
    batch waits for the next, which may go on with it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*waiting, batch.select(["bucket", *ROW])])
        starts = _starts(rows)
        waiting = [rows.slice(int(starts[-1]))] if len(starts) else []
        yield from _live(rows.slice(0, int(starts[-1])) if len(starts) else rows, starts[:-1])
    for rows in waiting:
        yield from _live(rows, np.zeros(1, np.int64))


def _starts(rows: pa.RecordBatch) -> np.ndarray:
    """The first row of each term and chunk."""
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    term, n = rows.column("term"), rows.num_rows
    other = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool) | (np.diff(rows.column("chunk").to_numpy()) != 0)
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _live(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return

    def whole(name: str, kind: str) -> np.ndarray:
        column = rows.column(name)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).astype(np.int64)

    size = rows.column("n").to_numpy().astype(np.int64)
    steps, first = whole("docs", "<u2"), np.cumsum(size) - size
    run = np.cumsum(steps)
    doc = run - np.repeat(run[first] - steps[first], size)
    own = np.repeat(np.searchsorted(starts, np.arange(len(size)), side="right") - 1, size)
    each = np.stack([own, doc, whole("counts", "<i4"), whole("lengths", "<i4")])
    by = np.lexsort(each[::-1])
    each, sign = each[:, by], np.repeat(rows.column("sign").to_numpy().astype(np.int64), size)[by]
    head = np.concatenate([[0], np.flatnonzero((np.diff(each, axis=1) != 0).any(axis=0)) + 1])
    own, doc, counts, lengths = each[:, head[np.add.reduceat(sign, head) > 0]]
    if not len(own):
        return
    first, packed = _packed(own, doc, counts, lengths)
    kept = rows.select(["bucket", "term", "chunk"]).take(pa.array(starts[own[first]]))
    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.ones(len(first), np.int32)), *packed], ["bucket", *ROW])
