"""Exact cosine search that leaves most vectors unread: vectors by their nearest pivot.

The angle between unit vectors is a distance, so if a query is at angle a from a pivot and the vectors of its cell lie
between angles ``near`` and ``far`` from it, none of them is nearer to the query than max(a - far, near - a). Cells are
folders. A search reads, for each query, first the cells that bounds put nearest, as many as hold ``top`` vectors, and
then only those whose bound still allows a score like the last of these.

Pivots are at most ``PIVOTS`` of the vectors, a bounded sample; every vector is in a cell, and answers do not depend on
the pivots, only what is read does: much less where vectors lie in groups, nearly all where they lie evenly in many
dimensions. Zero vectors, whose angle to anything is undefined, are a cell of their own that is always read.

Cases: rows and queries without an id or a vector are left out; equal vectors rank by id; an empty index answers
nothing. Vectors of one index, and the queries, have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ranking import DIGITS, ranked
from .dense import _matrix, _units
from .lexical import best_of_batch

#: Most pivots, and files of a cell that very many vectors share.
PIVOTS, FILES = 1024, 16
#: Bytes of a block of queries, scores of a task's matrix at a time, and the cell of zero vectors.
BLOCK_BYTES, SCORES, ZERO = 4 << 20, 1 << 21, -1
#: What rounding of scores and angles may move a score by.
MARGIN = 2 * 10.0**-DIGITS


def build(vectors: DataFrame, folder: str, most: int = PIVOTS) -> None:
    """Write the vectors (doc_id, vec) by cell to ``folder``, and each cell's pivot, number of vectors and angles."""
    spark = vectors.sparkSession
    rows = vectors.filter("doc_id IS NOT NULL AND vec IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    n = rows.filter(F.exists("vec", lambda x: x != 0)).count()
    picked = rows.filter(F.exists("vec", lambda x: x != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(most, max(1, math.isqrt(n)))).collect()
    pivots = np.unique(_units(np.array([r.vec for r in picked], np.float64)), axis=0) if picked else np.zeros((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_matrix(batch.column("vec")))
            cell, angle = np.full(len(units), ZERO, np.int32), np.zeros(len(units))
            some = np.flatnonzero(units.any(axis=1)) if len(units) else np.zeros(0, np.int64)
            if len(some):
                cos = units[some] @ pivots.T
                cell[some] = cos.argmax(axis=1)
                angle[some] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("vec"), pa.array(angle), pa.array(cell)], ["doc_id", "vec", "angle", "cell"])

    dealt = rows.mapInArrow(run, "doc_id long, vec array<double>, angle double, cell int")
    dealt = dealt.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(FILES)))
    dealt.write.partitionBy("cell").parquet(f"{folder}/vectors")
    known = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    own = _vectors(spark, folder).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    own.join(F.broadcast(known), "cell", "left").coalesce(1).write.parquet(f"{folder}/cells")  # a row for each pivot


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("doc_id long, vec array<double>, angle double, cell int").parquet(f"{folder}/vectors")


class Found:
    """``rankings``: (query_id, doc_id, score, rank); ``read``: of all pairs of a query and a cell, the share that was scored."""

    def __init__(self, rankings: DataFrame, read: float):
        self.rankings, self.read = rankings, read


def _scored(rows: DataFrame, wanted: dict[int, np.ndarray], ids: np.ndarray, against: np.ndarray, top: int, positive: bool) -> DataFrame:
    """(query_id, doc_id, score): each batch's best of the cells' queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for cell in np.unique(cells).tolist():
                queries = wanted[cell]
                own = batch.take(pa.array(np.flatnonzero(cells == cell)))
                step = max(1, SCORES // max(1, len(queries)))
                for part in (own.slice(at, step) for at in range(0, own.num_rows, step)):
                    scores = np.round(_units(_matrix(part.column("vec"))) @ against[queries].T, DIGITS) + 0.0
                    docs = part.column("doc_id").to_numpy()
                    r, q = best_of_batch(scores, docs, top, least=0 if positive else -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[queries[q]]), pa.array(docs[r]), pa.array(scores[r, q])], ["query_id", "doc_id", "score"])

    chosen = rows.filter(F.col("cell").isin([int(c) for c in wanted]))  # folders of other cells are not opened
    return chosen.select("doc_id", "vec", "cell").mapInArrow(run, "query_id long, doc_id long, score double")


def search(queries: DataFrame, folder: str, top: int = 10, positive: bool = False, block_bytes: int = BLOCK_BYTES) -> Found:
    """What ``dense.cosine_search`` finds, from the cells that can hold it. ``queries``: query_id, vec."""
    from ..sources.tables import written

    spark = queries.sparkSession
    cells = spark.read.schema("cell int, n long, near double, far double, pivot array<double>").parquet(f"{folder}/cells").orderBy("cell").collect()
    rows = _vectors(spark, folder)
    asked = queries.filter("query_id IS NOT NULL AND vec IS NOT NULL").select("query_id", "vec")
    size = asked.agg(F.sum(F.size("vec") * 8 + 16 + 16 * len(cells))).first()[0] or 0  # with the bounds of all cells
    blocks = max(1, -(-int(size) // block_bytes))
    names = np.array([c.cell for c in cells], np.int64)
    number = np.array([c.n for c in cells], np.int64)
    zero = names == ZERO
    found, read, pairs = spark.createDataFrame([], "query_id long, doc_id long, score double"), 0, 0
    for b in range(blocks if cells else 0):
        part = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toPandas()
        if not len(part):
            continue
        ids, against = part["query_id"].to_numpy(np.int64), _units(np.array(part["vec"].tolist(), np.float64))
        bound = np.ones((len(ids), len(cells)))  # the best score that a cell allows
        if not zero.all():
            angle = np.arccos(np.clip(against @ np.array([c.pivot for c in cells if c.cell != ZERO]).T, -1, 1))
            near, far = (np.array([getattr(c, x) for c in cells if c.cell != ZERO]) for x in ("near", "far"))
            bound[:, ~zero] = np.cos(np.clip(np.maximum(angle - far, near - angle), 0, np.pi))
        bound[~against.any(axis=1)] = 1.0  # a zero query is as near to all
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(number[order], axis=1) - number[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < top, axis=1)
        first |= zero
        wanted = lambda which: {int(names[c]): np.flatnonzero(which[:, c]) for c in np.flatnonzero(which.any(axis=0))}
        some = written(ranked(_scored(rows, wanted(first), ids, against, top, positive), ["query_id"], top=top).drop("rank"), "near-cells")
        last = some.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= top)
        worst = {r.query_id: r.score for r in last.collect()}  # a row for each query of the block
        least = np.array([worst.get(int(q), 0.0 if positive else -np.inf) for q in ids])
        more = (bound + MARGIN >= least[:, None]) & ~first
        found = found.unionByName(some)
        if more.any():
            found = found.unionByName(_scored(rows, wanted(more), ids, against, top, positive))
        read, pairs = read + int(first.sum() + more.sum()), pairs + first.size
    return Found(ranked(found, ["query_id"], top=top), read / pairs if pairs else 0.0)
