"""Building and judging a gold set: noise, pools, stratified samples, grades, judge agreement."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import MAX_POOL_CHARS, is_noise, query_shape


def candidates(log: DataFrame, pools: DataFrame) -> DataFrame:
    """Logged queries worth judging: no noise, a pool, and of equal texts (in lower case) the first in the log."""
    order = Window.partitionBy(F.lower("text")).orderBy("seq")
    rows = log.filter(~is_noise(F.col("text"))).join(pools.select("query_id").distinct(), "query_id", "left_semi")
    return rows.withColumn("_at", F.row_number().over(order)).filter("_at = 1").drop("_at").withColumn("shape", query_shape(F.col("text")))


def pool(rankings: DataFrame, corpus: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, doc_id): the union of every strategy's first results that are live."""
    return rankings.filter(F.col("rank") <= top).select("query_id", "doc_id").distinct().join(corpus.select("doc_id"), "doc_id", "left_semi")


def pool_sizes(pools: DataFrame) -> DataFrame:
    """(median, least, most): the median of an even number is the upper of the two in the middle.

    The middle is found by rank over the distribution of sizes, which has as many rows as there are sizes."""
    sizes = pools.groupBy("query_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.orderBy("size"))
    rows = sizes.withColumns({"upto": running, "n": F.sum("c").over(Window.partitionBy())})
    return rows.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("size"))).alias("median"), F.min("size").alias("least"), F.max("size").alias("most"))


def domination(rankings: DataFrame, pools: DataFrame, top: int = 10) -> DataFrame:
    """Per strategy: the mean share of a query's pool that its own first results make up."""
    sizes = pools.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    own = rankings.filter(F.col("rank") <= top).join(pools, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "strategy").agg(F.count(F.lit(1)).alias("own"))
    return own.join(sizes, "query_id").groupBy("strategy").agg(F.round(F.avg(F.col("own") / F.col("size")), 6).alias("share"))


def pool_text(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.lit(MAX_POOL_CHARS))


# Fixed values of a published generator, so that seeded samples are the same: its step, its shifts and its odd masks.
STEP, SHIFTS, MASKS = 0x6D2B79F5, (15, 7, 14), (1, 61)


def uniform_at(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The numbers in [0, 1) that a 32-bit generator with a Weyl sequence as its state has at these places (from 0): its
    state after n steps is a product, so that no number needs the ones before."""
    with np.errstate(over="ignore"):
        state = seed.astype(np.uint32) + (place + 1).astype(np.uint32) * np.uint32(STEP)
        one, two, three = map(np.uint32, SHIFTS)
        t = (state ^ (state >> one)) * (state | np.uint32(MASKS[0]))
        t ^= t + (t ^ (t >> two)) * (t | np.uint32(MASKS[1]))
        return (t ^ (t >> three)) / 2.0**32


def uniform(seed: int, n: int) -> np.ndarray:
    """The first n numbers."""
    return uniform_at(np.full(n, seed), np.arange(n))


def shuffle(items: list, seed: int) -> list:
    """From the end, each element changes place with one at or before it."""
    out, draws = list(items), uniform(seed, max(len(items) - 1, 0))
    for draw, i in zip(draws, range(len(out) - 1, 0, -1)):
        j = int(draw * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``i``, their place from 0 in their group by ``order``, and ``n``, the group's size. Ranges of the whole
    order are counted part by part, so a group may be of any size; what is broadcast is a row for each part and group."""
    from ..sources.tables import written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(group).to_pylist()
            places = []
            for name in names:
                places.append(seen.get(name, 0))
                seen[name] = places[-1] + 1
            columns = [*batch.columns, pa.array([part] * len(names), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, place long"
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(most, group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema), "numbered")
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = F.broadcast(sizes.withColumns({"before": before, "n": F.sum("size").over(whole)}).drop("size"))
    return dealt.join(known, [group, "part"]).withColumn("i", F.col("before") + F.col("place")).drop("part", "place", "before")


def shuffled(rows: DataFrame, group: str, order: list[str], seed: Column, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group as ``shuffle`` leaves them, with ``at``, their place from 0.

    No group is shuffled as a whole. A step of the shuffle exchanges place i with a place j that the generator gives for i
    alone; so of each of the quota's places it is asked which step put there what it holds in the end, from which place
    that came, and so on back to a row's place in the order. Rows of a null group are left out. A round of questions is one join of all steps with the
    quota's places, which are few; there are about as many rounds as a group's size has digits, twice."""
    from ..sources.tables import written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, n, own = (batch.column(c).to_numpy() for c in ("i", "n", "_seed"))
            j = np.where(i > 0, (uniform_at(own, n - 1 - i) * (i + 1)).astype(np.int64), 0)
            yield batch.append_column("j", pa.array(j))

    counted = numbered(rows, group, order).withColumn("_seed", seed.cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", j long"
    steps = written(counted.mapInArrow(run, schema), "shuffle-steps")
    # (at, q): the place asked for, and where what it holds was before all steps below ``t``.
    moved = steps.filter(F.col("i") < quota).select(group, F.col("i").alias("at"), F.when(F.col("i") > 0, F.col("j")).otherwise(F.lit(0)).alias("q"), F.when(F.col("i") > 0, F.col("i") + 1).otherwise(F.lit(1)).alias("t"))
    done, open_ = None, written(moved, "shuffle-places")
    made = steps.filter("i > 0").select(group, F.col("i").alias("step"), F.col("j").alias("q"))
    while True:
        # Of the steps that put something at q and come before t, the last: the one of the smallest number.
        hits = made.join(F.broadcast(open_), [group, "q"]).filter("step >= t").groupBy(group, "at").agg(F.min("step").alias("step"))
        after = written(open_.join(hits, [group, "at"], "left"), "shuffle-places")
        still = after.filter("step IS NULL").select(group, "at", "q")
        done = still if done is None else done.unionByName(still)
        open_ = after.filter("step IS NOT NULL").select(group, "at", F.col("step").alias("q"), (F.col("step") + 1).alias("t"))
        if open_.isEmpty():
            break
    return steps.join(F.broadcast(done.withColumnRenamed("q", "i")), [group, "i"]).drop("i", "n", "j", "_seed")


def sample(rows: DataFrame, size: int, seed: int, per_bucket: int, order: str = "seq") -> DataFrame:
    """About ``size`` queries, an equal quota of each shape, by seeded shuffles of each shape's rows in order (ties by id), and
    of what they leave, shape by shape. No task holds a shape."""
    shapes = rows.select("shape").distinct().count()
    quota = min(max(1, -(-size // max(1, shapes))), per_bucket)
    picked = shuffled(rows.select("query_id", "shape", order), "shape", [order, "query_id"], F.lit(seed) + F.length("shape"), quota)
    chosen = shuffled(picked.select("query_id", F.lit("").alias("whole"), "shape", F.col("at").alias("place_")), "whole", ["shape", "place_"], F.lit(seed), size)
    return rows.join(F.broadcast(chosen.select("query_id")), "query_id", "left_semi").select(*rows.columns).orderBy("text", "query_id")


def merged_grades(new: DataFrame, prior: DataFrame, pools: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade, source): of the pool, new grades before prior ones (of which the first file wins)."""
    both = new.select("query_id", "doc_id", "grade", F.lit(0).alias("priority")).unionByName(prior.select("query_id", "doc_id", "grade", (F.col("file") + 1).alias("priority")))
    best = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("priority", "grade")).alias("best"))
    known = best.join(pools, ["query_id", "doc_id"], "left_semi")
    return known.select("query_id", "doc_id", "best.grade", F.when(F.col("best.priority") == 0, "new").otherwise("prior").alias("source"))


def missing_grades(pools: DataFrame, grades: DataFrame) -> DataFrame:
    return pools.join(grades.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")


def agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(first, second, n, share): the confusion of two passes over the pairs that both graded."""
    both = first.select("query_id", "doc_id", F.col("grade").alias("first")).join(second.select("query_id", "doc_id", F.col("grade").alias("second")), ["query_id", "doc_id"])
    cells = both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def prompts(queries: DataFrame, pools: DataFrame, corpus: DataFrame, instructions: str, chars: int = MAX_POOL_CHARS) -> DataFrame:
    """(query_id, prompt): the query, its scope, the instructions and one line for each document of its pool, in order."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.regexp_replace(F.substr("text", F.lit(1), F.lit(chars)), r"\s+", " "))
    listed = pools.join(corpus.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("Query: "), F.col("text"), F.lit("\nScope: "), F.coalesce("scope", F.lit("(unscoped)")), F.lit(f"\n\n{instructions}\n\n"))
    return queries.join(listed, "query_id").select("query_id", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def normal_grade(value: Column) -> Column:
    """0, 1 or 2 from a number; null if it is none or not finite."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, F.when(number <= 0, 0).when(number >= 2, 2).when(number >= 1, 1).otherwise(0))


_LINE = re.compile(r"\s*([A-Za-z0-9_-]+)\s*[:=]\s*([0-2])\s*")


def first_object(text: str) -> dict | None:
    """The first balanced JSON object in prose, if it parses."""
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"?|\\.|[{}]', text[start:], re.S):
        depth += (m.group() == "{") - (m.group() == "}")
        if m.group() == "}" and depth == 0:
            try:
                return json.loads(text[start : start + m.end()])
            except ValueError:
                return None
    return None


def reply_grades(text: str) -> dict[str, object]:
    """id -> raw grade from a judge's reply: a JSON object (or one under ``grades``), else lines ``id: grade``."""
    found = first_object(text or "")
    if found is None:
        return {m[1]: m[2] for m in map(_LINE.fullmatch, (text or "").split("\n")) if m}
    grades = found.get("grades", found)
    if isinstance(grades, list):
        return {str(g.get("id")): next((g[k] for k in ("grade", "score", "relevance") if k in g), None) for g in grades if isinstance(g, dict)}
    return dict(grades) if isinstance(grades, dict) else {}


def judged(replies: DataFrame, pools: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) from replies (query_id, reply), ids outside the pool dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(q, i, None if isinstance(g, bool) else str(g)) for q, reply in zip(pdf["query_id"], pdf["reply"]) for i, g in reply_grades(reply).items()]
            yield pd.DataFrame(rows, columns=["query_id", "doc_id", "raw"])

    rows = replies.select("query_id", "reply").mapInPandas(run, "query_id long, doc_id string, raw string")
    graded = rows.select("query_id", F.col("doc_id").try_cast("long").alias("doc_id"), normal_grade(F.col("raw")).alias("grade")).filter("grade IS NOT NULL")
    return graded.join(pools, ["query_id", "doc_id"], "left_semi")
