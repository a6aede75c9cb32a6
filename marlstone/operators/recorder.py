"""The comparison recorder: each request ranked every way there is, beside what the service answered, as log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..plans import strategy as st
from ..sources import logs
from ..sources.tables import written
from . import fusion, lexical, recall

# The version of the entries' form, the hits that are kept of a side, and each side's columns.
SCHEMA_VERSION, HITS = 1, 10
SIDES = {
    "legacy": ("local", "overlap5", "overlap10", "mrr"),
    "bm25": ("localBm25", "overlapBm25_5", "overlapBm25_10", "mrrBm25"),
    "fusion": ("localFusion", "overlapFusion5", "overlapFusion10", "mrrFusion"),
    "dense": ("localDense", "overlapDense5", "overlapDense10", "mrrDense"),
    "dense+rerank": ("localDenseRerank", "overlapDenseRerank5", "overlapDenseRerank10", "mrrDenseRerank"),
    "vec": ("localVec", "overlapVec5", "overlapVec10", "mrrVec"),
}
SCORED = ("legacy", "bm25", "vec")


def overlap(ours: Column, theirs: Column, k: int) -> Column:
    """How many of the first ``k`` ids of theirs are among the first ``k`` of ours."""
    first = F.slice(ours, 1, k)
    return F.size(F.filter(F.slice(theirs, 1, k), lambda x: F.array_contains(first, x)))


def reciprocal(ours: Column, theirs: Column) -> Column:
    """The reciprocal rank of their first id among our first ten, else 0."""
    at = F.array_position(F.slice(ours, 1, HITS), F.get(theirs, F.lit(0)))
    return F.when(at > 0, 1 / at).otherwise(F.lit(0.0))


def sides(
    queries: DataFrame, corpus: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None,
    reranker: recall.Reranker | None = None, scope: list[str] | None = None, weight: float = st.LEXICAL_WEIGHT,
) -> DataFrame:
    """(query_id, strategy, doc_id, score, rank) of every way that can run: words and vectors are searched once.

    The keyword scorer and ``vec`` rank the whole corpus, the others what the query's scope lets it see."""
    words = written(lexical.bm25(queries, corpus, fusion.POOL, scope), "words")
    found = {"legacy": lexical.keyword_hits(queries, corpus, HITS), "bm25": words}
    if vectors is not None and query_vectors is not None:
        near = written(recall.near(queries, corpus, vectors, query_vectors, scope), "near")
        found |= {"fusion": fusion.fuse({"lexical": (words, weight), "dense": (near, 1.0)}), "dense": near}
        if reranker:
            found["dense+rerank"] = fusion.apply_rerank(near, reranker(near, queries, corpus), HITS)
        found["vec"] = (recall.near(queries, corpus, vectors, query_vectors, None) if scope else near).filter("score > 0")
    rows = [df.filter(F.col("rank") <= HITS).select("query_id", F.lit(name).alias("strategy"), "doc_id", "score", "rank") for name, df in found.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    return out


def entries(queries: DataFrame, corpus: DataFrame, remote: DataFrame, ranked: DataFrame, at: Column, mode: str = "remote", version: str | None = None, scope: list[str] | None = None) -> DataFrame:
    """One entry for each query, as the log keeps them, with its query_id.

    ``remote``: query_id, doc_id, score, rank of the service's answer (a query without one has an empty list);
    ``ranked``: what ``sides`` gives. A side without a hit is null and is not compared; against an empty answer every
    measure is 0. ``unmatched``: the first terms of a query, in its order, that no document in its scope has, if BM25
    found anything."""
    hit = F.struct("rank", F.col("doc_id").cast("string").alias("id"), "score")
    hits = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score")))
    own = ranked.groupBy("query_id").agg(*[hits(F.when(F.col("strategy") == name, hit)).alias(columns[0]) for name, columns in SIDES.items()])
    theirs = remote.filter(F.col("rank") <= HITS).groupBy("query_id").agg(hits(hit).alias("remote"))
    absent = lexical.unmatched(queries, corpus, scope).groupBy("query_id").agg(F.collect_set("term").alias("absent"))
    asked = queries.select("query_id", "text", *(scope or []))
    rows = asked.join(own, "query_id", "left").join(theirs, "query_id", "left").join(absent, "query_id", "left")
    none = F.array().cast(f"array<{logs.HIT}>")
    rows = rows.withColumns({"remote": F.coalesce("remote", none), "local": F.coalesce("local", none)})
    # Ids as columns of their own: lambda functions that stand within each other would share a variable.
    rows = rows.withColumns({f"_{c}": F.transform(F.col(c), lambda h: h["id"]) for c in ("remote", *[columns[0] for columns in SIDES.values()])})
    ids = lambda c: F.col(f"_{c}")
    out = [F.col("query_id"), at.cast("long").alias("ts"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(version).cast("string").alias("codeVersion"), F.lit(mode).alias("mode"), F.coalesce("text", F.lit("")).alias("query"), F.col("remote")]
    for name, (side, five, ten, mrr) in SIDES.items():
        there = F.lit(True) if name == "legacy" else F.size(side) > 0
        measured = {five: overlap(ids(side), ids("remote"), 5), ten: overlap(ids(side), ids("remote"), 10), mrr: reciprocal(ids(side), ids("remote"))}
        out += [F.when(there, F.col(side) if name in SCORED else ids(side)).alias(side), *[F.when(there, c).alias(n) for n, c in measured.items()]]
    terms = F.array_intersect(F.array_distinct(tx.tokens(F.col("text"))), F.coalesce("absent", F.array().cast("array<string>")))
    out.append(F.when(F.size("localBm25") > 0, terms).alias("unmatched"))
    if scope:
        own_scope = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, scope)), F.array(*[F.col(c).cast("string") for c in scope])), lambda _, v: v.isNotNull() & ~v.isin("", "*"))
        out.append(F.when(F.size(own_scope) > 0, own_scope).alias("scope"))
    return logs.compacted(rows.select(*out))
