"""Reciprocal rank fusion, and reranking of a fused pool."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranking import ranked

K = 60
POOL, TOP = 50, 10


def fuse(channels: dict[str, tuple[DataFrame, float]], top: int | None = POOL, k: int = K) -> DataFrame:
    """(query_id, doc_id, score, ranks, rank) from channels of (query_id, doc_id, rank) and their weights.

    Only ranks count, not the scale of scores; a document keeps its place in ``ranks`` even at weight 0."""
    parts = [df.select("query_id", "doc_id", "rank", F.lit(name).alias("channel"), F.lit(float(w)).alias("weight")) for name, (df, w) in channels.items()]
    both = reduce(DataFrame.unionByName, parts)
    part = F.col("weight") / (k + F.col("rank"))
    ranks = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank"))))
    return ranked(both.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), ranks.alias("ranks")), ["query_id"], top=top)


def apply_rerank(pool: DataFrame, scores: DataFrame, top: int = TOP) -> DataFrame:
    """The pool in the order of the reranker's scores; documents that it left out follow in the order of the pool.

    ``scores``: query_id, doc_id, position (a document given twice keeps its last position)."""
    last = scores.groupBy("query_id", "doc_id").agg(F.max("position").alias("position"))
    order = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), F.col("rank"))
    both = pool.join(last, ["query_id", "doc_id"], "left").withColumn("reranked", F.row_number().over(order))
    return both.filter(F.col("reranked") <= top).select("query_id", "doc_id", "score", F.col("reranked").alias("rank"))


def rerank(pool: DataFrame, queries: DataFrame, corpus: DataFrame, score: Callable[[str, list[str]], list[float]], chars: int = 4000) -> DataFrame:
    """(query_id, doc_id, position, error) by an injected scorer of a query's texts.

    A query whose scoring fails, or does not give one score a text, has one row with the error and no document, and so
    keeps the order of its pool."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            values = score(pdf["query"].iloc[0], pdf["text"].str.slice(0, chars).tolist())
            if len(values) != len(pdf):
                raise ValueError(f"{len(values)} scores for {len(pdf)} texts")
        except Exception as failure:  # the scorer is not ours: whatever it raises fails this query alone
            return pd.DataFrame({"query_id": pdf["query_id"].iloc[:1], "doc_id": None, "position": None, "error": str(failure) or type(failure).__name__})
        pdf = pdf.assign(value=values).sort_values(["value", "rank"], ascending=[False, True])
        return pdf[["query_id", "doc_id"]].assign(position=range(len(pdf)), error=None)

    rows = pool.join(corpus.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return rows.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, position long, error string")


def parsed_positions(responses: DataFrame, pools: DataFrame) -> DataFrame:
    """(query_id, doc_id, position) from reranker responses (query_id, body) over pools (query_id, ids).

    ``results`` or ``data``; an item without an index has its own place; indices out of range are dropped; by
    descending relevance_score or score."""
    item = "array<struct<index:int,relevance_score:double,score:double>>"
    body = F.from_json("body", f"results {item}, data {item}")
    rows = responses.select("query_id", F.posexplode(F.coalesce(body["results"], body["data"])).alias("at", "item")).join(pools, "query_id")
    index = F.coalesce("item.index", "at")
    rows = rows.filter((index >= 0) & (index < F.size("ids")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("item.relevance_score", "item.score").desc_nulls_last(), "at")
    return rows.select("query_id", F.get("ids", index).alias("doc_id"), (F.row_number().over(order) - 1).cast("long").alias("position"))


def term_coverage(queries: DataFrame, corpus: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, doc_id, position): a deterministic stand-in for a cross-encoder, the share of a query's distinct
    terms that a document holds; ties in the order of the pool."""
    from ..functions.text import tokens

    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    # A document is cut into tokens once, however many queries have it in their pools.
    texts = corpus.select("doc_id", "text").join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    rows = pool.select("query_id", "doc_id", "rank").join(texts, "doc_id").join(q, "query_id")
    held = F.size(F.array_intersect("asked", "tokens"))
    share = F.when(F.size("asked") == 0, 0.0).otherwise(F.round(held / F.size("asked"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("share").desc(), "rank")
    return rows.withColumn("share", share).select("query_id", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("position"))
