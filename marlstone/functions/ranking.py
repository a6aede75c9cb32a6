"""Expressions shared by ranking and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DIGITS = 6


def ranked(scores: DataFrame, group: list[str], score: str = "score", tie: str = "doc_id", top: int | None = None) -> DataFrame:
    """1-based ``rank`` by descending score, ties by id; scores are rounded first so that the order is reproducible.

    A limit becomes a per-task limit before the shuffle (WindowGroupLimit)."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    out = scores.withColumn(score, F.round(score, DIGITS)).withColumn("rank", F.row_number().over(order))
    return out if top is None else out.filter(F.col("rank") <= top)


def gain(grade: Column) -> Column:
    return F.when(grade >= 2, 3.0).when(grade == 1, 1.0).otherwise(0.0)


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)
