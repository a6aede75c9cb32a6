"""Operator 10: exact duplicates, in DataFrame operations only.

Texts are equal when identical after each run of ASCII white space is replaced
by one space. One scan hashes every text (the 128-bit MD5 that groups, and the
SHA-256 that is reported) and counts the rows of each hash and id: only these
few bytes a row are shuffled, and a group that holds a third of all rows is
partly counted in every task. A second scan takes the texts of groups of more
than one row and compares bytes: if a group's smallest and largest text are the
same then so are all between them, which excludes a collision without comparing
pairs. Groups in which texts differ are grouped by the text itself. The counted
rows are written to the shared folder and join their groups there; adaptive
execution splits the join where one group dominates.

Cases: a null text counts as empty; an empty table gives an empty result; a
null id is larger than any other; of rows that share both the smallest id and
the text exactly one is marked kept; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .shared import ascii_squeezed, id_text, stash


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    base = id_text(docs, id_col, text_col).select("doc_id", ascii_squeezed("text").alias("norm"))
    base = base.select("doc_id", "norm", content_hash(F.col("norm")).alias("h"))
    rows = base.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    counted = stash(rows.groupBy("h", "doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")), "exact-rows")
    groups = stash(_groups(counted, "h").withColumnRenamed("h", "key"), "exact-groups")
    several = groups.filter("group_size > 1").select(F.col("key").alias("h"))
    # Written before it is grouped: the join may then be split where a group dominates, and every task groups its part first.
    met = stash(base.select("h", "norm").join(several, "h", "left_semi"), "exact-met")
    unlike = stash(met.groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi").select("h"), "exact-unlike")
    if unlike.isEmpty():
        return _marked(counted.withColumn("key", F.col("h")).drop("h"), groups)
    alike = counted.join(unlike, "h", "left_anti").withColumn("key", F.col("h")).drop("h")
    apart = base.join(unlike, "h").groupBy(F.col("norm").cast("binary").alias("key"), "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    apart = stash(apart.withColumn("sha", F.unhex(F.sha2("key", 256))), "exact-apart")
    return _marked(alike, groups).unionByName(_marked(apart, _groups(apart, "key")))


def _groups(counted: DataFrame, key: str) -> DataFrame:
    return counted.groupBy(key).agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))


def _marked(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each row that was counted; of those with the group's smallest id the first stays."""
    each = counted.join(groups, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept")
    return each.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))
