"""How the driver's tables stand in for a store: documents are memories, benchmark items queries, labels grades.

A document's language is its user and its source its application; one that is labelled toxic is a tombstone.
An item's own vector is the embedding of the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("user_id"), F.col("source").alias("app_id"))


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """id, memory, user_id, app_id, deleted, source (a judged good document is local, others observed)."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("memory"),
        F.col("lang").alias("user_id"),
        F.col("source").alias("app_id"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"),
        F.when(F.col("quality") == 1, "local").otherwise("observed").alias("source"),
    )


MEMORIES = """memories AS (SELECT d.doc_id AS id, d.text AS memory, d.lang AS user_id, d.source AS app_id,
        coalesce(l.toxic = 1, false) AS deleted, CASE WHEN l.quality = 1 THEN 'local' ELSE 'observed' END AS source
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Languages in which queries are asked in turn, for scoped searches.
SCOPES = ("en", "fr", "de", "es")


def scoped_queries(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, SCOPES)), (F.col("query_id") % len(SCOPES) + 1).cast("int"))
    return queries(spark, sf).withColumn("user_id", asked)


def partly_scoped_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Of four queries one asks for a user, one for a user and an application, one for an application, one for all."""
    turn, asked = F.col("query_id") % 4, scoped_queries(spark, sf)
    user = F.when(turn == 0, "*").when(turn == 2, "").otherwise(F.element_at(F.array(*map(F.lit, SCOPES)), (F.col("query_id") % 3 + 1).cast("int")))
    app = F.when(turn >= 2, F.concat(F.lit("src"), (F.col("query_id") % 5).cast("string")))
    return asked.withColumns({"user_id": user, "app_id": app})


PARTLY = """partly AS (SELECT item_id AS query_id, text, CASE item_id % 4 WHEN 0 THEN '*' WHEN 2 THEN '' ELSE (['en', 'fr', 'de', 'es'])[item_id % 3 + 1] END AS user_id,
        CASE WHEN item_id % 4 >= 2 THEN 'src' || (item_id % 5) END AS app_id FROM benchmark)"""
SCOPED = "scoped AS (SELECT item_id AS query_id, text, (['en', 'fr', 'de', 'es'])[item_id % 4 + 1] AS user_id FROM benchmark)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumnRenamed("doc_id", "query_id").join(queries(spark, sf).select("query_id"), "query_id", "left_semi")


def grades(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, grade): 0 to 2, the better the document the higher."""
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: a tenant's views search, clicks read one, signups list, purchases write; an error is a
    search that meets a full service."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    kind = F.when(t.isin("view", "error"), "read-search").when(t == "click", "read-get").when(t == "signup", "read-getall").otherwise("write-update")
    return e.select(
        F.col("user_id").alias("tenant"),
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        kind.alias("kind"),
        t.alias("key"),
        F.when(t == "error", 429).otherwise(200).alias("status"),
        F.lit(None).cast("double").alias("retry_after"),
        F.lit(True).alias("local"),
    )
