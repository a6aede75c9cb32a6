"""Vectors kept up to date from a stream of changed rows.

The stream reads files of rows (id, memory, deleted, at) as they come, so many in a micro-batch. Of a batch the newest row
of each id counts. A live row whose text has no vector of this model is embedded; a deleted one loses its vector. Vectors
stand in hash buckets of a ``buckets`` store, and a batch writes those buckets alone in which something changed.

Nothing is asked twice: a text is known by its hash, so a batch that ran before and runs again, after a stop between
writing vectors and noting the stream's place, finds its vectors there. What failed is written too, with its error and
without a vector, and is asked again with the next batch, or by ``again``.

Cases: a row without an id is left out, one without a text has no vector to get and loses the one it had; of rows of one
id and time the live one of the larger text counts; an older row that comes in a later batch loses against what is
stored for a newer time (a deletion leaves nothing to lose against); an empty stream writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dense
from ..sources import buckets as store
from ..sources.tables import written

VECTORS = "id long, at long, model string, hash string, vec array<double>, dims int, memory string, error string"
ROWS = "id long, memory string, deleted boolean, at long"


def _newest(rows: DataFrame) -> DataFrame:
    rows = rows.filter("id IS NOT NULL").select("id", "memory", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("at", F.lit(0)).alias("at"))
    order = F.struct("at", ~F.col("deleted"), F.coalesce("memory", F.lit("")))
    return rows.groupBy("id").agg(F.max_by(F.struct("memory", "deleted", "at"), order).alias("r")).select("id", "r.*")


def _merged(mine: DataFrame, disk: DataFrame) -> DataFrame:
    """The session's rows in place of the stored ones of their ids; a row without a hash takes its id's vector away."""
    kept = disk.join(mine.select("id"), "id", "left_anti")
    return kept.unionByName(mine.filter("hash IS NOT NULL").select(*kept.columns))


def take(batch: DataFrame, folder: str, embed: Callable[[list[str]], list[list[float]]], model: str, buckets: int = 64, **limits) -> dict[str, int]:
    """Take in one batch of changed rows: how many texts were asked for, how many failed, and how many buckets were written."""
    spark = batch.sparkSession
    at = store.current(spark, folder, buckets)
    fresh = written(_newest(batch).withColumn("bucket", store.bucket_of(at.buckets)), "changed-rows")
    touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}
    have = store.load(spark, folder, VECTORS, touched, at)
    known = have.select("id", F.col("at").alias("known_at"), F.col("hash").alias("known"), F.col("model").alias("known_model"), F.col("error").alias("known_error"))
    rows = fresh.join(known, "id", "left").filter("known_at IS NULL OR at >= known_at")
    gone = (F.col("deleted") | F.col("memory").isNull()) & F.col("known_at").isNotNull()
    same = (F.sha1("memory") == F.col("known")) & (F.col("known_model") == model) & F.col("known_error").isNull()
    wanted = rows.filter(~F.col("deleted") & F.col("memory").isNotNull() & ~F.coalesce(same, F.lit(False))).select("id", "memory", "at")
    got = written(dense.embedded(wanted, embed, model, **limits).join(wanted, "id").select("id", "at", "model", "hash", "vec", "dims", F.when(F.col("error").isNotNull(), F.col("memory")).alias("memory"), "error"), "embedded")
    none = {c: F.lit(None) for c in ("model", "hash", "vec", "dims", "memory", "error")}
    lost = rows.filter(gone).select("id", "at").withColumns(none).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in got.schema])
    counts = got.agg(F.count(F.lit(1)).alias("asked"), F.count("error").alias("failed")).first()
    _, wrote = store.save(got.unionByName(lost), folder, _merged, VECTORS, buckets=at.buckets)
    return {"asked": counts.asked, "failed": counts.failed, "buckets": wrote}


def follow(spark: SparkSession, rows: str, folder: str, place: str, embed: Callable[[list[str]], list[list[float]]], model: str, files: int = 100, **limits) -> list[dict[str, int]]:
    """Take in all files of ``rows`` that are new since the last call, ``files`` in a batch; what each batch did. ``place``
    keeps how far the stream has come, ``folder`` the vectors."""
    done: list[dict[str, int]] = []
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(rows)
    writer = stream.writeStream.option("checkpointLocation", place).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: done.append(take(batch, folder, embed, model, **limits))).start().awaitTermination()
    return done


def again(spark: SparkSession, folder: str, embed: Callable[[list[str]], list[list[float]]], model: str, **limits) -> dict[str, int]:
    """Ask once more for every text that failed."""
    failed = store.load(spark, folder, VECTORS).filter("error IS NOT NULL").select("id", "memory", F.lit(False).alias("deleted"), "at")
    return take(failed, folder, embed, model, **limits)


def vectors(spark: SparkSession, folder: str, model: str) -> DataFrame:
    """(id, model, hash, vec, dims, normalized): the vectors there are."""
    return store.load(spark, folder, VECTORS).filter((F.col("model") == model) & F.col("vec").isNotNull()).select("id", "model", "hash", "vec", "dims", F.lit(True).alias("normalized"))
