"""A report that grows with its log: partial sums of measured entries, batch by batch.

Every figure of ``evaluation.accuracy`` and of its strata is a quotient of sums, so sums of disjoint parts can be added.
A stream over files of measured entries writes the sums of each batch into a folder of the batch's number, in place of
what an earlier try of that batch left: a batch counts once, however often it ran. The report adds up all folders; its
cost follows the batches, strategies and labels, not the entries.

Sums are decimals, so that any split into files and batches gives the same report to the last digit.

Cases: an entry without a strategy is left out; a null measure is in no mean; a null flag is false; a null label is ``unknown``; an empty log has an empty report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.evaluation import INDICATIVE_BELOW

#: Measures with a mean, and rates with the condition that they count.
MEASURES = ("ndcg", "overlap5", "overlap10", "mrr")
RATES = {"top1_rate": "top1", "zero10_rate": "overlap10 = 0", "top1_in_10_rate": "mrr > 0", "perfect5_rate": "overlap5 >= 5"}
ENTRY = "query_id long, strategy string, overlap5 long, overlap10 long, mrr double, ndcg double, top1 boolean, ts timestamp, version string"
SUM = "decimal(38,12)"


def partial(entries: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """(stratum, label, strategy, n, sums and counts of the measures, counts of the rates, earliest, latest, versions): the
    overall sums of each strategy, and those of each label of ``strata`` (columns of the entries), in one pass."""
    labels = [F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("label")), *[F.struct(F.lit(c).alias("stratum"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("label")) for c in strata]]
    rows = entries.filter("strategy IS NOT NULL").withColumn("_at", F.explode(F.array(*labels))).select("_at.*", "strategy", "ts", "version", *MEASURES, "top1")
    sums = [F.coalesce(F.sum(F.col(m).cast("decimal(30,12)")), F.lit(0)).cast(SUM).alias(f"sum_{m}") for m in MEASURES]
    return rows.groupBy("stratum", "label", "strategy").agg(
        F.count(F.lit(1)).alias("n"), *sums, *[F.count(m).alias(f"n_{m}") for m in MEASURES], *[F.count_if(F.expr(c)).alias(r) for r, c in RATES.items()],
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.collect_set("version").alias("versions"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The sums of several parts, in the form of one."""
    return parts.groupBy("stratum", "label", "strategy").agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"n_{m}" for m in MEASURES], *RATES)], *[F.sum(f"sum_{m}").cast(SUM).alias(f"sum_{m}") for m in MEASURES],
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"), F.array_distinct(F.flatten(F.collect_set("versions"))).alias("versions"),
    )


def figures(parts: DataFrame) -> DataFrame:
    """The report: the columns of ``evaluation.accuracy`` by stratum and label, with the span of time and the versions, newest first."""
    r = lambda c: F.round(c, 6)
    mean = lambda m: r(F.col(f"sum_{m}").cast("double") / F.nullif(F.col(f"n_{m}"), F.lit(0)))

    def rate(name: str) -> Column:
        flags = {"top1_rate": "n", "zero10_rate": "n_overlap10", "top1_in_10_rate": "n_mrr", "perfect5_rate": "n_overlap5"}
        return r(F.col(name).cast("double") / F.nullif(F.col(flags[name]), F.lit(0)))

    return merged(parts).select(
        "stratum", "label", "strategy", "n", *[mean(m).alias(f"mean_{m}") for m in MEASURES], *[rate(c).alias(c) for c in RATES],
        (F.col("n") < INDICATIVE_BELOW).alias("indicative_only"), "earliest", "latest", F.sort_array("versions", asc=False).alias("versions"),
    )


def ingest(spark: SparkSession, log: str, folder: str, strata: tuple[str, ...] = (), files: int = 100, schema: str = ENTRY) -> int:
    """Take in the files of measured entries (Parquet) in ``log`` that are new since the last call; how many batches ran.

    ``folder`` keeps the stream's place and the sums of each batch. Files are never taken in twice, also if a call ends
    between writing sums and noting the place: the batch runs again under its number and replaces them."""
    own = schema if not strata else f"{schema}, " + ", ".join(f"{c} string" for c in strata)
    ran = []

    def take(batch: DataFrame, number: int) -> None:
        partial(batch, strata).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")  # a row for each strategy and label
        ran.append(number)

    stream = spark.readStream.schema(own).option("maxFilesPerTrigger", files).parquet(log)
    stream.writeStream.option("checkpointLocation", f"{folder}/place").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return len(ran)


PARTS = (
    "stratum string, label string, strategy string, n long, "
    + ", ".join(f"sum_{m} {SUM}, n_{m} long" for m in MEASURES)
    + ", "
    + ", ".join(f"{r} long" for r in RATES)
    + ", earliest timestamp, latest timestamp, versions array<string>"
)


def report(spark: SparkSession, folder: str) -> DataFrame:
    return figures(spark.read.schema(f"{PARTS}, batch int").parquet(f"{folder}/sums").drop("batch"))
