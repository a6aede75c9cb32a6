"""The comparison log: JSON lines in a folder of files, sealed by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ingest import string_field

HIT = "struct<id:string,score:double>"
SCHEMA = (
    "ts long, schemaVersion int, codeVersion string, mode string, query string, "
    f"local array<{HIT}>, remote array<{HIT}>, localVec array<{HIT}>, localBm25 array<{HIT}>, "
    "localFusion array<string>, localDense array<string>, localDenseRerank array<string>, "
    "unmatched array<string>, scope map<string,string>, channelErrors map<string,string>"
)


# Characters of a query, terms, hits and decimals of a score that an entry keeps.
QUERY_CHARS, TERMS, HITS, DECIMALS = 200, 10, 10, 4


def compacted(entries: DataFrame) -> DataFrame:
    """Entries as they are written: the start of the query, the first terms and hits, scores rounded. Columns of
    ``SCHEMA`` that are missing stay missing."""
    hits = lambda c: F.transform(F.slice(F.col(c), F.lit(1), F.lit(HITS)), lambda h: F.struct(h["id"].alias("id"), F.round(h["score"], DECIMALS).alias("score")))
    short = {c: hits(c) for c in ("localVec", "localBm25") if c in entries.columns}
    if "query" in entries.columns:
        short["query"] = F.substr("query", F.lit(1), F.lit(QUERY_CHARS))
    if "unmatched" in entries.columns:
        short["unmatched"] = F.slice("unmatched", 1, TERMS)
    return entries.withColumns(short)


def append(entries: DataFrame, folder: str, rows_per_file: int = 10_000) -> None:
    entries.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(folder)


def read(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Whole entries of all files by time; lines that don't parse and files that can't be read are left out."""
    kept = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(folder)
    return kept.filter("ts IS NOT NULL").orderBy("ts")


def remote_hits(body: Column, top: int = 10) -> Column:
    """Of the first results of a response those whose id is a JSON string: (id, score)."""
    items = F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>")
    hit = lambda v: F.struct(string_field(v, "id").alias("id"), F.try_variant_get(v, "$.score", "double").alias("score"))
    parsed = F.transform(F.slice(items, F.lit(1), F.lit(top)), hit)
    return F.coalesce(F.filter(parsed, lambda h: h["id"].isNotNull()), F.array().cast(f"array<{HIT}>"))


def side_rankings(entries: DataFrame) -> DataFrame:
    """(ts, strategy, id, rank) of every side that an entry has."""
    ids = lambda c: F.transform(c, lambda h: h["id"])
    sides = {"legacy": ids("local"), "remote": ids("remote"), "vec": ids("localVec"), "bm25": ids("localBm25"), "fusion": F.col("localFusion"), "dense": F.col("localDense"), "dense+rerank": F.col("localDenseRerank")}
    pairs = F.array(*[F.struct(F.lit(n).alias("strategy"), c.alias("ids")) for n, c in sides.items()])
    rows = entries.select("ts", F.explode(F.filter(pairs, lambda p: p["ids"].isNotNull())).alias("p"))
    return rows.select("ts", "p.strategy", F.posexplode("p.ids").alias("at", "id")).select("ts", "strategy", "id", (F.col("at") + 1).alias("rank"))


def remote_entries(entries: DataFrame, version: str | None = None, since: str | None = None) -> DataFrame:
    """Entries that compare with a remote answer, of a version, from a local date on."""
    out = entries.filter((F.col("mode") == "remote") & (F.size("remote") > 0))
    if version is not None:
        out = out.filter(F.col("codeVersion") == version)
    if since is not None:
        out = out.filter(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd") >= since)
    return out


def header(entries: DataFrame) -> DataFrame:
    """One row: entries, comparisons, fallbacks, versions (newest first), entries without one, first and last time."""
    compared = (F.col("mode") == "remote") & (F.coalesce(F.size("remote"), F.lit(0)) > 0)
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(compared).alias("comparisons"),
        F.count_if(F.col("mode") == "fallback").alias("fallbacks"),
        F.array_join(F.sort_array(F.collect_set("codeVersion"), False), " ").alias("versions"),
        F.count_if(F.col("codeVersion").isNull()).alias("unfingerprinted"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def summary(entries: DataFrame) -> DataFrame:
    """One row of the logged measures (mode, overlap5, overlap10, mrr): comparisons (entries of mode ``remote``), fallbacks (all
    others), and over the comparisons the means, the share in which the first five agree, and the share that finds the
    remote's first at all; each 0 without a comparison."""
    from ..operators.evaluation import mean

    compared = F.coalesce(F.col("mode") == "remote", F.lit(False))
    of = lambda c: F.round(F.coalesce(mean(F.when(compared, c)), F.lit(0.0)), 6)
    measure = lambda c: F.coalesce(F.col(c), F.lit(0))
    return entries.agg(
        F.count_if(compared).alias("comparisons"),
        F.count_if(~compared).alias("fallbacks"),
        *[of(measure(c)).alias(f"mean_{c}") for c in ("overlap5", "overlap10", "mrr")],
        of((measure("overlap5") >= 5).cast("int")).alias("perfect5_rate"),
        of((measure("mrr") > 0).cast("int")).alias("top1_recall"),
    )
