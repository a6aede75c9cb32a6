"""A paginated service as a batch source: pages are fetched on executors by an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PAGE_SIZE, PAGES = 500, 50
# Filters that would leave other applications out of a mirror.
NARROW = ("app_id", "agent_id", "run_id")
Fetch = Callable[[int, int], tuple[int, str]]


def pull(spark: SparkSession, fetch: Fetch, page_size: int = PAGE_SIZE, pages: int = PAGES) -> DataFrame:
    """(page, status, body), from page 1 until a page is short, the total is reached or a request fails.

    The stop depends on each answer, so one task reads on from page to page; the number of pages is bounded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for _ in frames:
            fetched = total = 0
            for page in range(1, pages + 1):
                status, body = fetch(page, page_size)
                yield pd.DataFrame({"page": [page], "status": [status], "body": [body]})
                if not 200 <= status < 300:
                    break
                try:
                    answer = json.loads(body)
                except ValueError:
                    break
                results = answer.get("results") if isinstance(answer, dict) else answer
                fetched += len(results) if isinstance(results, list) else 0
                count = answer.get("count") if isinstance(answer, dict) else None
                total = count if isinstance(count, (int, float)) and not isinstance(count, bool) else total
                if not isinstance(results, list) or len(results) < page_size or (total > 0 and fetched >= total):
                    break

    return spark.range(1, numPartitions=1).mapInPandas(run, "page int, status int, body string")


def pull_filters(filters: Column) -> Column:
    """The filters (a map) of a pull that is to cover every application, agent and run; null if none is known."""
    wide = F.map_filter(filters, lambda k, _: ~k.isin(*NARROW))
    return F.when(F.size(filters) > 0, wide)


def summary(pulled: DataFrame, store: DataFrame) -> DataFrame:
    """One row of a pull (page, status, body) into a store (id): pages that were answered, rows fetched, ids that the
    store did not have, the total that the service named last (0: none), and the status that ended it early (null: none)."""
    from ..operators.ingest import harvest

    ok = F.col("status").between(200, 299)
    parsed = F.try_parse_json("body")
    array = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed).otherwise(F.try_variant_get(parsed, "$.results", "variant"))
    count = F.when(ok, F.try_variant_get(parsed, "$.count", "long"))
    counts = pulled.agg(
        F.count_if(ok).alias("pages"),
        F.coalesce(F.sum(F.when(ok, F.size(F.coalesce(F.try_variant_get(array, "$", "array<variant>"), F.array().cast("array<variant>"))))), F.lit(0)).cast("long").alias("fetched"),
        F.coalesce(F.max_by(count, F.when(count.isNotNull(), F.col("page"))), F.lit(0)).alias("total"),
        F.max(F.when(~ok, F.col("status"))).alias("failed_status"),
    )
    got = harvest(pulled.filter(ok).withColumn("at", F.lit(""))).select("id").distinct()
    fresh = got.join(store.select(F.col("id").cast("string").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("new"))
    return counts.crossJoin(fresh).select("pages", "fetched", "new", "total", "failed_status")
