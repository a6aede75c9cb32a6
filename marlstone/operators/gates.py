"""Request gates: classification, cache freshness, the freshness window, the breaker; in batch.

A tenant's requests are worked off in order of time. State is a few numbers and the cache's keys, so the fold
streams through rows sorted by tenant and time: a tenant with very many requests needs no more memory than another.
The same step drives the stateful stream (``streaming.gate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Lifetimes in milliseconds.
TTL_MS, INTERVAL_MS, BREAKER_MS = 86_400_000, 3_600_000, 300_000
GATEABLE = ("read-search", "read-getall", "read-get")
OUTCOMES = ("hit", "gated-stale", "gated-local", "gated-none", "miss", "stale", "fallback", "error", "write", "write-local", "pass")


# The service's paths.
ONE, HISTORY = r"^/v[13]/memories/[^/]+/?$", r"^/v[13]/memories/[^/]+/history/?$"
SEARCH, ADD, LIST, ALL = r"^/v[23]/memories/search/?$", r"^/v3/memories/add/?$", r"^/v3/memories/?$", r"^/v1/memories/?$"


def classify(method: Column, path: Column) -> Column:
    """The kind of a request to the service, by method and path."""
    return (
        F.when((method == "GET") & path.rlike(HISTORY), "read-history")
        .when((method == "POST") & path.rlike(SEARCH), "read-search")
        .when((method == "POST") & path.rlike(ADD), "write-add")
        .when((method == "POST") & path.rlike(LIST), "read-getall")
        .when((method == "GET") & path.rlike(ONE), "read-get")
        .when(method.isin("PUT", "PATCH") & path.rlike(ONE), "write-update")
        .when((method == "DELETE") & path.rlike(ONE), "write-delete")
        .when((method == "DELETE") & path.rlike(ALL), "write-delete-all")
        .when(method == "GET", "read-other")
        .otherwise("other")
    )


def cache_key(method: Column, path: Column, query: Column, body: Column) -> Column:
    return F.concat(method, F.lit(" "), path, F.coalesce(query, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def without_wildcards(body: Column) -> Column:
    """A JSON body without the entity filters that are ``*``; a body without such filters, or that is no object, stays as it
    is. Every other value keeps its type, and fields keep their order."""
    from .ingest import ENTITY_KEYS

    json = lambda v: F.substr(F.to_json(F.array(v)), F.lit(2), F.length(F.to_json(F.array(v))) - 2)
    nested = lambda v: F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)")

    def written(text: Column, drop: bool = False, filters: Column | None = None) -> Column:
        """An object's text anew: scalars from their typed values, what is nested as it is written there."""
        typed, raw = F.from_json(text, "map<string,variant>"), F.from_json(text, "map<string,string>")
        entries = F.map_entries(typed) if not drop else F.filter(F.map_entries(typed), lambda e: ~star(e))
        value = lambda e: F.when(F.coalesce(nested(e["value"]), F.lit(False)), raw[e["key"]]).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null")))
        each = value if filters is None else (lambda e: F.when(e["key"] == "filters", filters).otherwise(value(e)))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json(e["key"]), F.lit(":"), each(e))), ","), F.lit("}"))

    star = lambda e: e["key"].isin(*ENTITY_KEYS) & F.coalesce((F.schema_of_variant(e["value"]) == "STRING") & (F.try_variant_get(e["value"], "$", "string") == "*"), F.lit(False))
    filters = F.from_json(body, "map<string,string>")["filters"]
    some = F.coalesce(F.exists(F.map_entries(F.from_json(filters, "map<string,variant>")), star), F.lit(False))
    return F.when(some, written(body, filters=written(filters, drop=True))).otherwise(body)


def filters_from_cache(cache: DataFrame) -> DataFrame:
    """(filters): those of the first cached request (key, seq) that lists or searches with some."""
    body = F.regexp_extract("key", r"(?s)^\S+ \S+ (.*)$", 1)
    filters = F.from_json(F.get_json_object(body, "$.filters"), "map<string,string>")
    rows = cache.filter(F.col("key").startswith("POST /v3/memories/")).select("seq", filters.alias("filters")).filter(F.size("filters") > 0)
    return rows.agg(F.min_by("filters", "seq").alias("filters"))


@dataclass
class Gate:
    """What one tenant's gate remembers."""

    last_read: int | None = None
    blocked_until: int = 0
    saved: dict[str, int] = field(default_factory=dict)


def step(gate: Gate, at: int, kind: str, key: str, status: int, retry_after: float | None, local: bool, ttl: int = TTL_MS, interval: int = INTERVAL_MS) -> str:
    """The outcome of one request, and the gate after it. ``status``: what the service would answer; ``local``:
    whether the mirror could."""
    if kind == "other":
        return "pass"
    ok = 200 <= status < 300
    if kind.startswith("write"):
        gate.saved.clear()
        return "write" if ok else "write-local"
    saved = gate.saved.get(key)
    if saved is not None and at - saved < ttl:
        return "hit"
    gated = at < gate.blocked_until or (interval > 0 and gate.last_read is not None and at - gate.last_read < interval)
    if kind in GATEABLE and gated:
        return "gated-stale" if saved is not None else "gated-local" if local else "gated-none"
    if ok:
        gate.saved[key] = at
        gate.last_read, gate.blocked_until = at, 0
        return "miss"
    if status == 429:
        gate.blocked_until = at + (int(retry_after * 1000) if retry_after is not None else BREAKER_MS)
    return "stale" if saved is not None else "fallback" if local else "error"


def folded(requests: DataFrame, ttl: int = TTL_MS, interval: int = INTERVAL_MS) -> DataFrame:
    """(tenant, seq, outcome) of requests (tenant, seq, at, kind, key, status, retry_after, local)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, gate = None, Gate()
        for pdf in frames:
            outcomes = []
            for r in pdf.itertuples():
                if r.tenant != tenant:
                    tenant, gate = r.tenant, Gate()
                retry = None if r.retry_after is None or r.retry_after != r.retry_after else float(r.retry_after)
                outcomes.append(step(gate, int(r.at), r.kind, r.key, int(r.status), retry, bool(r.local), ttl, interval))
            yield pd.DataFrame({"tenant": pdf["tenant"], "seq": pdf["seq"], "outcome": outcomes})

    rows = requests.select("tenant", "seq", "at", "kind", "key", "status", "retry_after", "local")
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", "at", "seq")
    return ordered.mapInPandas(run, "tenant long, seq long, outcome string")


def counted(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def service_stats(outcomes: DataFrame, ops: DataFrame, store: DataFrame) -> DataFrame:
    """One row: counters of outcomes, operations that wait, local rows that wait."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counters = outcomes.agg(n("hit").alias("hits"), n("miss").alias("misses"), n("stale", "gated-stale").alias("stale_served"), n("fallback", "gated-local").alias("fallbacks"), n("gated-stale", "gated-local", "gated-none").alias("gated"), n("write-local").alias("local_writes"))
    waiting = store.agg(F.count_if((F.col("source") == "local") & ~F.coalesce("deleted", F.lit(False))).alias("pending"))
    return counters.crossJoin(ops.agg(F.count(F.lit(1)).alias("ops"))).crossJoin(waiting)


def error_tally(errors: DataFrame, top: int = 4, chars: int = 60) -> DataFrame:
    """(channel, error, n): the most frequent messages, cut to a length."""
    cut = errors.select("channel", F.substr("error", F.lit(1), F.lit(chars)).alias("error"))
    return cut.groupBy("channel", "error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "channel", "error").limit(top)
