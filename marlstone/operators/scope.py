"""Scopes: which rows a request may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ingest import ENTITY_KEYS


def matches(scope: dict[str, str] | None) -> Column:
    """Each requested key must equal a present value; ``*``, empty values and unknown keys ask for nothing."""
    wanted = [(k, v) for k, v in (scope or {}).items() if k in ENTITY_KEYS and isinstance(v, str) and v not in ("", "*")]
    out = F.lit(True)
    for key, value in wanted:
        out = out & F.coalesce(F.col(key) == value, F.lit(False))
    return out


def in_scope(rows: DataFrame, scope: dict[str, str] | None) -> DataFrame:
    return rows.filter(matches(scope))


def matches_columns(row: dict[str, Column], scope: dict[str, Column]) -> Column:
    """The same rule for a join: scope columns that are null or ``*`` ask for nothing."""
    out = F.lit(True)
    for key, wanted in scope.items():
        free = wanted.isNull() | wanted.isin("", "*")
        out = out & (free | F.coalesce(row[key] == wanted, F.lit(False)))
    return out


FREE = ("", "*")


def asked(scope: list[str]) -> list[Column]:
    """The scope columns of queries, null where nothing is asked for."""
    return [F.when(~F.col(c).isin(*FREE), F.col(c).cast("string")).alias(c) for c in scope]


def visible(rows: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """``rows`` with the ``scope_id`` of every scope that may see them, once for each.

    ``scopes``: distinct (scope_id, columns of ``scope``, null where nothing is asked for). A row is seen by at most one
    scope for each choice of keys, so rows are repeated 2 ^ keys times at most, and each choice is an equality join.
    """
    out = None
    choices = scopes.select(*[F.col(c).isNotNull().alias(c) for c in scope]).distinct().collect()  # 2 ^ keys at most
    for choice in sorted(tuple(r) for r in choices):
        keys = [c for c, some in zip(scope, choice) if some]
        match = [F.col(c).isNotNull() if some else F.col(c).isNull() for c, some in zip(scope, choice)]
        own = scopes
        for m in match:
            own = own.filter(m)
        own = own.select("scope_id", *keys)
        part = rows.join(own, keys) if keys else rows.crossJoin(own)  # without keys there is one scope
        part = part.select("scope_id", *rows.columns)
        out = part if out is None else out.unionByName(part)
    return rows.withColumn("scope_id", F.lit(None).cast("string")).filter(F.lit(False)) if out is None else out


def bound(url: Column, body: Column) -> Column:
    """The scope of a request as a map: entity keys of the query string, overridden by the body's ``filters``."""
    parsed = F.try_parse_json(body)
    entries = []
    for key in ENTITY_KEYS:
        path = f"$.filters.{key}"
        own = F.when(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING", F.try_variant_get(parsed, path, "string"))
        asked = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))
        entries.append(F.struct(F.lit(key).alias("key"), F.coalesce(own, asked).alias("value")))
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "*"))
    return F.map_from_entries(kept)


def host_is(url: Column, domain: str) -> Column:
    """The host is the domain or one below it."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce((host == domain) | host.endswith(f".{domain}"), F.lit(False))


def sizes(queries: DataFrame, corpus: DataFrame, scope: list[str]) -> DataFrame:
    """(query_id, n): how many documents each query may see. The corpus is counted by its scope columns first."""
    wanted = queries.select("query_id", *asked(scope)).withColumn("scope_id", F.to_json(F.struct(*scope)))
    counted = corpus.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    seen = visible(counted, wanted.select("scope_id", *scope).distinct(), scope).groupBy("scope_id").agg(F.sum("n").alias("n"))
    return wanted.join(seen, "scope_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
