"""Mutations, operation logs and request gates, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import gates, mutations
from ..sources import logs
from ..sources.tables import table
from ..streaming import runs
from ..streaming.gate import gated
from . import binding


def store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """This session's copy is what has a label, the disk's copy is every document; ages, tombstones and cuts differ."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    disk = docs.select(F.col("doc_id").alias("id"), F.lit("disk").alias("side"), (F.col("n_chars") % 3).cast("long").alias("at"), (F.col("n_chars") % 5 == 0).alias("deleted"), (F.col("n_chars") > 4000).alias("overflowed"))
    mine = docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.lit("mine").alias("side"), (F.col("doc_id") % 3).alias("at"), (F.col("toxic") == 1).alias("deleted"), (F.col("n_chars") > 2000).alias("overflowed"))
    return mutations.merged(mine, disk)


def counter_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Counters per type of event and day, of two halves of the month."""
    days = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    half = lambda late: days.filter((F.dayofmonth("day") > 15) == late).groupBy(F.col("event_type").alias("name")).agg(F.max("n").alias("value"))
    return mutations.counters(half(False), half(True))


def _ops(spark: SparkSession, sf: str, kinds: dict[str, str]) -> DataFrame:
    e, t = table(spark, sf, "events"), F.col("event_type")
    rows = e.filter(t.isin(*kinds)).select(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[t].alias("kind"), F.col("user_id").alias("memory_id"), F.lit(None).cast("string").alias("query"), F.to_unix_timestamp(F.date_trunc("day", "ts")).alias("at"), F.col("event_id").alias("seq"))
    return rows.withColumn("op_key", mutations.op_key(F.col("kind"), F.col("memory_id"), F.col("query"), F.col("at")))


def op_union_minus_done(spark: SparkSession, sf: str) -> DataFrame:
    """Updates and deletes of one session, all three kinds on disk; what was clicked that day is done."""
    columns = ["op_key", "kind", "memory_id", "at"]
    mine = _ops(spark, sf, {"purchase": "update", "error": "delete"}).select(*columns).distinct()
    disk = _ops(spark, sf, {"signup": "update", "view": "delete-all"}).select(*columns).distinct()
    done = _ops(spark, sf, {"click": "update"}).select("op_key").distinct()
    return mutations.open_ops(mine, disk, done)


def tombstone_cap(spark: SparkSession, sf: str) -> DataFrame:
    done = _ops(spark, sf, {"purchase": "update"}).groupBy("op_key").agg(F.max("seq").alias("done_at"))
    return mutations.newest_done(done)


def replay_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = lambda kinds, prefix: _ops(spark, sf, kinds).select(F.col("memory_id").alias("store"), F.concat(F.lit(prefix), F.col("seq").cast("string")).alias("id"), "at", "seq")
    return mutations.replay_order(rows({"signup": "add"}, "local-"), rows({"error": "delete"}, ""))


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.lit(398) + k % 34).alias("status"))


def permanent_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _statuses(spark, sf)
    return rows.groupBy("status", mutations.permanent(F.col("status")).alias("permanent")).agg(F.count(F.lit(1)).alias("n"))


def retire_after_three(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.retired(_statuses(spark, sf))


def replay_run(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's queue of a day's requests, worked off once; the outcome of every item."""
    at = F.row_number().over(Window.partitionBy("store").orderBy("at", "seq"))
    k = F.get_json_object("props", "$.k").cast("int")
    queue = table(spark, sf, "events").select(F.col("user_id").alias("store"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.lit("op").alias("kind"), F.col("event_type").alias("id"), F.when(k < 60, 200).when(k < 99, 422).otherwise(503).alias("status"), F.lit(0).alias("failures"))
    return mutations.replay(queue.withColumn("position", at.cast("long")).drop("at", "seq"), 0).select("store", "position", "outcome")


def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Reads of four keys, kept for a day or until a write."""
    rows = binding.requests(spark, sf).withColumns({"status": F.lit(200), "kind": F.when(F.col("key") == "purchase", "write-update").otherwise("read-other")})
    out = gates.folded(rows, interval=0)
    return out.filter("outcome <> 'write'").select("tenant", "seq", (F.col("outcome") == "hit").alias("hit"))


def _fresh(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"status": F.lit(200), "kind": F.lit("read-search")})


def freshness_gate(spark: SparkSession, sf: str) -> DataFrame:
    """At most one read an hour goes to the service."""
    out = gates.folded(_fresh(binding.requests(spark, sf)), ttl=0)
    return out.select("tenant", "seq", (F.col("outcome") == "miss").alias("open"))


def breaker_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A full service says when to come back; until then nothing goes out."""
    retry = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("value") * 1000).alias("retry_after"))
    rows = binding.requests(spark, sf).drop("retry_after").join(retry, "seq").withColumn("kind", F.lit("read-search"))
    out = gates.folded(rows, ttl=0, interval=0)
    return out.select("tenant", "seq", F.col("outcome").startswith("gated").alias("gated"))


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gates.counted(gates.folded(_fresh(binding.requests(spark, sf)), ttl=0))


def gate_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole state machine: cache, breaker, freshness, fallbacks, writes."""
    return gates.folded(binding.requests(spark, sf))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    rows = binding.memories(spark, sf)
    return rows.select(F.col("id").cast("string").alias("id"), "memory", F.lit("0").alias("created_at"), F.lit("0").alias("updated_at"), "deleted", "source", "app_id")


def _writes(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases update the document of the event's number, errors delete it."""
    e, t = table(spark, sf, "events").filter("event_type IN ('purchase', 'error')"), F.col("event_type")
    return e.select(F.when(t == "error", "delete").otherwise("update").alias("kind"), F.col("event_id").cast("string").alias("memory_id"), F.col("props").alias("text"), F.lit(None).cast("string").alias("app_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


def offline_writes(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.written(_store(spark, sf), _writes(spark, sf)).select("id", F.md5("memory").alias("memory_md5"), "updated_at", "deleted", "source")


def remote_echo(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.echoed(_store(spark, sf), _writes(spark, sf)).select("id", F.md5("memory").alias("memory_md5"), "updated_at", "deleted", "source")


def replay_effects(spark: SparkSession, sf: str) -> DataFrame:
    t, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    kind = F.when(t == "signup", "add").when(t == "error", "delete").otherwise("update")
    done = table(spark, sf, "events").select(kind.alias("kind"), F.col("event_id").cast("string").alias("id"), F.when(k < 50, 200).otherwise(404).alias("status"))
    return mutations.replayed(_store(spark, sf), done, "now").select("id", "updated_at", "source", "deleted")


def report_header(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log entries: what was viewed was compared, errors fell back."""
    t = F.col("event_type")
    hit = F.array(F.struct(F.lit("1").alias("id"), F.lit(1.0).alias("score")))
    entries = table(spark, sf, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.when(t == "error", "fallback").otherwise("remote").alias("mode"),
        F.when(t == "view", hit).otherwise(F.array().cast("array<struct<id:string,score:double>>")).alias("remote"), F.when(t != "click", t).alias("codeVersion"),
    )
    return logs.header(entries)


def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Events as log entries with measures of their own; errors fell back."""
    n = F.col("event_id")
    entries = table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "fallback").otherwise("remote").alias("mode"), (F.col("user_id") % 6).alias("overlap5"), (n % 11).alias("overlap10"),
        F.when(n % 5 > 0, 1 / (n % 5)).otherwise(0.0).alias("mrr"),
    )
    return logs.summary(entries)


def error_tally(spark: SparkSession, sf: str) -> DataFrame:
    errors = table(spark, sf, "events").filter("event_type = 'error'").select(F.lit("dense").alias("channel"), F.col("props").alias("error"))
    return gates.error_tally(errors)


def service_stats(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = gates.folded(_fresh(binding.requests(spark, sf)), ttl=0)
    return gates.service_stats(outcomes, op_union_minus_done(spark, sf), binding.memories(spark, sf))


def stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The freshness gate as a stateful stream."""
    events = runs.source(spark, sf, "events")
    rows = events.select(
        F.col("user_id").alias("tenant"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit("read-search").alias("kind"),
        F.col("event_type").alias("key"), F.lit(200).alias("status"), F.lit(None).cast("double").alias("retry_after"), F.lit(True).alias("local"),
    )
    return runs.drained(gated(rows, ttl=0)).select("tenant", "seq", (F.col("outcome") == "miss").alias("open"))


def stream_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events per day and type in tumbling windows, as a stream in complete mode."""
    events = runs.source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = runs.drained(runs.windowed_counts(events, "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        store_merge, counter_merge, op_union_minus_done, tombstone_cap, replay_order, permanent_status, retire_after_three, replay_run,
        cache_hits, freshness_gate, breaker_windows, outcome_counts, gate_outcomes, error_tally, service_stats, offline_writes, remote_echo, replay_effects, report_header, log_summary, stream_gate, stream_outcome_counts,
    )
}

_OPS = """(SELECT CASE event_type {kinds} END AS kind, user_id AS memory_id, epoch(date_trunc('day', ts))::BIGINT AS "at", event_id AS seq FROM events WHERE event_type IN ({types}))"""


def _ops_sql(kinds: dict[str, str]) -> str:
    return _OPS.format(kinds=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()), types=", ".join(f"'{k}'" for k in kinds))


_KEY = """kind || '|' || memory_id || '||' || "at" """
_AT = "(epoch_us(ts) // 1000)"
_OPEN = f"""numbered AS (SELECT user_id AS tenant, event_id AS seq, {_AT} AS "at", row_number() OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS n FROM events),
    opened AS (SELECT tenant, seq, n, "at" AS last, true AS open FROM numbered WHERE n = 1 UNION ALL
        SELECT b.tenant, b.seq, b.n, CASE WHEN b."at" - a.last >= 3600000 THEN b."at" ELSE a.last END, b."at" - a.last >= 3600000
        FROM opened a JOIN numbered b ON b.tenant = a.tenant AND b.n = a.n + 1)"""
_STATUS = """(SELECT user_id AS id, epoch_us(ts) AS "at", event_id AS seq, (398 + (props::JSON->>'$.k')::INTEGER % 34)::INTEGER AS status FROM events)"""
_PERMANENT = "(status BETWEEN 400 AND 499 AND status NOT IN (401, 403, 404, 408, 429))"
_PICK = """CASE WHEN d.id IS NULL THEN true WHEN m.id IS NULL THEN false WHEN m.overflowed AND NOT d.overflowed THEN true
    WHEN m.deleted AND NOT d.deleted AND m."at" >= d."at" THEN true WHEN d.deleted AND NOT m.deleted THEN false
    WHEN m."at" > d."at" THEN true WHEN m."at" < d."at" THEN false ELSE m.deleted END"""
_WRITES = """SELECT event_id::VARCHAR AS id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'update' END AS kind, props AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t
    FROM events WHERE event_type IN ('purchase', 'error')"""
ORACLE_SQL = {
    "store_merge": f"""WITH d AS (SELECT doc_id AS id, 'disk' AS side, (n_chars % 3)::BIGINT AS "at", n_chars % 5 = 0 AS deleted, n_chars > 4000 AS overflowed FROM documents),
        m AS (SELECT d.doc_id AS id, 'mine' AS side, d.doc_id % 3 AS "at", toxic = 1 AS deleted, n_chars > 2000 AS overflowed FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
        b AS (SELECT {_PICK} AS mine, d, m FROM m FULL JOIN d ON m.id = d.id)
        SELECT CASE WHEN mine THEN m.id ELSE d.id END AS id, CASE WHEN mine THEN m.side ELSE d.side END AS side, CASE WHEN mine THEN m."at" ELSE d."at" END AS "at",
            CASE WHEN mine THEN m.deleted ELSE d.deleted END AS deleted, CASE WHEN mine THEN m.overflowed ELSE d.overflowed END AS overflowed FROM b""",
    "counter_merge": "SELECT event_type AS name, max(n) AS value FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
    "op_union_minus_done": f"""WITH both_ AS (SELECT DISTINCT {_KEY} AS op_key, kind, memory_id, "at" FROM (SELECT * FROM {_ops_sql({"purchase": "update", "error": "delete"})} UNION ALL SELECT * FROM {_ops_sql({"signup": "update", "view": "delete-all"})}))
        SELECT * FROM both_ WHERE op_key NOT IN (SELECT {_KEY} FROM {_ops_sql({"click": "update"})})""",
    "tombstone_cap": f"SELECT {_KEY} AS op_key, max(seq) AS done_at FROM {_ops_sql({'purchase': 'update'})} GROUP BY 1 ORDER BY done_at DESC, op_key LIMIT 500",
    "replay_order": f"""WITH q AS (SELECT memory_id AS store, 'add' AS kind, 'local-' || seq AS id, "at", seq FROM {_ops_sql({"signup": "add"})} UNION ALL SELECT memory_id, 'op', seq::VARCHAR, "at", seq FROM {_ops_sql({"error": "delete"})})
        SELECT store, kind, id, "at", row_number() OVER (PARTITION BY store ORDER BY "at", kind, seq, id)::INTEGER AS position FROM q""",
    "permanent_status": f"SELECT status, {_PERMANENT} AS permanent, count(*) AS n FROM {_STATUS} GROUP BY ALL",
    "retire_after_three": f"""SELECT id, "at" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at", seq) AS n FROM {_STATUS} WHERE {_PERMANENT}) WHERE n = 3""",
    "replay_run": """WITH q AS (SELECT user_id AS store, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, event_type AS id, (props::JSON->>'$.k')::INTEGER AS k FROM events),
        s AS (SELECT *, min(CASE WHEN k >= 99 THEN position END) OVER (PARTITION BY store) AS stop,
            sum(CASE WHEN k BETWEEN 60 AND 98 THEN 1 ELSE 0 END) OVER (PARTITION BY store, id ORDER BY position) AS fails FROM q)
        SELECT store, position, CASE WHEN position > stop THEN 'waiting' WHEN position = stop THEN 'backoff' WHEN k < 60 THEN 'applied' WHEN fails >= 3 THEN 'retired' ELSE 'failed' END AS outcome FROM s""",
    "cache_hits": f"""WITH RECURSIVE o AS (SELECT user_id AS tenant, event_id AS seq, {_AT} AS "at", event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS pos FROM events),
        w AS (SELECT *, max(CASE WHEN key = 'purchase' THEN pos END) OVER (PARTITION BY tenant ORDER BY pos) AS wrote FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY tenant, key ORDER BY pos) AS n FROM w WHERE key <> 'purchase'),
        f AS (SELECT tenant, key, seq, n, "at" AS saved, pos AS saved_pos, false AS hit FROM r WHERE n = 1 UNION ALL
            SELECT b.tenant, b.key, b.seq, b.n, CASE WHEN b."at" - a.saved < 86400000 AND coalesce(b.wrote, 0) < a.saved_pos THEN a.saved ELSE b."at" END,
                CASE WHEN b."at" - a.saved < 86400000 AND coalesce(b.wrote, 0) < a.saved_pos THEN a.saved_pos ELSE b.pos END,
                b."at" - a.saved < 86400000 AND coalesce(b.wrote, 0) < a.saved_pos
            FROM f a JOIN r b ON b.tenant = a.tenant AND b.key = a.key AND b.n = a.n + 1)
        SELECT tenant, seq, hit FROM f""",
    "freshness_gate": f"WITH RECURSIVE {_OPEN} SELECT tenant, seq, open FROM opened",
    "breaker_windows": f"""WITH RECURSIVE numbered AS (SELECT user_id AS tenant, event_id AS seq, {_AT} AS "at", event_type = 'error' AS bad, floor(value * 1000 * 1000)::BIGINT AS wait,
            row_number() OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS n FROM events),
        f AS (SELECT tenant, seq, n, CASE WHEN bad THEN "at" + wait ELSE 0 END AS until_, false AS gated FROM numbered WHERE n = 1 UNION ALL
            SELECT b.tenant, b.seq, b.n, CASE WHEN b."at" < a.until_ THEN a.until_ WHEN b.bad THEN b."at" + b.wait ELSE 0 END, b."at" < a.until_
            FROM f a JOIN numbered b ON b.tenant = a.tenant AND b.n = a.n + 1)
        SELECT tenant, seq, gated FROM f""",
    "outcome_counts": f"""WITH RECURSIVE {_OPEN}, k AS (SELECT o.*, e.event_type AS key FROM opened o JOIN events e ON e.event_id = o.seq),
        s AS (SELECT *, coalesce(bool_or(open) OVER (PARTITION BY tenant, key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM k)
        SELECT CASE WHEN open THEN 'miss' WHEN known THEN 'gated-stale' ELSE 'gated-local' END AS outcome, count(*) AS n FROM s GROUP BY 1""",
    "service_stats": f"""WITH RECURSIVE {_OPEN}, k AS (SELECT o.*, e.event_type AS key FROM opened o JOIN events e ON e.event_id = o.seq),
        s AS (SELECT *, coalesce(bool_or(open) OVER (PARTITION BY tenant, key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM k)
        SELECT 0::BIGINT AS hits, count(*) FILTER (open) AS misses, count(*) FILTER (NOT open AND known) AS stale_served, count(*) FILTER (NOT open AND NOT known) AS fallbacks, count(*) FILTER (NOT open) AS gated,
            0::BIGINT AS local_writes, (SELECT count(DISTINCT {_KEY}) FROM (SELECT * FROM {_ops_sql({"purchase": "update", "error": "delete"})} UNION ALL SELECT * FROM {_ops_sql({"signup": "update", "view": "delete-all"})})
                WHERE {_KEY} NOT IN (SELECT {_KEY} FROM {_ops_sql({"click": "update"})})) AS ops,
            (SELECT count(*) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND toxic = 0) AS pending FROM s""",
    "offline_writes": f"""WITH {binding.MEMORIES}, w AS ({_WRITES}) SELECT coalesce(m.id::VARCHAR, w.id) AS id,
        md5(CASE WHEN w.kind = 'update' THEN w.text ELSE m.memory END) AS memory_md5, coalesce(w.t, '0') AS updated_at,
        CASE WHEN w.kind = 'delete' THEN true WHEN m.id IS NULL THEN false ELSE m.deleted END AS deleted, coalesce(m.source, 'local') AS source
        FROM memories m FULL JOIN w ON w.id = m.id::VARCHAR WHERE m.id IS NOT NULL OR w.kind = 'update'""",
    "remote_echo": f"""WITH {binding.MEMORIES}, w AS ({_WRITES}) SELECT coalesce(m.id::VARCHAR, w.id) AS id,
        md5(CASE WHEN w.kind = 'update' THEN w.text ELSE m.memory END) AS memory_md5, CASE WHEN w.kind = 'update' THEN w.t ELSE '0' END AS updated_at,
        CASE WHEN w.kind = 'delete' THEN true WHEN m.id IS NULL THEN false ELSE m.deleted END AS deleted, coalesce(m.source, 'observed') AS source
        FROM memories m FULL JOIN w ON w.id = m.id::VARCHAR WHERE m.id IS NOT NULL OR w.kind = 'update'""",
    "replay_effects": f"""WITH {binding.MEMORIES}, d AS (SELECT event_id AS id, event_type AS t, (props::JSON->>'$.k')::INTEGER AS k FROM events)
        SELECT m.id::VARCHAR AS id, CASE WHEN t = 'signup' THEN 'now' ELSE '0' END AS updated_at, CASE WHEN t = 'signup' THEN 'observed' ELSE m.source END AS source, m.deleted
        FROM memories m LEFT JOIN d ON d.id = m.id WHERE NOT coalesce(t = 'error' OR (t IN ('view', 'click', 'purchase') AND k >= 50), false)""",
    "report_header": f"""SELECT count(*) AS entries, count(*) FILTER (event_type = 'view') AS comparisons, count(*) FILTER (event_type = 'error') AS fallbacks,
        'view signup purchase error' AS versions, count(*) FILTER (event_type = 'click') AS unfingerprinted, min({_AT}) AS first_ts, max({_AT}) AS last_ts FROM events""",
    "log_summary": """WITH e AS (SELECT event_type <> 'error' AS compared, user_id % 6 AS five, event_id % 11 AS ten, CASE WHEN event_id % 5 > 0 THEN 1.0::DOUBLE / (event_id % 5) ELSE 0 END AS mrr FROM events)
        SELECT count(*) FILTER (compared) AS comparisons, count(*) FILTER (NOT compared) AS fallbacks, round(sum(five) FILTER (compared) / count(*) FILTER (compared), 6) AS mean_overlap5,
            round(sum(ten) FILTER (compared) / count(*) FILTER (compared), 6) AS mean_overlap10, round((sum(mrr::DECIMAL(30, 12)) FILTER (compared))::DOUBLE / count(*) FILTER (compared), 6) AS mean_mrr,
            round(count(*) FILTER (compared AND five >= 5) / count(*) FILTER (compared), 6) AS perfect5_rate, round(count(*) FILTER (compared AND mrr > 0) / count(*) FILTER (compared), 6) AS top1_recall FROM e""",
    "error_tally": "SELECT 'dense' AS channel, substr(props, 1, 60) AS error, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL ORDER BY n DESC, error LIMIT 4",
    "gate_outcomes": f"""WITH RECURSIVE r AS (SELECT user_id AS tenant, event_id AS seq, {_AT} AS "at", event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY {_AT}, event_id) AS n FROM events),
        g AS (  -- of each tenant's requests in turn: the outcome, and what the gate remembers after it
            SELECT DISTINCT tenant, 0::BIGINT AS seq, 0::BIGINT AS n, NULL::BIGINT AS last, 0::BIGINT AS blocked, MAP([]::VARCHAR[], []::BIGINT[]) AS saved, '' AS outcome FROM r
            UNION ALL
            SELECT tenant, seq, n, CASE WHEN outcome = 'miss' THEN "at" ELSE last END, CASE WHEN outcome = 'miss' THEN 0 WHEN outcome IN ('stale', 'fallback') THEN "at" + 300000 ELSE blocked END,
                CASE WHEN outcome = 'write' THEN MAP([]::VARCHAR[], []::BIGINT[]) WHEN outcome = 'miss' THEN map_concat(saved, MAP([key], ["at"])) ELSE saved END, outcome
            FROM (SELECT *, CASE WHEN key = 'purchase' THEN 'write' WHEN "at" - was < 86400000 THEN 'hit'
                    WHEN "at" < blocked OR "at" - last < 3600000 THEN CASE WHEN was IS NULL THEN 'gated-local' ELSE 'gated-stale' END
                    WHEN key <> 'error' THEN 'miss' WHEN was IS NULL THEN 'fallback' ELSE 'stale' END AS outcome
                FROM (SELECT r.*, g.last, g.blocked, g.saved, g.saved[r.key] AS was FROM g JOIN r ON r.tenant = g.tenant AND r.n = g.n + 1)))
        SELECT tenant, seq, outcome FROM g WHERE n > 0""",
    "stream_gate": f"WITH RECURSIVE {_OPEN} SELECT tenant, seq, open FROM opened",
    "stream_outcome_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
