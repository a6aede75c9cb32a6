"""The store's files, logs, request keys and pending writes."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import gates, gold, ingest, mutations
from ..sources import buckets, logs, pages, providers, tables
from ..sources.tables import table, written
from ..streaming import runs
from . import binding


def _folder(spark: SparkSession) -> str:
    return runs.folder(spark)


def store_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a store are saved; what is loaded is the second."""
    at = _folder(spark)
    rows = binding.memories(spark, sf)
    tables.save(rows.filter("deleted"), at)
    tables.save(rows.filter("NOT deleted"), at)
    return tables.load(spark, at, "id long, memory string, user_id string, app_id string, deleted boolean, source string").select("id", "user_id", "app_id", "source", F.md5("memory").alias("memory_md5"))


def store_saved_by_two(spark: SparkSession, sf: str) -> DataFrame:
    """Two sessions save one after the other what each has cut or deleted; the second save merges with the first."""
    at, docs = _folder(spark), table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3).cast("long").alias("at"), (F.col("n_chars") % 5 == 0).alias("deleted"), (F.col("n_chars") > 4000).alias("overflowed"))
    schema = "id long, at long, deleted boolean, overflowed boolean"
    tables.save_merged(rows.filter("id % 3 > 0"), at, mutations.merged, schema)
    tables.save_merged(rows.filter("id % 3 < 2").withColumns({"at": F.col("id") % 3, "overflowed": F.lit(False)}), at, mutations.merged, schema)
    return tables.load(spark, at, schema)


def store_saved_by_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The same two sessions on a store in buckets, and a third that saves what is there already in a few of them."""
    at, docs = _folder(spark), table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3).cast("long").alias("at"), (F.col("n_chars") % 5 == 0).alias("deleted"), (F.col("n_chars") > 4000).alias("overflowed"))
    schema = "id long, at long, deleted boolean, overflowed boolean"
    buckets.save(rows.filter("id % 3 > 0"), at, mutations.merged, schema, buckets=32)
    buckets.save(rows.filter("id % 3 < 2").withColumns({"at": F.col("id") % 3, "overflowed": F.lit(False)}), at, mutations.merged, schema)
    buckets.save(buckets.load(spark, at, schema).orderBy("id").limit(3), at, mutations.merged, schema)
    buckets.drop_old(spark, at)
    return buckets.load(spark, at, schema)


def state_merge(spark: SparkSession, sf: str) -> DataFrame:
    """What a session counted, failed and finished on even days, merged with the odd days' copy on disk."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    late = (F.dayofmonth("ts") % 2 == 0).alias("own")
    n, last, user = F.count(F.lit(1)).alias("value"), F.max("event_id").alias("value"), F.col("user_id").cast("string").alias("key")
    parts = {
        "stats": e.filter((t != "signup") | (F.dayofmonth("ts") % 2 == 1)).groupBy(late, t.alias("key")).agg(n),
        "failures": e.filter(t == "error").groupBy(late, user).agg(n),
        "quarantined": e.filter(t == "signup").groupBy(late, user).agg(last),
        "done": e.filter(t == "purchase").groupBy(late, F.concat(F.lit("op"), F.floor(F.col("event_id") / 2).cast("string")).alias("key")).agg(last),
        "reads_blocked_until": e.filter(t == "error").groupBy(late, F.lit("").alias("key")).agg(last),
    }
    rows = reduce(DataFrame.unionByName, [df.withColumn("part", F.lit(name)) for name, df in parts.items()])
    return mutations.merged_state(rows.filter("own"), rows.filter("NOT own"))


def store_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as a session takes them up: long texts cut, recorded and as new as the session."""
    rows = binding.memories(spark, sf).withColumns({"overflow": F.lit(None).cast("struct<originalChars:bigint,truncatedAt:bigint>"), "updated_at": F.lit("2024-01-01")})
    return mutations.loaded(rows, "2024-05-01").select("id", F.md5("memory").alias("memory_md5"), "updated_at", F.col("overflow.originalChars").alias("original_chars"))


def ops_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of a file without those that a good label says are done."""
    ops = table(spark, sf, "documents").select(mutations.op_key(F.lit("update"), F.col("doc_id"), F.lit(None), F.col("n_chars")).alias("op_key"), F.col("doc_id").alias("memory_id"), "n_chars")
    done = ops.join(table(spark, sf, "labels").filter("quality = 1"), F.col("memory_id") == F.col("doc_id"), "left_semi")
    return mutations.without_done(ops, done).select("op_key", "memory_id")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as comparisons: views have a remote answer of one or two hits, purchases a fused ranking."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    hit = lambda c, s: F.struct(c.cast("string").alias("id"), F.lit(s).alias("score"))
    two = F.array(hit(F.col("user_id"), 0.5), hit(F.col("event_id"), 0.25))
    return e.select(
        F.col("event_id").alias("ts"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))).alias("codeVersion"),
        F.when(t.isin("view", "click"), "remote").otherwise("fallback").alias("mode"),
        t.alias("query"),
        F.when(t == "view", two).when(t == "click", F.slice(two, 1, 0)).alias("remote"),
        F.when(t == "purchase", F.array(F.concat(F.lit("m"), F.col("user_id").cast("string")), F.col("event_id").cast("string"))).alias("localFusion"),
    )


def _log(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    logs.append(_entries(spark, sf), at)
    return logs.read(spark, at)


def log_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Every ranking of a log that was written and read again."""
    return logs.side_rankings(_log(spark, sf))


def log_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The comparisons of one version that have a remote answer."""
    return logs.remote_entries(_log(spark, sf), "v1").select("ts", "codeVersion", F.size("remote").alias("hits"))


def log_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as the queries of entries, with long lists of hits and terms, as the log keeps them."""
    hits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.struct((F.col("conv_id") + i).cast("string").alias("id"), (F.col("conv_id") / (i + 6)).alias("score")))
    terms = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"), hits.alias("localBm25"), terms.alias("unmatched"))
    kept = logs.compacted(turns)
    return kept.select("conv_id", "turn", F.md5("query").alias("query_md5"), F.size("localBm25").alias("hits"), F.col("localBm25")[9]["score"].alias("last_score"), F.array_join("unmatched", " ").alias("unmatched"))


def remote_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The first hits of response bodies, in which some ids are numbers."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    item = lambda i, s: F.concat(F.lit('{"id":'), i, F.lit(f',"score":{s}}}'))
    quoted = F.concat(F.lit('"m'), F.col("user_id").cast("string"), F.lit('"'))
    number = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"')))
    body = F.concat(F.lit('{"results":['), item(quoted, 0.75), F.lit(","), item(number, 0.5), F.lit("]}"))
    rows = e.select("event_id", F.posexplode(logs.remote_hits(body)).alias("at", "hit"))
    return rows.select("event_id", F.col("at").cast("int").alias("at"), "hit.id", "hit.score")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls of the service: (event_id, method, path, query, body)."""
    e, t = table(spark, sf, "events"), F.col("event_type")
    one = F.concat(F.lit("/v1/memories/"), F.col("user_id").cast("string"), F.lit("/"))
    path = F.when(t == "view", "/v3/memories/search/").when(t == "click", one).when(t == "signup", "/v3/memories/").when(t == "error", F.concat(one, F.lit("history/"))).otherwise(one)
    method = F.when(t.isin("view", "signup"), "POST").when(t == "purchase", "DELETE").otherwise("GET")
    user = F.when(F.col("user_id") % 2 == 0, "*").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    body = F.concat(F.lit('{"filters":{"user_id":"'), user, F.lit('","app_id":"web"},"limit":5}'))
    return e.select("event_id", method.alias("method"), path.alias("path"), F.when(t == "click", F.lit("?x=1")).alias("query"), F.when(method == "POST", body).alias("body"))


def gateable_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of each call, and whether the gate may answer it."""
    kind = gates.classify(F.col("method"), F.col("path"))
    return _requests(spark, sf).select("event_id", kind.alias("kind"), kind.isin(*gates.GATEABLE).alias("gateable"))


def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys of calls whose bodies have lost their wildcards."""
    clean = _requests(spark, sf).withColumn("body", gates.without_wildcards(F.col("body")))
    return clean.select("event_id", gates.cache_key(F.col("method"), F.col("path"), F.col("query"), F.col("body")).alias("key"))


def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies whose filters hold digits, truth values, nulls and lists, beside the wildcards that go, with quotes in keys."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    body = F.concat(
        F.lit('{"query":"['), "source", F.lit('] say \\"hi\\"","filters":{"user_id":"'), F.col("doc_id").cast("string"), F.lit('","app_id":"*","run_id":"'), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("*"),
        F.lit('","n":'), F.col("doc_id").cast("string"), F.lit(',"flag":true,"none":null,"list":[1,"*"],"b":{"z":1,"a":"*"}},"top_k":5,"rerank":false,"k\\"ey":"{'), F.coalesce("lang", F.lit("")), F.lit('}"}'),
    )
    return d.select("doc_id", gates.without_wildcards(body).alias("body"))


def harvest_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that list each document twice: a store keeps the last."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.floor(F.col("doc_id") / 50).alias("page"), "source")
    item = lambda suffix, at: F.struct(F.col("id").alias("id"), F.concat("source", F.lit(suffix)).alias("memory"), F.lit(at).alias("order"))
    twice = d.select("page", F.explode(F.array(item(" one", 0), item(" two", 1))).alias("item"))
    bodies = twice.groupBy("page").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("item.order", "item.id", "item.memory"))).alias("results"))).alias("body"))
    return ingest.harvest(bodies.withColumn("at", F.lit("now"))).select("id", "memory", "updated_at")


def filters_of_cache(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _requests(spark, sf).withColumn("body", gates.without_wildcards(F.col("body")))
    cache = keyed.select(F.col("event_id").alias("seq"), gates.cache_key(F.col("method"), F.col("path"), F.col("query"), F.col("body")).alias("key"))
    return gates.filters_from_cache(cache).select(F.col("filters")["user_id"].alias("user_id"), F.col("filters")["app_id"].alias("app_id"))


def offline_adds(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as offline adds, every fifth of them for all users."""
    c = table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.when(t["role"] == "user", t["text"]).alias("content")))
    user = F.when(F.col("conv_id") % 5 == 0, "*").otherwise(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")))
    writes = turns.select("conv_id", messages.alias("messages"), F.create_map(F.lit("user_id"), user, F.lit("app_id"), F.lit("chat")).alias("scope"), F.lit("2024-05-01T00:00:00Z").alias("at"))
    rows = mutations.added(writes, F.concat(F.lit("local-"), F.col("conv_id").cast("string")))
    return rows.select("id", F.md5("memory").alias("memory_md5"), "source", F.col("add_payload")["user_id"].alias("user_id"), F.size("add_payload").alias("keys"))


def pending_adds(spark: SparkSession, sf: str) -> DataFrame:
    """Local rows that are live and not too long for the service."""
    rows = binding.memories(spark, sf)
    return mutations.pending_adds(rows, rows.filter(F.char_length("memory") > 2000).select("id")).select("id", "user_id")


def purged_rows(spark: SparkSession, sf: str) -> DataFrame:
    return mutations.purged(binding.memories(spark, sf)).select("id", "deleted", "source")


def replay_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Pending adds without a scope get that of the store's first observed row."""
    rows = binding.memories(spark, sf).select("id", "user_id", "app_id", "source", F.lit(None).cast("string").alias("agent_id"), F.lit("").alias("run_id"), F.col("id").alias("seq"))
    payload = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("text"), F.lit("x"))).otherwise(F.create_map(F.lit("text"), F.lit("x"), F.lit("user_id"), F.col("user_id")))
    adds = rows.filter("source = 'local'").select("id", payload.alias("add_payload"))
    found = mutations.with_scope(adds, rows)
    return found.select("id", F.col("add_payload")["user_id"].alias("user_id"), F.col("add_payload")["app_id"].alias("app_id"), F.size("add_payload").alias("keys"))


def reconciled_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Operations on documents of whom those of good quality were confirmed."""
    ops = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("source").alias("kind"))
    confirmed = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id"))
    return mutations.reconciled(ops, confirmed)


def embedding_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of an embedding service, one for each part, items in no order of their index: some refused, some torn."""
    parts = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 4).alias("answer"), (F.col("p_partkey") % 4).cast("int").alias("at"))
    vec = F.array(F.col("p_partkey").cast("double"), F.col("at").cast("double"))
    items = parts.select("answer", F.struct((-F.col("at")).alias("order"), F.col("at").alias("index"), F.when((F.col("answer") % 7 != 0) | (F.col("at") != 1), vec).alias("embedding")).alias("item"))
    bodies = items.groupBy("answer").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias("data"))).alias("body"))
    rows = bodies.select("answer", F.when(F.col("answer") % 5 == 0, 429).otherwise(200).alias("status"), F.when(F.col("answer") % 5 == 0, F.lit("")).otherwise(F.col("body")).alias("body"))
    vectors = providers.vectors_of(F.col("body"))
    return rows.select("answer", providers.error_of("embedder", F.col("status"), F.col("body")).alias("error"), F.size(vectors).alias("vectors"), F.element_at(vectors, -1)[0].alias("last"))


def _serve(page: int, size: int) -> tuple[int, str]:
    """A service with 130 rows, of which one in ten has no text."""
    rows = [{"id": str(n)} | ({"memory": f"row {n}"} if n % 10 else {}) for n in range((page - 1) * size, min(page * size, 130))]
    return 200, json.dumps({"results": rows, "count": 130})


def pull_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A whole pull in pages of 20 into a store of every third document."""
    store = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return pages.summary(written(pages.pull(spark, _serve, 20), "pulled"), store)


def pull_filters(spark: SparkSession, sf: str) -> DataFrame:
    """What a mirror of all applications asks for, from the filters of each row's own read."""
    wide = pages.pull_filters(F.create_map(F.lit("user_id"), F.col("user_id"), F.lit("app_id"), F.col("app_id")))
    return binding.memories(spark, sf).select("id", wide["user_id"].alias("user_id"), wide["app_id"].alias("app_id"), F.size(wide).alias("keys"))


def pool_of_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The pool of each logged comparison: what any of its sides ranked, if it is live."""
    sides = logs.side_rankings(_log(spark, sf)).select(F.col("ts").alias("query_id"), F.expr("try_cast(id AS BIGINT)").alias("doc_id"), "rank")
    return gold.pool(sides, ingest.live(binding.memories(spark, sf)).select(F.col("id").alias("doc_id")))


QUERIES = {
    f.__name__: f
    for f in (
        store_roundtrip, log_sides, log_filters, log_compacted, remote_hits, gateable_requests, request_keys, request_bodies, harvest_repeats, filters_of_cache, offline_adds, pending_adds,
        purged_rows, replay_scopes, reconciled_ops, store_saved_by_two, store_saved_by_buckets, state_merge, store_loaded, ops_loaded,
        embedding_responses, pool_of_sides, pull_summary, pull_filters,
    )
}

_CALLS = """calls AS (SELECT event_id, user_id, event_type AS t, '/v1/memories/' || user_id || '/' AS one FROM events),
    asked AS (SELECT event_id, t, CASE t WHEN 'view' THEN '/v3/memories/search/' WHEN 'signup' THEN '/v3/memories/' WHEN 'error' THEN one || 'history/' ELSE one END AS path,
        CASE WHEN t IN ('view', 'signup') THEN 'POST' WHEN t = 'purchase' THEN 'DELETE' ELSE 'GET' END AS method, CASE WHEN t = 'click' THEN '?x=1' ELSE '' END AS query,
        CASE WHEN t NOT IN ('view', 'signup') THEN '' WHEN user_id % 2 = 0 THEN '{"filters":{"app_id":"web"},"limit":5}'
            ELSE '{"filters":{"user_id":"u' || user_id || '","app_id":"web"},"limit":5}' END AS body, user_id FROM calls)"""
ORACLE_SQL = {
    "store_roundtrip": f"WITH {binding.MEMORIES} SELECT id, user_id, app_id, source, md5(memory) AS memory_md5 FROM memories WHERE NOT deleted",
    "log_sides": """SELECT event_id AS ts, 'remote' AS strategy, user_id::VARCHAR AS id, 1 AS rank FROM events WHERE event_type = 'view'
        UNION ALL SELECT event_id, 'remote', event_id::VARCHAR, 2 FROM events WHERE event_type = 'view'
        UNION ALL SELECT event_id, 'fusion', 'm' || user_id, 1 FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT event_id, 'fusion', event_id::VARCHAR, 2 FROM events WHERE event_type = 'purchase'""",
    "log_filters": """SELECT event_id AS ts, 'v1' AS codeVersion, 2 AS hits FROM events WHERE event_type = 'view' AND user_id % 3 = 1""",
    "log_compacted": """SELECT conv_id, turn, md5(substr(text, 1, 200)) AS query_md5, 10 AS hits, round(conv_id / 16, 4) AS last_score,
        't1 t2 t3 t4 t5 t6 t7 t8 t9 t10' AS unmatched FROM conversations""",
    "remote_hits": """SELECT event_id, 0 AS at, 'm' || user_id AS id, 0.75::DOUBLE AS score FROM events
        UNION ALL SELECT event_id, 1, event_id::VARCHAR, 0.5 FROM events WHERE event_id % 2 <> 0""",
    "gateable_requests": """SELECT event_id, k AS kind, k IN ('read-search', 'read-getall', 'read-get') AS gateable
        FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'read-search' WHEN 'click' THEN 'read-get' WHEN 'signup' THEN 'read-getall' WHEN 'error' THEN 'read-history' ELSE 'write-delete' END AS k FROM events)""",
    "request_keys": f"WITH {_CALLS} SELECT event_id, method || ' ' || path || query || ' ' || body AS key FROM asked",
    "request_bodies": """SELECT doc_id, '{"query":"[' || source || '] say \\"hi\\"","filters":{"user_id":"' || doc_id || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"run_id":"true"' ELSE '' END || ',"n":' || doc_id
            || ',"flag":true,"none":null,"list":[1,"*"],"b":{"z":1,"a":"*"}},"top_k":5,"rerank":false,"k\\"ey":"{' || coalesce(lang, '') || '}"}' AS body FROM documents""",
    "harvest_repeats": "SELECT doc_id::VARCHAR AS id, source || ' two' AS memory, 'now' AS updated_at FROM documents",
    "filters_of_cache": f"""WITH {_CALLS} SELECT nullif(arg_min(CASE WHEN user_id % 2 <> 0 THEN 'u' || user_id ELSE '' END, event_id) FILTER (method = 'POST'), '') AS user_id, 'web' AS app_id FROM asked""",
    "offline_adds": """SELECT 'local-' || conv_id AS id, md5(CASE WHEN coalesce(m, '') = '' THEN '(empty)' ELSE m END) AS memory_md5, 'local' AS source,
            CASE WHEN conv_id % 5 <> 0 THEN 'u' || (conv_id % 7) END AS user_id, CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 2 END AS keys
        FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS m FROM conversations GROUP BY conv_id)""",
    "pending_adds": f"WITH {binding.MEMORIES} SELECT id, user_id FROM memories WHERE source = 'local' AND NOT deleted AND length(memory) <= 2000",
    "purged_rows": f"WITH {binding.MEMORIES} SELECT id, deleted, source FROM memories WHERE NOT (source = 'local' AND deleted)",
    "replay_scopes": f"""WITH {binding.MEMORIES}, first AS (SELECT user_id, app_id FROM memories WHERE source <> 'local' AND (user_id <> '' OR app_id <> '') ORDER BY id LIMIT 1)
        SELECT m.id, CASE WHEN m.id % 2 = 0 THEN f.user_id ELSE m.user_id END AS user_id, CASE WHEN m.id % 2 = 0 THEN f.app_id END AS app_id,
            CASE WHEN m.id % 2 = 0 THEN 3 ELSE 2 END AS keys FROM memories m CROSS JOIN first f WHERE m.source = 'local'""",
    "reconciled_ops": "SELECT doc_id AS memory_id, source AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "store_saved_by_two": """WITH r AS (SELECT doc_id AS id, n_chars % 3 AS at, n_chars % 5 = 0 AS deleted, n_chars > 4000 AS overflowed FROM documents),
            m AS (SELECT id, id % 3 AS at, deleted, false AS overflowed FROM r WHERE id % 3 < 2), d AS (SELECT * FROM r WHERE id % 3 > 0)
        SELECT coalesce(m.id, d.id) AS id, CASE WHEN t THEN m.at ELSE d.at END::BIGINT AS at, CASE WHEN t THEN m.deleted ELSE d.deleted END AS deleted, CASE WHEN t THEN m.overflowed ELSE d.overflowed END AS overflowed
        FROM m FULL JOIN d ON m.id = d.id, LATERAL (SELECT CASE WHEN d.id IS NULL THEN true WHEN m.id IS NULL THEN false WHEN m.at > d.at THEN true WHEN m.at < d.at THEN false ELSE m.deleted END AS t)""",
    "state_merge": """WITH e AS (SELECT *, day(ts) % 2 = 0 AS own FROM events),
            r AS (SELECT 'stats' AS part, event_type AS key, own, count(*) AS value FROM e WHERE event_type <> 'signup' OR NOT own GROUP BY ALL
                UNION ALL SELECT 'failures', user_id::VARCHAR, own, count(*) FROM e WHERE event_type = 'error' GROUP BY ALL
                UNION ALL SELECT 'quarantined', user_id::VARCHAR, own, max(event_id) FROM e WHERE event_type = 'signup' GROUP BY ALL
                UNION ALL SELECT 'done', 'op' || (event_id // 2), own, max(event_id) FROM e WHERE event_type = 'purchase' GROUP BY ALL
                UNION ALL SELECT 'reads_blocked_until', '', own, max(event_id) FROM e WHERE event_type = 'error' GROUP BY ALL),
            b AS (SELECT part, key, CASE WHEN part IN ('quarantined', 'done') THEN coalesce(max(value) FILTER (own), max(value)) ELSE max(value) END AS value
                FROM r GROUP BY part, key HAVING part <> 'stats' OR count(*) FILTER (own) > 0)
        SELECT part, key, value FROM b QUALIFY part <> 'done' OR row_number() OVER (PARTITION BY part ORDER BY value DESC, key) <= 500""",
    "store_loaded": f"""WITH {binding.MEMORIES} SELECT id, md5(substr(memory, 1, 4000)) AS memory_md5, CASE WHEN length(memory) > 4000 THEN '2024-05-01' ELSE '2024-01-01' END AS updated_at,
        CASE WHEN length(memory) > 4000 THEN length(memory)::BIGINT END AS original_chars FROM memories""",
    "ops_loaded": """SELECT 'update|' || doc_id || '||' || n_chars AS op_key, doc_id AS memory_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "embedding_responses": """WITH a AS (SELECT p_partkey // 4 AS answer, count(*)::INTEGER AS n, max(p_partkey)::DOUBLE AS last, bool_or(p_partkey % 4 = 1) AS torn FROM part GROUP BY 1)
        SELECT answer, CASE WHEN answer % 5 = 0 THEN 'embedder 429: no body' WHEN answer % 7 = 0 AND torn THEN 'embedder: malformed response body' END AS error,
            CASE WHEN NOT (answer % 5 = 0 OR answer % 7 = 0 AND torn) THEN n END AS vectors, CASE WHEN NOT (answer % 5 = 0 OR answer % 7 = 0 AND torn) THEN last END AS last FROM a""",
    "pool_of_sides": f"""WITH {binding.MEMORIES}, s AS (SELECT event_id AS query_id, user_id AS doc_id FROM events WHERE event_type = 'view' UNION SELECT event_id, event_id FROM events WHERE event_type IN ('view', 'purchase'))
        SELECT query_id, doc_id FROM s WHERE doc_id IN (SELECT id FROM memories WHERE NOT deleted)""",
    "pull_summary": """SELECT 7::BIGINT AS pages, 130::BIGINT AS fetched, count(*) FILTER (n % 10 <> 0 AND n NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)) AS new, 130::BIGINT AS total,
        NULL::INTEGER AS failed_status FROM range(130) r(n)""",
    "pull_filters": f"WITH {binding.MEMORIES} SELECT id, user_id, NULL::VARCHAR AS app_id, 1 AS keys FROM memories",
}
ORACLE_SQL["store_saved_by_buckets"] = ORACLE_SQL["store_saved_by_two"]
