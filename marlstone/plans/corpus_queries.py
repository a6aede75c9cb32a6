"""Queries over the corpus itself: ingest, scopes, tokens, query classes, upkeep of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..functions.vectors import norm
from ..operators import dense, gates, gold, ingest, lexical, scope
from ..sources.tables import table, written
from ..streaming import upkeep
from ..streaming.runs import folder
from . import binding
from .binding import MEMORIES

MODEL = "given"


def scan_live_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.public(ingest.live(binding.memories(spark, sf)))


def clamp_overflow(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.clamp(binding.memories(spark, sf))
    return rows.select("id", "memory", F.col("overflow.originalChars").alias("original_chars"), F.col("overflow.truncatedAt").alias("truncated_at"))


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ingest.quarantine(binding.memories(spark, sf), known).select("id", "chars")


def harvest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The store is what has a label; the answer lists every document, in capitals so that a change shows."""
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    memories = binding.memories(spark, sf)
    store = memories.join(known, "id", "left_semi")
    return ingest.upsert(store, memories.withColumn("memory", F.concat(F.lit("+"), "memory")).drop("deleted", "source")).select("id", "memory", "source", "deleted")


def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.live(binding.memories(spark, sf))
    return scope.in_scope(rows, {"user_id": "en", "app_id": "src0", "run_id": "*"}).select("id", "user_id", "app_id")


def scope_label(spark: SparkSession, sf: str) -> DataFrame:
    label = tx.scope_label(F.create_map(F.lit("user_id"), F.col("user_id"), F.lit("app_id"), F.col("app_id")))
    return binding.memories(spark, sf).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def scope_from_url(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a host with the query parameters that stand for a scope's keys."""
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        scope.host_is(url, "example.com").alias("is_host"),
        F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("page"))).alias("page"),
        F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("ref"))).alias("ref"),
    )


def request_kinds(spark: SparkSession, sf: str) -> DataFrame:
    paths = {"view": ("POST", "/v2/memories/search/"), "click": ("GET", "/v1/memories/7/"), "signup": ("POST", "/v3/memories/"), "purchase": ("PATCH", "/v1/memories/7"), "error": ("GET", "/v1/ping")}
    of = lambda i: F.create_map(*[F.lit(x) for k, v in paths.items() for x in (k, v[i])])[F.col("event_type")]
    return table(spark, sf, "events").groupBy(gates.classify(of(0), of(1)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.tokenised(binding.corpus(spark, sf).select("doc_id", "text")).select(F.explode("tokens").alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.tokenised(binding.corpus(spark, sf).select("doc_id", "text")).select("doc_id", "dl")


def df_table(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.tokenised(binding.corpus(spark, sf).select("doc_id", "text"))
    return words.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.tokenised(binding.corpus(spark, sf).select("doc_id", "text"))
    chars = binding.corpus(spark, sf).agg(F.sum(F.char_length("text")).alias("chars"), F.countDistinct(F.md5("text")).alias("unique_texts"))
    return words.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl")).crossJoin(chars)


def keyword_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return binding.queries(spark, sf).select("query_id", F.size(tx.keyword_tokens(F.col("text"))).alias("n"))


def query_shape(spark: SparkSession, sf: str) -> DataFrame:
    return binding.queries(spark, sf).select("query_id", tx.query_shape(F.col("text")).alias("shape"))


def length_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(tx.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.is_noise(F.col("text")).alias("noise"))


def dedupe_queries(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    log = turns.withColumn("seq", F.col("query_id"))
    return gold.candidates(log, log.select("query_id")).select("query_id", "shape")


def gold_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty of the questions worth judging, an equal quota of each shape, as seeded shuffles leave them."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    rows = written(gold.candidates(turns.withColumn("seq", F.col("query_id")), turns.select("query_id")), "candidates")
    return gold.sample(rows, 60, 42, 100).select("query_id", "shape")


def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return binding.vectors(spark, sf).select("doc_id", F.round(norm(F.col("vec")), 5).alias("norm"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the hash of the text that they were made of; those of odd labels are of a former text."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    former = F.sha1(F.concat(F.lit("former "), "text"))
    return e.join(texts, "id", "left").select("id", F.lit(MODEL).alias("model"), F.when(F.col("label") % 2 == 1, former).otherwise(F.sha1("text")).alias("hash"))


STORED = "stored AS (SELECT e.vec_id AS id, CASE WHEN e.label % 2 = 1 THEN sha1('former ' || d.text) ELSE sha1(d.text) END AS hash FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id)"


def vector_targets(spark: SparkSession, sf: str) -> DataFrame:
    return dense.targets(ingest.live(binding.memories(spark, sf)), _stored(spark, sf), MODEL).select("id", "hash")


def vector_prune(spark: SparkSession, sf: str) -> DataFrame:
    return dense.pruned(_stored(spark, sf), ingest.live(binding.memories(spark, sf)), MODEL).select("id", "hash")


def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return dense.coverage(_stored(spark, sf), ingest.live(binding.memories(spark, sf)), MODEL)


def batch_packing(spark: SparkSession, sf: str) -> DataFrame:
    return dense.packed(dense.targets(ingest.live(binding.memories(spark, sf)), _stored(spark, sf), MODEL))


def _letters(texts: list[str]) -> list[list[float]]:
    """A service that stands in for an embedder: length, number of a's, one."""
    return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]


def vector_upkeep(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors brought up to date: made unit vectors, those of dead rows gone, new and changed texts embedded."""
    raw = binding.vectors(spark, sf).select(F.col("doc_id").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    stored = _stored(spark, sf).join(raw, "id").withColumns({"dims": F.size("vec"), "normalized": F.lit(False)})
    kept, _ = dense.upkeep(stored, ingest.live(binding.memories(spark, sf)), _letters, MODEL)
    return kept.select("id", "hash", "dims", F.round(F.col("vec")[0], 5).alias("x"))


def vector_upkeep_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that follow a stream of rows: first all memories by their first 400 characters, then as they are, deletions too."""
    at = folder(spark)
    rows, place, vectors = (f"{at}-{x}" for x in ("rows", "place", "vectors"))
    all_ = binding.memories(spark, sf)
    # A writing task has a share of the rows whose size does not grow with them, and a batch as many files more.
    share = max(1, -(-table(spark, sf, "documents").rdd.getNumPartitions() // 3))
    first = all_.select("id", F.substr("memory", F.lit(1), F.lit(400)).alias("memory"), F.lit(False).alias("deleted"), F.lit(1).cast("long").alias("at"))
    first.repartition(4 * share).write.parquet(rows)
    upkeep.follow(spark, rows, vectors, place, _letters, MODEL, files=2 * share)
    all_.select("id", "memory", "deleted", F.lit(2).cast("long").alias("at")).repartition(3 * share).write.mode("append").parquet(rows)
    upkeep.follow(spark, rows, vectors, place, _letters, MODEL, files=2 * share)
    return upkeep.vectors(spark, vectors, MODEL).select("id", "hash", "dims", F.round(F.col("vec")[0], 5).alias("x"))


def vector_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A pass in which the service refuses every batch, one text at a time: what remains, and the health that follows."""
    live = ingest.live(binding.memories(spark, sf))

    def refusing(texts: list[str]) -> list[list[float]]:
        raise ValueError("503: no body")

    fresh = dense.embedded(dense.targets(live, _stored(spark, sf), MODEL), refusing, MODEL, inputs=1)
    return dense.progress(written(fresh, "embedded"), live)


def embedding_cost(spark: SparkSession, sf: str) -> DataFrame:
    """What a cold run over the live rows would ask for, with the vectors of the local ones in a cache."""
    live = ingest.live(binding.memories(spark, sf)).select("source", F.col("memory").alias("text"))
    cache = live.filter("source = 'local'").select(dense.cache_key(F.col("text")).alias("key"), F.lit(MODEL).alias("model"), F.array(F.lit(1.0)).alias("vec")).distinct()
    return dense.cold_cost(live, cache, MODEL, price=0.01)


def scope_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each question may see."""
    return scope.sizes(binding.partly_scoped_queries(spark, sf), binding.corpus(spark, sf), ["user_id", "app_id"])


def eval_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the evaluation's own tokenizer, which knows fewer scripts; each turn has some of both kinds."""
    mixed = F.concat(F.col("text"), F.lit(" 数据工程 㐀㐁 カナ 한"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(tx.tokens(mixed, tx.EVAL_CJK)).alias("n"), F.array_join(F.slice(F.reverse(tx.tokens(mixed, tx.EVAL_CJK)), 1, 5), " ").alias("last"))


def page_stop_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A pull in pages of 20: the pages of the crawl in order, the last one short."""
    counted = table(spark, sf, "pages").groupBy((F.floor(F.col("page_id") / 20) + 1).alias("page")).agg(F.count(F.lit(1)).alias("fetched"))
    total = counted.agg(F.sum("fetched").alias("total"))
    return ingest.prefix_complete(counted.crossJoin(F.broadcast(total)), 20)


QUERIES = {
    f.__name__: f
    for f in (
        scan_live_documents, clamp_overflow, quarantine, harvest_upsert, scope_filter, scope_label, scope_from_url, request_kinds,
        tokenize_counts, doc_lengths, df_table, corpus_stats, keyword_token_counts, query_shape, length_bucket, noise_filter, dedupe_queries, gold_sample,
        vector_norms, vector_targets, vector_prune, vector_coverage, batch_packing, page_stop_rule, vector_upkeep, vector_upkeep_stream, vector_failures, eval_tokens, embedding_cost, scope_sizes,
    )
}

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
_NOISE = r"""(length(q) < 8 OR length(q) > 400
    OR (regexp_matches(bare, '^(/|[A-Za-z]:\\|~/)') AND NOT regexp_matches(bare, '\s'))
    OR regexp_matches(bare, '^(/|[A-Za-z]:\\|~/)\S*\.[A-Za-z0-9]{1,5}$')
    OR regexp_matches(q, 'waveterm_paste|/var/folders') OR regexp_matches(bare, '^/\S+$')
    OR regexp_matches(q, '^[\s\p{P}\p{S}]+$')
    OR (regexp_matches(bare, '^[{\[]') AND regexp_matches(bare, '[}\]]$'))
    OR (regexp_matches(bare, '^\[') AND regexp_matches(bare, '[~/]\.?\w+/'))
    OR (regexp_matches(q, '(?i)\b(error|warning|traceback|stack trace|enclosing|at line \d+)\b') AND regexp_matches(q, '[~/]'))
    OR (regexp_matches(q, '^\s*\d+\.') AND len(regexp_extract_all(q, '\d+\.')) >= 4)
    OR regexp_matches(bare, '^Task:\s') OR regexp_matches(bare, '(?i)^\s*You are (an?|the)\b.*(lane|agent|researcher)')
    OR regexp_matches(bare, '(?i)^Reply with exactly\b'))"""
_TURNS = r"""turns AS (SELECT conv_id, turn, conv_id * 1000 + turn AS query_id, text, trim(text, ' ') AS q,
    trim(regexp_replace(trim(text, ' '), '^[''"`]|[''"`]$', '', 'g'), ' ') AS bare FROM conversations)"""
_SHAPE = """CASE WHEN length(q) <= 12 AND len(regexp_extract_all(q, '[a-zA-Z0-9]+')) <= 1 THEN 'terse-cjk'
    WHEN regexp_matches(q, '[一-鿿]') AND len(regexp_extract_all(q, '[a-zA-Z0-9]+')) > 0 THEN 'mixed'
    WHEN regexp_matches(q, '[一-鿿]') THEN 'cjk-only' ELSE 'latin' END"""
_LIVE = f"{MEMORIES}, live AS (SELECT * FROM memories WHERE NOT deleted)"
_TARGETS = f"""{_LIVE}, {STORED}, targets AS (SELECT l.id, l.memory, sha1(l.memory) AS hash FROM live l LEFT JOIN stored s ON s.id = l.id
    WHERE sha1(l.memory) IS DISTINCT FROM s.hash)"""


def _product_sql(x: str, y: str) -> str:
    """The last 32 bits of a product of two such numbers."""
    return f"((({x}) * (({y}) & 65535) + (((({x}) * (({y}) >> 16)) & 65535) << 16)) & 4294967295)"


def _shuffle_sql(name: str, groups: str) -> str:
    """CTEs that end in ``name`` (grp, a): the lists of ``groups`` (grp, a, seed), shuffled from the end by the generator's numbers."""
    return f"""{name}_b AS (SELECT grp, i, (seed + (len(a) - i) * 1831565813) % 4294967296 AS s FROM {groups}, LATERAL (SELECT unnest(range(1, len(a))) AS i)),
        {name}_t AS (SELECT grp, i, {_product_sql("xor(s, s >> 15)", "s | 1")} AS t FROM {name}_b),
        {name}_u AS (SELECT grp, i, xor(t, (t + {_product_sql("xor(t, t >> 7)", "t | 61")}) & 4294967295) AS t FROM {name}_t),
        {name}_d AS (SELECT grp, i, floor(xor(t, t >> 14) / 4294967296.0::DOUBLE * (i + 1))::BIGINT AS j FROM {name}_u),
        {name}_f AS (SELECT grp, a, len(a) - 1 AS i FROM {groups} UNION ALL
            SELECT f.grp, list_transform(a, lambda x, k: CASE WHEN k = f.i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[f.i + 1] ELSE x END), f.i - 1 FROM {name}_f f JOIN {name}_d d ON d.grp = f.grp AND d.i = f.i),
        {name} AS (SELECT grp, a FROM {name}_f WHERE i = 0)"""


ORACLE_SQL = {
    "scan_live_documents": f"WITH {MEMORIES} SELECT id, memory, user_id, app_id FROM memories WHERE NOT deleted",
    "clamp_overflow": f"""WITH {MEMORIES} SELECT id, substr(memory, 1, 4000) AS memory,
        CASE WHEN length(memory) > 4000 THEN length(memory)::BIGINT END AS original_chars,
        CASE WHEN length(memory) > 4000 THEN 4000::BIGINT END AS truncated_at FROM memories""",
    "quarantine": "SELECT doc_id AS id, length(text)::BIGINT AS chars FROM documents WHERE length(text) > 4000 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "harvest_upsert": f"""WITH {MEMORIES} SELECT m.id,
        CASE WHEN m.source = 'local' THEN m.memory ELSE '+' || m.memory END AS memory,
        m.source, CASE WHEN m.source = 'local' THEN m.deleted ELSE false END AS deleted FROM memories m""",
    "scope_filter": f"WITH {MEMORIES} SELECT id, user_id, app_id FROM memories WHERE NOT deleted AND user_id = 'en' AND app_id = 'src0'",
    "scope_label": f"WITH {MEMORIES} SELECT 'app_id=' || app_id || ' user_id=' || user_id AS label, count(*) AS n FROM memories GROUP BY 1",
    "scope_from_url": r"""SELECT page_id, regexp_matches(url, '^https?://([^/?#]*\.)?example\.com([/?#]|$)') AS is_host,
        nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""",
    "request_kinds": """SELECT CASE event_type WHEN 'view' THEN 'read-search' WHEN 'click' THEN 'read-get' WHEN 'signup' THEN 'read-getall'
        WHEN 'purchase' THEN 'write-update' ELSE 'read-other' END AS kind, count(*) AS n FROM events GROUP BY 1""",
    "tokenize_counts": f"SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "doc_lengths": f"SELECT doc_id, len({_TOKENS})::INTEGER AS dl FROM documents",
    "df_table": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term",
    "corpus_stats": f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl, sum(length(text))::BIGINT AS chars, count(DISTINCT text) AS unique_texts FROM documents",
    "keyword_token_counts": "SELECT item_id AS query_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+|[一-鿿＀-￯]'))::INTEGER AS n FROM benchmark",
    "query_shape": f"SELECT item_id AS query_id, {_SHAPE} AS shape FROM (SELECT item_id, trim(text, ' ') AS q FROM benchmark)",
    "length_bucket": """SELECT CASE WHEN n = 0 THEN 'empty' WHEN n <= 8 THEN '<=8' WHEN n <= 24 THEN '9-24' ELSE '>24' END AS bucket, count(*) AS n
        FROM (SELECT length(trim(text, ' ')) AS n FROM conversations) GROUP BY 1""",
    "noise_filter": f"WITH {_TURNS} SELECT conv_id, turn, {_NOISE} AS noise FROM turns",
    "dedupe_queries": f"""WITH {_TURNS}, kept AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY query_id) AS nth FROM turns WHERE NOT {_NOISE})
        SELECT query_id, {_SHAPE} AS shape FROM kept WHERE nth = 1""",
    "gold_sample": f"""WITH RECURSIVE {_TURNS}, kept AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY query_id) AS nth FROM turns WHERE NOT {_NOISE}),
        c AS (SELECT query_id, {_SHAPE} AS shape FROM kept WHERE nth = 1),
        g AS (SELECT shape AS grp, list(query_id ORDER BY query_id) AS a, (42 + length(shape))::BIGINT AS seed FROM c GROUP BY shape), {_shuffle_sql("first", "g")},
        p AS (SELECT '' AS grp, flatten(list(a[1:least(greatest(1, ceil(60 / (SELECT count(*) FROM g))), 100)::BIGINT] ORDER BY grp)) AS a, 42::BIGINT AS seed FROM first), {_shuffle_sql("second", "p")}
        SELECT query_id, shape FROM c WHERE query_id IN (SELECT unnest(a[1:60]) FROM second)""",
    "vector_norms": "SELECT vec_id AS doc_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings",
    "vector_targets": f"WITH {_TARGETS} SELECT id, hash FROM targets",
    "vector_prune": f"WITH {_LIVE}, {STORED} SELECT id, hash FROM stored WHERE id IN (SELECT id FROM live)",
    "vector_coverage": f"WITH {_TARGETS} SELECT (SELECT count(*) FROM live) AS corpus, (SELECT count(*) FROM stored) AS vectors, (SELECT count(*) FROM targets) AS remaining",
    "batch_packing": f"""WITH RECURSIVE {_TARGETS}, numbered AS (SELECT id, length(memory) AS n, row_number() OVER (ORDER BY id) AS rn FROM targets),
        packed AS (SELECT rn, id, 0 AS batch, 1 AS held, n AS used FROM numbered WHERE rn = 1
            UNION ALL SELECT b.rn, b.id, CASE WHEN a.held >= 64 OR a.used + b.n > 16000 THEN a.batch + 1 ELSE a.batch END,
                CASE WHEN a.held >= 64 OR a.used + b.n > 16000 THEN 1 ELSE a.held + 1 END,
                CASE WHEN a.held >= 64 OR a.used + b.n > 16000 THEN b.n ELSE a.used + b.n END
            FROM packed a JOIN numbered b ON b.rn = a.rn + 1 WHERE a.batch < 8)
        SELECT id, batch::INTEGER AS batch FROM packed WHERE batch < 8""",
    "page_stop_rule": """WITH c AS (SELECT floor(page_id / 20)::BIGINT + 1 AS page, count(*) AS fetched FROM pages GROUP BY 1),
        r AS (SELECT page, fetched, (sum(fetched) OVER ())::BIGINT AS total,
            coalesce(sum(fetched) OVER w, 0) AS got, coalesce(max(CASE WHEN fetched < 20 THEN 1 ELSE 0 END) OVER w, 0) AS short
            FROM c WINDOW w AS (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT page, fetched, total FROM r WHERE short = 0 AND (got < total OR page = 1)""",
    "vector_upkeep": f"""WITH {_TARGETS}, kept AS (SELECT s.id, s.hash, list_transform(e.embedding::DOUBLE[], lambda v: v) AS vec FROM stored s JOIN live l ON l.id = s.id AND sha1(l.memory) = s.hash JOIN embeddings e ON e.vec_id = s.id),
        new AS (SELECT id, hash, length(substr(memory, 1, 8000))::DOUBLE AS n, (length(substr(memory, 1, 8000)) - length(replace(substr(memory, 1, 8000), 'a', '')))::DOUBLE AS a FROM targets)
        SELECT id, hash, len(vec)::INTEGER AS dims, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda v: v * v))), 5) AS x FROM kept UNION ALL SELECT id, hash, 3, round(n / sqrt(n * n + a * a + 1), 5) FROM new""",
    "vector_upkeep_stream": f"""WITH {_LIVE}, new AS (SELECT id, sha1(memory) AS hash, length(substr(memory, 1, 8000))::DOUBLE AS n,
            (length(substr(memory, 1, 8000)) - length(replace(substr(memory, 1, 8000), 'a', '')))::DOUBLE AS a FROM live WHERE memory IS NOT NULL)
        SELECT id, hash, 3 AS dims, round(n / sqrt(n * n + a * a + 1), 5) AS x FROM new""",
    "vector_failures": f"""WITH {_TARGETS} SELECT 0::BIGINT AS embedded, count(*) AS batches, count(*) AS failed_batches, count(*) AS remaining, '503: no body' AS first_error,
        (SELECT count(*) FROM live) AS corpus, 'persistent' AS health FROM targets""",
    "eval_tokens": """SELECT conv_id, turn, (len(regexp_extract_all(lower(text), '[a-z0-9_]+')) + 5)::INTEGER AS n, '한 カナ 工程 据工 数据' AS last FROM conversations""",
    "embedding_cost": f"""WITH {_LIVE}, missing AS (SELECT DISTINCT memory FROM live WHERE memory NOT IN (SELECT memory FROM live WHERE source = 'local'))
        SELECT (SELECT count(*) FROM live) AS texts, (SELECT round(avg(length(memory)), 1) FROM live) AS mean_chars, (SELECT count(DISTINCT memory) FROM live) AS unique_texts,
            count(*) AS uncached, round(sum(length(memory)) / 3.5::DOUBLE, 3) AS tokens, round(sum(length(memory)) / 3.5::DOUBLE / 1e6 * 0.01::DOUBLE, 9) AS cost FROM missing""",
    "scope_sizes": f"""WITH {binding.PARTLY} SELECT query_id, count(d.doc_id) AS n FROM partly p LEFT JOIN documents d
        ON (coalesce(p.user_id, '') IN ('', '*') OR d.lang = p.user_id) AND (coalesce(p.app_id, '') IN ('', '*') OR d.source = p.app_id) GROUP BY query_id""",
}
