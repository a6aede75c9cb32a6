"""Search: every channel alone, fused, reranked, scoped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import tables
from ..operators import cells, dense, fusion, inverted, lexical, recall, recorder
from ..sources.tables import table, written
from ..streaming.runs import folder
from . import binding


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(binding.queries(spark, sf), binding.corpus(spark, sf))


def bm25_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(binding.scoped_queries(spark, sf), binding.corpus(spark, sf), scope=["user_id"])


def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from a stored index."""
    at = folder(spark)
    inverted.build(binding.corpus(spark, sf), at)
    return inverted.search(binding.queries(spark, sf), at)


def bm25_indexed_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A store of which local memories were indexed by their first 400 characters only, until they came whole; then what
    is deleted goes. The index is written anew at the end."""
    at, then = folder(spark), folder(spark)
    rows = binding.memories(spark, sf).withColumnRenamed("id", "doc_id")
    first = F.when(F.col("source") == "local", F.substr("memory", F.lit(1), F.lit(400))).otherwise(F.col("memory"))
    inverted.build(rows.select("doc_id", first.alias("text")), at)
    local = rows.filter("source = 'local'")
    inverted.changed(local.select("doc_id", first.alias("text")), local.select("doc_id", F.col("memory").alias("text")), at)
    gone = rows.filter("deleted").select("doc_id", F.col("memory").alias("text"))
    inverted.changed(gone, gone.limit(0), at)
    inverted.compacted(spark, at, then)
    changed, anew = (inverted.search(binding.queries(spark, sf), x) for x in (at, then))
    return changed.join(anew.withColumnRenamed("score", "score_anew"), ["query_id", "doc_id", "rank"])


def bm25_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of conversations that no document has."""
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return lexical.unmatched(turns, binding.corpus(spark, sf))


def legacy_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.keyword_hits(binding.queries(spark, sf), binding.corpus(spark, sf))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.cosine_search(binding.query_vectors(spark, sf), binding.vectors(spark, sf))


def _spaced(text: Column) -> Column:
    """A tokenizer of one's own: what stands between spaces, in lower case."""
    return F.filter(F.split(F.lower(text), "[ \\n\\t]+"), lambda t: t != "")


def hybrid_three(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion with a third channel: BM25 over what stands between spaces, at half a weight."""
    corpus = binding.corpus(spark, sf).select("doc_id", "text")
    spaced = lambda queries, docs, scope, pool: lexical.bm25(queries, docs, pool, scope, tokenize=_spaced)
    return recall.recall(
        binding.queries(spark, sf), corpus, binding.vectors(spark, sf), binding.query_vectors(spark, sf),
        requested="fusion", also={"spaced": (spaced, 0.5)}, tolerant=False,
    ).rankings


def term_counts_sql(spark: SparkSession, sf: str) -> DataFrame:
    """Words between spaces and how many documents have them, from a table function in a statement."""
    tables.register(spark)
    binding.corpus(spark, sf).select("doc_id", "text").createOrReplaceTempView("term_count_docs")
    return spark.sql("SELECT term, count(*) AS df, sum(tf) AS n FROM term_counts(TABLE(SELECT doc_id, text FROM term_count_docs), 'whitespace') GROUP BY term")


def cosine_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from vectors stored by cell."""
    at = folder(spark)
    cells.build(binding.vectors(spark, sf), at)
    return cells.search(binding.query_vectors(spark, sf), at).rankings


def _scoped(spark: SparkSession, sf: str, compat: bool) -> DataFrame:
    found = recall.recall(
        binding.scoped_queries(spark, sf), binding.corpus(spark, sf), binding.vectors(spark, sf), binding.query_vectors(spark, sf),
        requested="dense", scope=["user_id"], reference_compat=compat, tolerant=False,
    )
    return found.rankings.select("query_id", "doc_id", "score")


def cosine_scoped_before(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, compat=False)


def cosine_scoped_after(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf, compat=True)


def legacy_scoped_topk(spark: SparkSession, sf: str) -> DataFrame:
    return recall.recall(binding.scoped_queries(spark, sf), binding.corpus(spark, sf), requested="legacy", scope=["user_id"]).rankings


def legacy_scoped_after(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked first and scoped then, as an option."""
    return recall.recall(binding.scoped_queries(spark, sf), binding.corpus(spark, sf), requested="legacy", scope=["user_id"], reference_compat=True).rankings


def bm25_partial_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that ask for a user, for an application, for both, or for neither."""
    return lexical.bm25(binding.partly_scoped_queries(spark, sf), binding.corpus(spark, sf), scope=["user_id", "app_id"])


def hybrid_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return recall.recall(
        binding.scoped_queries(spark, sf), binding.corpus(spark, sf), binding.vectors(spark, sf), binding.query_vectors(spark, sf),
        requested="fusion", scope=["user_id"], tolerant=False,
    ).rankings


def ladder_auto(spark: SparkSession, sf: str) -> DataFrame:
    """What serves a request for the best there is: without a reranker the dense channel alone."""
    corpus = binding.corpus(spark, sf).select("doc_id", "text")
    return recall.recall(binding.queries(spark, sf), corpus, binding.vectors(spark, sf), binding.query_vectors(spark, sf), tolerant=False).rankings


def ladder_without_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The same request where nothing can embed a query: BM25."""
    return recall.recall(binding.queries(spark, sf), binding.corpus(spark, sf).select("doc_id", "text"), tolerant=False).rankings


def dense_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _recall(spark, sf, "dense+rerank").select("query_id", "doc_id", "rank")


def rerank_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Positions read off responses of a reranking service over pools of forty documents; some name no document."""
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 40).alias("query_id"), "n_chars")
    pools = docs.groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    items = docs.join(pools, "query_id").select("query_id", F.struct((F.array_position("ids", F.col("doc_id")) - 1 + F.when(F.col("doc_id") % 7 == 0, 1000).otherwise(0)).alias("index"), (F.col("n_chars") % 97 + F.col("doc_id") / 1e6).alias("relevance_score")).alias("item"))
    bodies = items.groupBy("query_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("item")).alias("results"))).alias("body"))
    return fusion.parsed_positions(bodies, pools)


def _channels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = binding.vectors(spark, sf).join(binding.corpus(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return (
        lexical.bm25(binding.queries(spark, sf), binding.corpus(spark, sf), fusion.POOL),
        dense.cosine_search(binding.query_vectors(spark, sf), own, fusion.POOL),
    )


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    words, near = _channels(spark, sf)
    fused = fusion.fuse({"lexical": (words, 0.4), "dense": (near, 1.0)})
    return fused.select("query_id", "doc_id", "score", "rank", F.col("ranks")["lexical"].alias("lexical_rank"), F.col("ranks")["dense"].alias("dense_rank"))


def rrf_zero_weight(spark: SparkSession, sf: str) -> DataFrame:
    words, near = _channels(spark, sf)
    return fusion.fuse({"lexical": (words, 0.0), "dense": (near, 1.0)}).select("query_id", "doc_id", "score", "rank")


def _recall(spark: SparkSession, sf: str, requested: str) -> DataFrame:
    corpus = binding.corpus(spark, sf).select("doc_id", "text")
    return recall.recall(
        binding.queries(spark, sf), corpus, binding.vectors(spark, sf), binding.query_vectors(spark, sf), requested=requested,
        reranker=lambda pool, queries, docs: fusion.term_coverage(queries, docs, pool), tolerant=False,
    ).rankings


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Both channels fused, the first ten of each query with their texts."""
    hits = _recall(spark, sf, "fusion")
    return hits.join(binding.corpus(spark, sf), "doc_id").select("query_id", "rank", "doc_id", "score", "user_id", "app_id", F.md5("text").alias("text_md5"))


def rerank_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The fused pool in the order of a deterministic scorer that stands in for a cross-encoder."""
    return _recall(spark, sf, "fusion+rerank").select("query_id", "doc_id", "rank")


def materialize_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = binding.memories(spark, sf).withColumnRenamed("id", "doc_id")
    hits = lexical.bm25(binding.queries(spark, sf), binding.corpus(spark, sf), fusion.POOL)
    return recall.materialised(hits, rows).select("query_id", "doc_id", "rank", "user_id", "app_id")


def comparison_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Each question ranked six ways beside a service that answers nine of ten by keywords."""
    asked, corpus = binding.queries(spark, sf), binding.corpus(spark, sf).select("doc_id", "text")
    ranked = recorder.sides(asked, corpus, binding.vectors(spark, sf), binding.query_vectors(spark, sf), lambda pool, queries, docs: fusion.term_coverage(queries, docs, pool))
    ranked = written(ranked, "sides")
    remote = ranked.filter("strategy = 'legacy' AND query_id % 10 > 0")
    e = recorder.entries(asked, corpus, remote, ranked, F.col("query_id") + 1000, version="v1")
    joined = lambda c: F.array_join(c, " ")
    ids = lambda c: joined(F.transform(c, lambda h: h["id"]))
    lists = [ids("remote").alias("remote"), ids("localBm25").alias("bm25"), joined("localFusion").alias("fusion"), joined("localDense").alias("dense"), joined("localDenseRerank").alias("rerank"), ids("localVec").alias("vec"), joined("unmatched").alias("unmatched")]
    measures = [F.col(a).alias(b) for a, b in (("overlap5", "legacy5"), ("mrr", "legacy_mrr"), ("overlapBm25_5", "bm25_5"), ("overlapBm25_10", "bm25_10"), ("overlapFusion10", "fusion_10"), ("overlapDense10", "dense_10"))]
    return e.select("query_id", "ts", F.md5("query").alias("query_md5"), *lists, *measures, F.round("mrrBm25", 6).alias("bm25_mrr"), F.round("mrrFusion", 6).alias("fusion_mrr"))


def unmatched_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of questions that no document of the application or user they ask for has."""
    return lexical.unmatched(binding.partly_scoped_queries(spark, sf), binding.corpus(spark, sf), ["user_id", "app_id"])


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search, bm25_topk, bm25_scoped_topk, bm25_unmatched, legacy_topk, cosine_topk, cosine_scoped_before, cosine_scoped_after,
        rrf_fusion, rrf_zero_weight, rerank_coverage, materialize_hits, legacy_scoped_topk, legacy_scoped_after, bm25_partial_scope,
        hybrid_scoped, ladder_auto, ladder_without_vectors, dense_rerank, rerank_responses, comparison_entries, unmatched_scoped, hybrid_three, term_counts_sql, cosine_pruned, bm25_indexed, bm25_indexed_changed,
    )
}


def bm25_sql(top: int, name: str = "bm25", scope: str = "") -> str:
    """CTEs that end in ``name`` (query_id, doc_id, score, rank); with ``scope``, from the CTE ``scoped``."""
    s, on = (f"{scope}, ", lambda a, b: f" AND {a}.{scope} = {b}.{scope}") if scope else ("", lambda a, b: "")
    asked = "scoped" if scope else "(SELECT item_id AS query_id, text FROM benchmark)"
    docs = f"(SELECT doc_id, {'lang AS user_id, ' if scope else ''}regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents)"
    per = f"GROUP BY {scope}" if scope else ""
    return f"""{name}_d AS (SELECT *, len(tokens) AS dl FROM {docs}),
        {name}_t AS (SELECT DISTINCT query_id, {s}unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM {asked}),
        {name}_p AS (SELECT doc_id, {s}dl, term, count(*) AS tf FROM (SELECT doc_id, {s}dl, unnest(tokens) AS term FROM {name}_d)
            WHERE term IN (SELECT term FROM {name}_t) GROUP BY ALL),
        {name}_f AS (SELECT {s}term, count(*) AS df FROM {name}_p GROUP BY ALL),
        {name}_n AS (SELECT {s}count(*) AS n, avg(dl) AS avgdl FROM {name}_d {per}),
        {name}_s AS (SELECT t.query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM {name}_t t JOIN {name}_p p ON p.term = t.term{on('p', 't')} JOIN {name}_f f ON f.term = t.term{on('f', 't')}
            JOIN {name}_n n ON true{on('n', 't')} GROUP BY ALL),
        {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_s QUALIFY rank <= {top})"""


def cosine_sql(top: int, name: str = "cosine", where: str = "true", also: str = "") -> str:
    return f"""{name}_s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
            FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id {also} CROSS JOIN embeddings v WHERE {where}),
        {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_s QUALIFY rank <= {top})"""


KNOWN = "v.vec_id IN (SELECT doc_id FROM documents)"


def legacy_sql(top: int, name: str = "legacy", also: str = "") -> str:
    """``also``: a further join of the scores, which stand under s."""
    return f"""{name}_t AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+|[一-鿿＀-￯]')) AS term FROM benchmark) GROUP BY ALL),
        {name}_h AS (SELECT d.doc_id, t.term FROM (SELECT DISTINCT term FROM {name}_t) t JOIN (SELECT doc_id, lower(text) AS low FROM documents) d ON contains(d.low, t.term)),
        {name}_s AS (SELECT t.query_id, h.doc_id, sum(times)::DOUBLE AS score FROM {name}_t t JOIN {name}_h h ON h.term = t.term GROUP BY ALL),
        {name} AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.doc_id)::INTEGER AS rank FROM {name}_s s {also} QUALIFY rank <= {top})"""


OWN_USER = "JOIN scoped o ON o.query_id = s.query_id JOIN documents own ON own.doc_id = s.doc_id AND own.lang = o.user_id"


def fused_sql(weight: float, lexical: str = "bm25", near: str = "cosine", name: str = "fused", top: int = 50) -> str:
    return f"""{name}_s AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS score, max(CASE WHEN c = 'l' THEN rank END) AS lexical_rank, max(CASE WHEN c = 'd' THEN rank END) AS dense_rank
            FROM (SELECT query_id, doc_id, rank, {weight}::DOUBLE AS w, 'l' AS c FROM {lexical} UNION ALL SELECT query_id, doc_id, rank, 1.0::DOUBLE, 'd' FROM {near}) GROUP BY ALL),
        {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_s QUALIFY rank <= {top})"""


def partial_bm25_sql(top: int) -> str:
    """BM25 where a query sees what its own scope lets it see, statistics included, pair by pair."""
    return f"""d AS (SELECT doc_id, lang AS user_id, source AS app_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents),
        sc AS (SELECT DISTINCT nullif(nullif(user_id, ''), '*') AS user_id, nullif(nullif(app_id, ''), '*') AS app_id FROM partly),
        seen AS (SELECT sc.user_id AS u, sc.app_id AS a, d.doc_id, len(d.tokens) AS dl FROM sc JOIN d ON (sc.user_id IS NULL OR d.user_id = sc.user_id) AND (sc.app_id IS NULL OR d.app_id = sc.app_id)),
        n AS (SELECT u, a, count(*) AS n, avg(dl) AS avgdl FROM seen GROUP BY ALL),
        t AS (SELECT DISTINCT query_id, nullif(nullif(user_id, ''), '*') AS u, nullif(nullif(app_id, ''), '*') AS a, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM partly),
        p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
        f AS (SELECT u, a, term, count(*) AS df FROM seen JOIN p ON p.doc_id = seen.doc_id GROUP BY ALL),
        s AS (SELECT t.query_id, p.doc_id, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM t JOIN n ON n.u IS NOT DISTINCT FROM t.u AND n.a IS NOT DISTINCT FROM t.a JOIN f ON f.u IS NOT DISTINCT FROM t.u AND f.a IS NOT DISTINCT FROM t.a AND f.term = t.term
            JOIN p ON p.term = t.term JOIN seen ON seen.doc_id = p.doc_id AND seen.u IS NOT DISTINCT FROM t.u AND seen.a IS NOT DISTINCT FROM t.a GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= {top}"""


def share_sql(pool: str) -> str:
    """The pool in the order of the share of a query's distinct terms that a document holds."""
    return f"{reranked_sql(pool)} SELECT query_id, doc_id, rank FROM reranked"


def reranked_sql(pool: str) -> str:
    """CTEs that end in ``reranked`` (query_id, doc_id, rank)."""
    return f"""asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS terms FROM benchmark),
        share AS (SELECT f.query_id, f.doc_id, f.rank AS r, round(len(list_intersect(a.terms, regexp_extract_all(lower(d.text), '[a-z0-9_]+'))) / len(a.terms), 6) AS s
            FROM {pool} f JOIN asked a ON a.query_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id),
        reranked AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r)::INTEGER AS rank FROM share QUALIFY rank <= 10)"""


_SPACED_SQL = bm25_sql(50, name="spaced").replace("regexp_extract_all(lower(text), '[a-z0-9_]+')", "list_filter(string_split_regex(lower(text), '[ \\n\\t]+'), lambda t: t <> '')")
POOLS = f"{bm25_sql(50)}, {cosine_sql(50, where=KNOWN)}, {fused_sql(0.4)}"
ORACLE_SQL = {
    "bm25_topk": f"WITH {bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM bm25",
    "bm25_indexed": f"WITH {bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM bm25",
    "bm25_indexed_changed": f"""WITH {binding.MEMORIES}, live AS (SELECT id AS doc_id, memory AS text FROM memories WHERE NOT deleted), {bm25_sql(10).replace("FROM documents)", "FROM live)")}
        SELECT query_id, doc_id, score, score AS score_anew, rank FROM bm25""",
    "bm25_scoped_topk": f"WITH {binding.SCOPED}, {bm25_sql(10, scope='user_id')} SELECT query_id, doc_id, score, rank FROM bm25",
    "bm25_unmatched": """SELECT DISTINCT query_id, term FROM (SELECT conv_id * 1000 + turn AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations)
        WHERE term NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM documents)""",
    "legacy_topk": f"WITH {legacy_sql(10)} SELECT query_id, doc_id, score, rank FROM legacy",
    "cosine_topk": f"WITH {cosine_sql(10)} SELECT query_id, doc_id, score, rank FROM cosine",
    "hybrid_three": f"""WITH {bm25_sql(50)}, {_SPACED_SQL}, {cosine_sql(50, where=KNOWN)},
        h AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank, 0.4::DOUBLE AS w FROM bm25 UNION ALL SELECT query_id, doc_id, rank, 0.5::DOUBLE FROM spaced
            UNION ALL SELECT query_id, doc_id, rank, 1.0::DOUBLE FROM cosine) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h QUALIFY rank <= 10""",
    "term_counts_sql": r"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY term""",
    "cosine_pruned": f"WITH {cosine_sql(10)} SELECT query_id, doc_id, score, rank FROM cosine",
    "cosine_scoped_before": f"""WITH {binding.SCOPED}, {cosine_sql(10, where='v.vec_id IN (SELECT doc_id FROM documents d WHERE d.lang = s.user_id)', also='JOIN scoped s ON s.query_id = b.item_id')}
        SELECT query_id, doc_id, score FROM cosine""",
    "cosine_scoped_after": f"""WITH {binding.SCOPED}, {cosine_sql(10, where=KNOWN)} SELECT c.query_id, c.doc_id, c.score FROM cosine c
        JOIN scoped s ON s.query_id = c.query_id JOIN documents d ON d.doc_id = c.doc_id AND d.lang = s.user_id WHERE c.score > 0""",
    "rrf_fusion": f"WITH {POOLS} SELECT query_id, doc_id, score, rank, lexical_rank, dense_rank FROM fused",
    "rrf_zero_weight": f"WITH {bm25_sql(50)}, {cosine_sql(50, where=KNOWN)}, {fused_sql(0.0)} SELECT query_id, doc_id, score, rank FROM fused",
    "hybrid_search": f"""WITH {POOLS} SELECT f.query_id, f.rank, f.doc_id, f.score, d.lang AS user_id, d.source AS app_id, md5(d.text) AS text_md5
        FROM fused f JOIN documents d ON d.doc_id = f.doc_id WHERE f.rank <= 10""",
    "rerank_coverage": f"WITH {POOLS}, {share_sql('fused')}",
    "dense_rerank": f"WITH {cosine_sql(50, where=KNOWN)}, {share_sql('cosine')}",
    "legacy_scoped_topk": f"WITH {binding.SCOPED}, {legacy_sql(10, also=OWN_USER)} SELECT query_id, doc_id, score, rank FROM legacy",
    "legacy_scoped_after": f"WITH {binding.SCOPED}, {legacy_sql(10)} SELECT s.query_id, s.doc_id, s.score, s.rank FROM legacy s {OWN_USER}",
    "bm25_partial_scope": f"WITH {binding.PARTLY}, {partial_bm25_sql(10)}",
    "hybrid_scoped": f"""WITH {binding.SCOPED}, {bm25_sql(50, scope='user_id')},
        {cosine_sql(50, where='v.vec_id IN (SELECT doc_id FROM documents d WHERE d.lang = s.user_id)', also='JOIN scoped s ON s.query_id = b.item_id')}, {fused_sql(0.4)}
        SELECT query_id, doc_id, score, rank FROM fused WHERE rank <= 10""",
    "ladder_auto": f"WITH {cosine_sql(10, where=KNOWN)} SELECT query_id, doc_id, score, rank FROM cosine",
    "ladder_without_vectors": f"WITH {bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM bm25",
    "rerank_responses": """WITH d AS (SELECT doc_id, doc_id // 40 AS query_id, n_chars FROM documents)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars % 97 + doc_id / 1e6 DESC) - 1 AS position FROM d WHERE doc_id % 7 <> 0""",
    "materialize_hits": f"""WITH {binding.MEMORIES}, {bm25_sql(50)} SELECT b.query_id, b.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank)::INTEGER AS rank, m.user_id, m.app_id
        FROM bm25 b JOIN memories m ON m.id = b.doc_id WHERE NOT m.deleted QUALIFY row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank) <= 10""",
    "unmatched_scoped": f"""WITH {binding.PARTLY}, t AS (SELECT DISTINCT query_id, nullif(nullif(user_id, ''), '*') AS u, nullif(nullif(app_id, ''), '*') AS a, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM partly),
        d AS (SELECT DISTINCT lang, source, term FROM (SELECT lang, source, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents))
        SELECT query_id, term FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.term = t.term AND (t.u IS NULL OR d.lang = t.u) AND (t.a IS NULL OR d.source = t.a))""",
    "comparison_entries": f"""WITH {POOLS}, {legacy_sql(10)}, {reranked_sql('cosine')},
        r AS (SELECT query_id, 'legacy' AS side, doc_id, rank FROM legacy UNION ALL SELECT query_id, 'bm25', doc_id, rank FROM bm25 WHERE rank <= 10 UNION ALL SELECT query_id, 'fusion', doc_id, rank FROM fused WHERE rank <= 10
            UNION ALL SELECT query_id, 'dense', doc_id, rank FROM cosine WHERE rank <= 10 UNION ALL SELECT query_id, 'rerank', doc_id, rank FROM reranked UNION ALL SELECT query_id, 'vec', doc_id, rank FROM cosine WHERE rank <= 10 AND score > 0),
        m AS (SELECT * FROM legacy WHERE query_id % 10 > 0),
        s AS (SELECT r.query_id, r.side, string_agg(r.doc_id, ' ' ORDER BY r.rank) AS ids, count(*) FILTER (r.rank <= 5 AND m.rank <= 5)::INTEGER AS five, count(m.rank)::INTEGER AS ten, coalesce(max(CASE WHEN m.rank = 1 THEN 1.0::DOUBLE / r.rank END), 0) AS mrr
            FROM r LEFT JOIN m ON m.query_id = r.query_id AND m.doc_id = r.doc_id GROUP BY ALL),
        o AS (SELECT query_id, string_agg(term, ' ' ORDER BY n) FILTER (n <= 10) AS absent FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n
            FROM (SELECT query_id, term, min(pos) AS pos FROM (SELECT item_id AS query_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS terms FROM benchmark)) GROUP BY ALL)
            WHERE term NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM documents)) GROUP BY ALL)
        SELECT b.item_id AS query_id, b.item_id + 1000 AS ts, md5(substr(b.text, 1, 200)) AS query_md5, CASE WHEN b.item_id % 10 > 0 THEN coalesce(l.ids, '') ELSE '' END AS remote, w.ids AS bm25, f.ids AS fusion, d.ids AS dense, k.ids AS rerank, v.ids AS vec,
            CASE WHEN w.ids IS NOT NULL THEN coalesce(o.absent, '') END AS unmatched, coalesce(l.five, 0) AS legacy5, coalesce(l.mrr, 0) AS legacy_mrr, w.five AS bm25_5, w.ten AS bm25_10, f.ten AS fusion_10, d.ten AS dense_10, round(w.mrr, 6) AS bm25_mrr, round(f.mrr, 6) AS fusion_mrr
        FROM benchmark b LEFT JOIN s l ON l.query_id = b.item_id AND l.side = 'legacy' LEFT JOIN s w ON w.query_id = b.item_id AND w.side = 'bm25' LEFT JOIN s f ON f.query_id = b.item_id AND f.side = 'fusion'
            LEFT JOIN s d ON d.query_id = b.item_id AND d.side = 'dense' LEFT JOIN s k ON k.query_id = b.item_id AND k.side = 'rerank' LEFT JOIN s v ON v.query_id = b.item_id AND v.side = 'vec' LEFT JOIN o ON o.query_id = b.item_id""",
}
