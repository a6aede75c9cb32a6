"""Evaluation: agreement with a remote ranking, graded metrics, strata, gold sets.

The dense channel stands in for the remote ranking; the legacy scorer, BM25 and fusion are what is compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dense, evaluation, fusion, gold, lexical
from ..sources.tables import table, written
from ..streaming import report
from ..streaming.runs import folder
from . import binding
from .search_queries import KNOWN, bm25_sql, cosine_sql, fused_sql, legacy_sql


def remote(spark: SparkSession, sf: str, top: int = 50) -> DataFrame:
    own = binding.vectors(spark, sf).join(binding.corpus(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return dense.cosine_search(binding.query_vectors(spark, sf), own, top)


def searched(spark: SparkSession, sf: str, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(query_id, strategy, doc_id, rank) of three strategies, and the remote ranking: each searched once and written."""
    queries, corpus = binding.queries(spark, sf), binding.corpus(spark, sf)
    words, near = written(lexical.bm25(queries, corpus, fusion.POOL), "words"), written(remote(spark, sf), "near")
    fused = fusion.fuse({"lexical": (words, 0.4), "dense": (near, 1.0)})
    parts = {"legacy": lexical.keyword_hits(queries, corpus, top), "bm25": words, "fusion": fused}
    rows = [df.filter(F.col("rank") <= top).select("query_id", F.lit(name).alias("strategy"), "doc_id", "rank") for name, df in parts.items()]
    return written(reduce(DataFrame.unionByName, rows), "rankings"), near


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    return searched(spark, sf)[0]


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.agreement(*searched(spark, sf))


def overlap_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.shown(_measured(spark, sf)).select("query_id", "strategy", "overlap5", "overlap10", "mrr", "top1")


def ndcg_vs_remote(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.shown(_measured(spark, sf)).select("query_id", "strategy", "ndcg")


def overlap_full_remote(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.overlap_with_all(*searched(spark, sf))


def accuracy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy(_measured(spark, sf))


def accuracy_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    queries = binding.scoped_queries(spark, sf)
    absent = lexical.unmatched(queries, binding.corpus(spark, sf)).groupBy("query_id").agg(F.collect_set("term").alias("unmatched"))
    known = queries.join(absent, "query_id", "left").select("query_id", "text", "unmatched", F.concat(F.lit("user_id="), "user_id").alias("scope"))
    return evaluation.accuracy_by_stratum(_measured(spark, sf), known).select("strategy", "stratum", "label", "n", "mean_ndcg", "mean_overlap10", "mean_mrr", "top1_rate", "zero10_rate", "indicative_only")


def accuracy_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The report by strategy and by scope, from a log that came in files: some of them before the first report, some after."""
    at = folder(spark)
    log, sums = f"{at}-log", f"{at}-sums"
    scopes = binding.scoped_queries(spark, sf).select("query_id", F.concat(F.lit("user_id="), "user_id").alias("scope"))
    entries = written(_measured(spark, sf).join(scopes, "query_id").withColumns({"ts": F.timestamp_seconds(F.col("query_id")), "version": F.concat(F.lit("v"), F.col("query_id") % 3)}), "entries")
    for part in (0, 1):
        entries.filter(F.pmod(F.xxhash64("query_id", "strategy"), F.lit(2)) == part).repartition(3).write.mode("append").parquet(log)
        report.ingest(spark, log, sums, ("scope",), files=2)
    return report.report(spark, sums).withColumns({"versions": F.array_join("versions", " "), "earliest": F.unix_timestamp("earliest"), "latest": F.unix_timestamp("latest")})


def replay_eval(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("legacy",), ("bm25",), ("fusion",), ("none",)], "strategy string")
    return evaluation.replay(_measured(spark, sf), binding.queries(spark, sf).select("query_id").crossJoin(F.broadcast(names)))


def winloss(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.win_loss(_measured(spark, sf), "legacy", "fusion")


def pool_union(spark: SparkSession, sf: str) -> DataFrame:
    return gold.pool(rankings(spark, sf), binding.corpus(spark, sf))


def pool_median(spark: SparkSession, sf: str) -> DataFrame:
    return gold.pool_sizes(pool_union(spark, sf))


def pool_domination(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rankings(spark, sf)
    return gold.domination(ranked, gold.pool(ranked, binding.corpus(spark, sf)))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rankings(spark, sf)
    grades = gold.pool(ranked, binding.corpus(spark, sf)).join(binding.grades(spark, sf), "doc_id").select("query_id", "doc_id", "grade")
    return evaluation.graded(ranked, grades)


def graded_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.shown(_graded(spark, sf))


def recorded_graded(spark: SparkSession, sf: str) -> DataFrame:
    """Two logged sides and their fusion at equal weights against the grades of what they ranked."""
    words, near = lexical.bm25(binding.queries(spark, sf), binding.corpus(spark, sf)), remote(spark, sf, 10)
    sides = [df.select("query_id", F.lit(name).alias("strategy"), "doc_id", "rank") for name, df in (("bm25", words), ("dense", near))]
    ranked = evaluation.recorded(written(sides[0].unionByName(sides[1]), "sides"))
    grades = gold.pool(ranked, binding.corpus(spark, sf)).join(binding.grades(spark, sf), "doc_id").select("query_id", "doc_id", "grade")
    return evaluation.shown(evaluation.graded(ranked, grades))


def graded_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.graded_summary(_graded(spark, sf))


def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 before, fusion after, on the queries that both have."""
    scored = written(_graded(spark, sf), "graded")
    run = lambda name: scored.filter(F.col("strategy") == name).withColumn("strategy", F.lit("run"))
    return evaluation.compared(run("bm25"), run("fusion"))


def grade_merge(spark: SparkSession, sf: str) -> DataFrame:
    """New grades of documents of good quality, over two files of prior ones."""
    pool = written(pool_union(spark, sf), "pool")
    labelled = pool.join(table(spark, sf, "labels"), "doc_id")
    new = labelled.filter("quality = 1").select("query_id", "doc_id", F.lit(2).alias("grade"))
    files = [labelled.filter("toxic = 0").select("query_id", "doc_id", F.col("quality").alias("grade"), F.lit(0).alias("file"))]
    files.append(labelled.select("query_id", "doc_id", (F.lit(1) - F.col("toxic")).alias("grade"), F.lit(1).alias("file")))
    return gold.merged_grades(new, reduce(DataFrame.unionByName, files), pool)


def normal_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Grades of a judge that writes numbers in many ways, and words: those that are none go."""
    written_ = F.when(F.col("event_id") % 7 == 0, "high").when(F.col("event_id") % 7 == 1, "NaN").when(F.col("event_id") % 7 == 2, "Infinity").otherwise((F.col("user_id") % 9 / 2 - 1).cast("string"))
    rows = table(spark, sf, "events").select("event_id", gold.normal_grade(written_).alias("grade"))
    return rows.filter("grade IS NOT NULL")


def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    labelled = pool_union(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    first = labelled.select("query_id", "doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    return gold.agreement(first, labelled.select("query_id", "doc_id", (F.col("quality") * 2).alias("grade")))


def fair_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours over all vectors, some of which have no document."""
    near = dense.cosine_search(binding.query_vectors(spark, sf), binding.vectors(spark, sf), 5)
    judged = table(spark, sf, "documents").filter("n_chars <= 4000")
    return evaluation.fair_subset(near, judged)


def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.head_to_head(_measured(spark, sf))


def fusion_unweighted(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.bm25(binding.queries(spark, sf), binding.corpus(spark, sf))
    fused = fusion.fuse({"lexical": (words, 1.0), "dense": (remote(spark, sf, 10), 1.0)}, 10)
    return fused.select("query_id", "doc_id", "score", "rank")


def run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as a judging run: its turns as judgments, its users' characters as tokens."""
    runs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.count(F.lit(1)).alias("judgments"), F.count_if(F.col("role") == "system").alias("missing"), F.sum(F.char_length("text")).alias("tokens"), (F.sum(F.char_length("text")) * 0.001).alias("cost")
    )
    return evaluation.run_totals(runs)


def log_by_date(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("strategy"), F.floor("value").alias("overlap"))
    return evaluation.by_local_date(entries)


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    queries = binding.scoped_queries(spark, sf).select("query_id", "text", F.concat(F.lit("user_id="), "user_id").alias("scope"))
    return gold.prompts(queries, pool_union(spark, sf), binding.corpus(spark, sf), "Grade 0, 1 or 2.").select("query_id", F.md5("prompt").alias("prompt_md5"))


def embed_cache(spark: SparkSession, sf: str) -> DataFrame:
    """What users said, in a cache of what everyone said in first turns."""
    turns = table(spark, sf, "conversations")
    cache = turns.filter("turn = 0").select(dense.cache_key(F.col("text")).alias("key")).distinct().select("key", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vec"))
    known, missing = dense.from_cache(turns.filter("role = 'user'"), cache, "m")
    return known.select("key", F.lit(True).alias("known")).unionByName(missing.select("key", F.lit(False).alias("known")))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_mrr, ndcg_vs_remote, overlap_full_remote, accuracy_summary, accuracy_by_stratum, accuracy_streamed, replay_eval, winloss,
        pool_union, pool_median, pool_domination, graded_metrics, graded_summary, compare_runs, grade_merge, normal_grades, judge_agreement,
        fair_subset, head_to_head, fusion_unweighted, recorded_graded, run_totals, log_by_date, judge_prompts, embed_cache,
    )
}


def _mean(x: str) -> str:
    return f"(sum(({x})::DECIMAL(30, 12))::DOUBLE / count({x}))"


_RANKS = f"""{bm25_sql(50)}, {cosine_sql(50, where=KNOWN)}, {fused_sql(0.4)}, {legacy_sql(10)}, remote AS (SELECT query_id, doc_id, rank FROM cosine),
    r AS (SELECT query_id, 'legacy' AS strategy, doc_id, rank FROM legacy UNION ALL SELECT query_id, 'bm25', doc_id, rank FROM bm25 WHERE rank <= 10
        UNION ALL SELECT query_id, 'fusion', doc_id, rank FROM fused WHERE rank <= 10)"""
_MEASURED = f"""{_RANKS}, best AS (SELECT query_id, sum(CASE WHEN rank = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END / log2(rank + 1)) AS idcg FROM remote WHERE rank <= 10 GROUP BY 1),
    measured AS (SELECT r.query_id, r.strategy, count(*) FILTER (r.rank <= 5 AND m.rank <= 5) AS overlap5, count(*) FILTER (r.rank <= 10 AND m.rank <= 10) AS overlap10,
        coalesce(max(CASE WHEN m.rank = 1 THEN 1.0::DOUBLE / r.rank END), 0) AS mrr, coalesce(bool_or(m.rank = 1 AND r.rank = 1), false) AS top1,
        sum(CASE WHEN m.rank = 1 THEN 3.0::DOUBLE WHEN m.rank <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END / log2(r.rank + 1)) / any_value(b.idcg) AS ndcg
        FROM r JOIN best b ON b.query_id = r.query_id LEFT JOIN remote m ON m.query_id = r.query_id AND m.doc_id = r.doc_id GROUP BY ALL)"""
_POOL = f"{_RANKS}, pool AS (SELECT DISTINCT query_id, doc_id FROM r)"
_GRADED = f"""{_POOL}, g AS (SELECT p.query_id, p.doc_id, quality + 1 - toxic AS grade FROM pool p JOIN labels l ON l.doc_id = p.doc_id),
    ideal AS (SELECT query_id, sum(CASE WHEN n <= 10 THEN CASE WHEN grade >= 2 THEN 3.0::DOUBLE WHEN grade = 1 THEN 1.0::DOUBLE ELSE 0 END / log2(n + 1) ELSE 0 END) AS idcg, count(*) FILTER (grade >= 1) AS relevant
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g) GROUP BY 1),
    scored AS (SELECT r.query_id, r.strategy, any_value(idcg) AS idcg, any_value(relevant) AS relevant,
        sum(CASE WHEN g.grade >= 2 THEN 3.0::DOUBLE WHEN g.grade = 1 THEN 1.0::DOUBLE ELSE 0 END / log2(r.rank + 1)) AS dcg, count(*) FILTER (g.grade >= 1) AS found,
        count(*) FILTER (g.grade >= 1 AND r.rank <= 5) AS found5, max(CASE WHEN g.grade >= 1 THEN 1.0::DOUBLE / r.rank END) AS mrr
        FROM r JOIN ideal i ON i.query_id = r.query_id LEFT JOIN g ON g.query_id = r.query_id AND g.doc_id = r.doc_id GROUP BY ALL),
    metrics AS (SELECT query_id, strategy, dcg / nullif(idcg, 0) AS ndcg, found::DOUBLE / nullif(relevant, 0) AS recall, found5 / 5.0::DOUBLE AS prec5,
        coalesce(mrr, 0) AS mrr, (found > 0)::INTEGER AS hit, (found = 0)::INTEGER AS zero, (relevant = 0)::INTEGER AS no_answer FROM scored)"""
_RECORDED = f"""{bm25_sql(10)}, {cosine_sql(10, where=KNOWN)}, {fused_sql(1.0, top=10)}, r AS (SELECT query_id, 'bm25' AS strategy, doc_id, rank FROM bm25
        UNION ALL SELECT query_id, 'dense', doc_id, rank FROM cosine UNION ALL SELECT query_id, 'fusion_recorded', doc_id, rank FROM fused)"""
_ACCURACY = f"""count(*) AS n, round({_mean("ndcg")}, 6) AS mean_ndcg, round({_mean("overlap5")}, 6) AS mean_overlap5, round({_mean("overlap10")}, 6) AS mean_overlap10, round({_mean("mrr")}, 6) AS mean_mrr,
    round({_mean("top1::INTEGER")}, 6) AS top1_rate, round({_mean("(overlap10 = 0)::INTEGER")}, 6) AS zero10_rate, round({_mean("(mrr > 0)::INTEGER")}, 6) AS top1_in_10_rate,
    round({_mean("(overlap5 >= 5)::INTEGER")}, 6) AS perfect5_rate, count(*) < 30 AS indicative_only"""
ORACLE_SQL = {
    "overlap_mrr": f"WITH {_MEASURED} SELECT query_id, strategy, overlap5, overlap10, round(mrr, 6) AS mrr, top1 FROM measured",
    "ndcg_vs_remote": f"WITH {_MEASURED} SELECT query_id, strategy, round(ndcg, 6) AS ndcg FROM measured",
    "overlap_full_remote": f"WITH {_RANKS} SELECT r.query_id, r.strategy, count(m.doc_id) AS overlap FROM r LEFT JOIN remote m ON m.query_id = r.query_id AND m.doc_id = r.doc_id GROUP BY ALL",
    "accuracy_summary": f"WITH {_MEASURED} SELECT strategy, {_ACCURACY} FROM measured GROUP BY strategy",
    "accuracy_by_stratum": f"""WITH {binding.SCOPED}, {_MEASURED}, absent AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM scoped)
            WHERE term NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) FROM documents)),
        known AS (SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM absent) THEN 'terms absent from corpus' ELSE 'terms present' END AS vocabulary,
            CASE WHEN length(trim(text, ' ')) = 0 THEN 'empty' WHEN length(trim(text, ' ')) <= 8 THEN '<=8' WHEN length(trim(text, ' ')) <= 24 THEN '9-24' ELSE '>24' END AS bucket, 'user_id=' || user_id AS scope FROM scoped),
        rows_ AS (SELECT * FROM measured JOIN known USING (query_id)),
        long AS (SELECT *, 'overall' AS stratum, 'all' AS label FROM rows_ UNION ALL SELECT *, 'vocabulary', vocabulary FROM rows_
            UNION ALL SELECT *, 'length', bucket FROM rows_ UNION ALL SELECT *, 'scope', scope FROM rows_)
        SELECT * EXCLUDE (mean_overlap5, top1_in_10_rate, perfect5_rate) FROM (SELECT strategy, stratum, label, {_ACCURACY} FROM long GROUP BY ALL)""",
    "accuracy_streamed": f"""WITH {binding.SCOPED}, {_MEASURED}, known AS (SELECT query_id, 'user_id=' || user_id AS scope FROM scoped), rows_ AS (SELECT * FROM measured JOIN known USING (query_id)),
        long AS (SELECT *, 'overall' AS stratum, 'all' AS label FROM rows_ UNION ALL SELECT *, 'scope', scope FROM rows_)
        SELECT stratum, label, strategy, {_ACCURACY}, min(query_id) AS earliest, max(query_id) AS latest, string_agg(DISTINCT 'v' || query_id % 3, ' ' ORDER BY 'v' || query_id % 3 DESC) AS versions FROM long GROUP BY stratum, label, strategy""",
    "replay_eval": f"""WITH {_MEASURED}, everything AS (SELECT item_id AS query_id, s AS strategy FROM benchmark CROSS JOIN (SELECT unnest(['legacy', 'bm25', 'fusion', 'none']) AS s))
        SELECT strategy, count(*) AS n, round({_mean("coalesce(overlap5, 0)")}, 6) AS overlap5, round({_mean("coalesce(overlap10, 0)")}, 6) AS overlap10, round({_mean("coalesce(mrr, 0)")}, 6) AS mrr,
            round({_mean("(coalesce(mrr, 0) = 1)::INTEGER")}, 6) AS top1, round({_mean("(coalesce(mrr, 0) > 0)::INTEGER")}, 6) AS top1_in_10,
            round({_mean("(coalesce(overlap5, 0) = 0)::INTEGER")}, 6) AS zero5, round({_mean("(overlap5 IS NULL)::INTEGER")}, 6) AS empty
        FROM everything LEFT JOIN measured USING (query_id, strategy) GROUP BY strategy""",
    "winloss": f"""WITH {_MEASURED} SELECT count(*) FILTER (b.overlap10 > a.overlap10) AS better, count(*) FILTER (b.overlap10 < a.overlap10) AS worse, count(*) FILTER (b.overlap10 = a.overlap10) AS unchanged
        FROM measured a JOIN measured b ON a.query_id = b.query_id AND a.strategy = 'legacy' AND b.strategy = 'fusion'""",
    "pool_union": f"WITH {_POOL} SELECT query_id, doc_id FROM pool",
    "pool_median": f"""WITH {_POOL}, s AS (SELECT count(*) AS size FROM pool GROUP BY query_id)
        SELECT list_sort(list(size))[(count(*) // 2 + 1)::BIGINT] AS median, min(size) AS least, max(size) AS most FROM s""",
    "pool_domination": f"""WITH {_POOL}, s AS (SELECT query_id, count(*) AS size FROM pool GROUP BY 1), o AS (SELECT query_id, strategy, count(*) AS own FROM r GROUP BY ALL)
        SELECT strategy, round(avg(own::DOUBLE / size), 6) AS share FROM o JOIN s USING (query_id) GROUP BY strategy""",
    "graded_metrics": f"WITH {_GRADED} SELECT * REPLACE (round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(prec5, 6) AS prec5, round(mrr, 6) AS mrr) FROM metrics",
    "graded_summary": f"""WITH {_GRADED} SELECT strategy, count(*) AS n, round(coalesce({_mean("ndcg")}, 0), 6) AS mean_ndcg, round(coalesce({_mean("recall")}, 0), 6) AS mean_recall, round({_mean("prec5")}, 6) AS mean_prec5,
        round({_mean("mrr")}, 6) AS mean_mrr, round({_mean("hit")}, 6) AS mean_hit, round({_mean("zero")}, 6) AS mean_zero, sum(no_answer)::BIGINT AS no_answer FROM metrics GROUP BY strategy""",
    "compare_runs": f"""WITH {_GRADED} SELECT 'run' AS strategy, count(*) AS shared,
        round(coalesce({_mean("a.ndcg")}, 0), 6) AS ndcg_before, round(coalesce({_mean("b.ndcg")}, 0), 6) AS ndcg_after, round(coalesce({_mean("b.ndcg")}, 0) - coalesce({_mean("a.ndcg")}, 0), 6) AS ndcg_delta,
        round(coalesce({_mean("a.recall")}, 0), 6) AS recall_before, round(coalesce({_mean("b.recall")}, 0), 6) AS recall_after, round(coalesce({_mean("b.recall")}, 0) - coalesce({_mean("a.recall")}, 0), 6) AS recall_delta,
        round({_mean("a.mrr")}, 6) AS mrr_before, round({_mean("b.mrr")}, 6) AS mrr_after, round({_mean("b.mrr")} - {_mean("a.mrr")}, 6) AS mrr_delta
        FROM metrics a JOIN metrics b ON a.query_id = b.query_id AND a.strategy = 'bm25' AND b.strategy = 'fusion'""",
    "grade_merge": f"""WITH {_POOL}, l AS (SELECT p.query_id, p.doc_id, quality, toxic FROM pool p JOIN labels l ON l.doc_id = p.doc_id)
        SELECT query_id, doc_id, CASE WHEN quality = 1 THEN 2 WHEN toxic = 0 THEN quality ELSE 1 - toxic END AS grade, CASE WHEN quality = 1 THEN 'new' ELSE 'prior' END AS source FROM l""",
    "normal_grades": """SELECT event_id, CASE WHEN g <= 0 THEN 0 WHEN g >= 2 THEN 2 WHEN g >= 1 THEN 1 ELSE 0 END AS grade FROM (SELECT event_id, user_id % 9 / 2 - 1 AS g FROM events WHERE event_id % 7 > 2)""",
    "judge_agreement": f"""WITH {_POOL}, c AS (SELECT quality + 1 - toxic AS first, quality * 2 AS second, count(*) AS n FROM pool p JOIN labels l ON l.doc_id = p.doc_id GROUP BY ALL)
        SELECT first, second, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM c""",
    "fair_subset": f"""WITH {cosine_sql(5)}, judged AS (SELECT doc_id FROM documents WHERE n_chars <= 4000)
        SELECT query_id FROM cosine GROUP BY 1 HAVING count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM judged)) = 0""",
    "head_to_head": f"""WITH {_MEASURED}, shared AS (SELECT query_id FROM measured GROUP BY 1 HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM measured))
        SELECT strategy, count(*) AS n, round({_mean("overlap5")}, 6) AS overlap5, round({_mean("overlap10")}, 6) AS overlap10, round({_mean("mrr")}, 6) AS mrr, round({_mean("(mrr = 1)::INTEGER")}, 6) AS top1
        FROM measured WHERE query_id IN (SELECT query_id FROM shared) GROUP BY strategy""",
    "recorded_graded": f"WITH {_GRADED.replace(_RANKS, _RECORDED)} SELECT * REPLACE (round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(prec5, 6) AS prec5, round(mrr, 6) AS mrr) FROM metrics",
    "fusion_unweighted": f"WITH {bm25_sql(10)}, {cosine_sql(10, where=KNOWN)}, {fused_sql(1.0, top=10)} SELECT query_id, doc_id, score, rank FROM fused",
    "run_totals": """WITH r AS (SELECT count(*) AS judgments, count(*) FILTER (role = 'system') AS missing, sum(length(text)) AS tokens FROM conversations GROUP BY conv_id)
        SELECT count(*) AS queries, sum(judgments)::BIGINT AS judgments, count(*) FILTER (missing > 0) AS incomplete, sum(tokens)::BIGINT AS tokens, round(sum(tokens::DOUBLE * 0.001::DOUBLE), 6) AS cost FROM r""",
    "log_by_date": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS strategy, count(*) AS n, round({_mean('floor(value)')}, 6) AS overlap FROM events GROUP BY ALL",
    "judge_prompts": f"""WITH {binding.SCOPED}, {_POOL}, lines AS (SELECT p.query_id, string_agg(p.doc_id || ': ' || regexp_replace(substr(d.text, 1, 1200), '\\s+', ' ', 'g'), chr(10) ORDER BY p.doc_id) AS body
            FROM pool p JOIN documents d ON d.doc_id = p.doc_id GROUP BY 1)
        SELECT query_id, md5('Query: ' || text || chr(10) || 'Scope: user_id=' || user_id || chr(10) || chr(10) || 'Grade 0, 1 or 2.' || chr(10) || chr(10) || body) AS prompt_md5 FROM scoped JOIN lines USING (query_id)""",
    "embed_cache": """WITH c AS (SELECT substr(sha256(text), 1, 16) AS key FROM conversations WHERE turn = 0)
        SELECT DISTINCT substr(sha256(text), 1, 16) AS key, substr(sha256(text), 1, 16) IN (SELECT key FROM c) AS known FROM conversations WHERE role = 'user'""",
}
