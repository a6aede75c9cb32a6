"""Evaluation of rankings: agreement with another ranking, graded metrics, strata, comparisons.

Rankings are (query_id, strategy, doc_id, rank); the ranking agreed with is (query_id, doc_id, rank); grades are
(query_id, doc_id, grade). Everything is a join and an aggregation over all queries at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ranking import discount, gain
from ..functions.text import length_bucket

INDICATIVE_BELOW = 30


def _r(c: Column) -> Column:
    return F.round(c, 6)


def mean(c: Column | str) -> Column:
    """The mean of what is not null, from a sum of decimals: it does not depend on the order of rows, and is rounded by no one yet."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(30,12)")).cast("double") / F.count(c)


def shown(measured: DataFrame) -> DataFrame:
    """The measures of each query to six decimals, for reading: means are taken of the measures as they are."""
    return measured.withColumns({c: _r(F.col(c)) for c in ("ndcg", "recall", "prec5", "mrr") if c in measured.columns})


def ideal(grades: DataFrame, k: int) -> DataFrame:
    """(query_id, idcg): the best gain that a ranking of the graded documents can have."""
    sorted_ = F.slice(F.array_sort(F.collect_list(-gain(F.col("grade")))), F.lit(1), F.lit(k))
    summed = F.aggregate(F.zip_with(sorted_, F.sequence(F.lit(1), F.greatest(F.size(sorted_), F.lit(1))), lambda g, i: F.coalesce(-g, F.lit(0.0)) / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    return grades.groupBy("query_id").agg(summed.alias("idcg"))


def remote_grades(remote: DataFrame, k: int) -> DataFrame:
    """The remote's first result as grade 2, the rest of its first k as grade 1."""
    return remote.filter(F.col("rank") <= k).select("query_id", "doc_id", F.when(F.col("rank") == 1, 2).otherwise(1).alias("grade"))


def agreement(rankings: DataFrame, remote: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, strategy, overlap5, overlap10, mrr, ndcg, top1): each ranking against the remote one.

    Overlaps compare the first 5 (10) of both; mrr is the reciprocal rank of the remote's first result among the
    first 10; a query with an empty remote ranking is not compared."""
    there = remote.select("query_id", "doc_id", F.col("rank").alias("remote_rank"))
    rows = rankings.join(remote.select("query_id").distinct(), "query_id", "left_semi").join(there, ["query_id", "doc_id"], "left")
    both = lambda n: F.count_if((F.col("rank") <= n) & (F.col("remote_rank") <= n))
    first = (F.col("remote_rank") == 1) & (F.col("rank") <= 10)
    graded = F.when(F.col("remote_rank") == 1, 2).when(F.col("remote_rank") <= k, 1).otherwise(0)
    dcg = F.sum(F.when(F.col("rank") <= k, gain(graded) * discount(F.col("rank"))).otherwise(0.0))
    out = rows.groupBy("query_id", "strategy").agg(
        both(5).alias("overlap5"),
        both(10).alias("overlap10"),
        F.coalesce(F.max(F.when(first, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        dcg.alias("dcg"),
        F.coalesce(F.max((F.col("rank") == 1) & (F.col("remote_rank") == 1)), F.lit(False)).alias("top1"),
    )
    scored = out.join(ideal(remote_grades(remote, k), k), "query_id")
    return scored.select("query_id", "strategy", "overlap5", "overlap10", "mrr", (F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))).alias("ndcg"), "top1")


def overlap_with_all(rankings: DataFrame, remote: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, strategy, overlap): how many of a ranking's first k the remote lists at any rank."""
    hits = rankings.filter(F.col("rank") <= k).join(remote.select("query_id", "doc_id").withColumn("there", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id", "strategy").agg(F.coalesce(F.sum("there"), F.lit(0)).alias("overlap"))


_MEANS = (("ndcg", "mean_ndcg"), ("overlap5", "mean_overlap5"), ("overlap10", "mean_overlap10"), ("mrr", "mean_mrr"))


def _accuracy() -> list[Column]:
    rate = lambda c: _r(mean(c.cast("int")))
    return [
        F.count(F.lit(1)).alias("n"),
        *[_r(mean(a)).alias(b) for a, b in _MEANS],
        rate(F.col("top1")).alias("top1_rate"),
        rate(F.col("overlap10") == 0).alias("zero10_rate"),
        rate(F.col("mrr") > 0).alias("top1_in_10_rate"),
        rate(F.col("overlap5") >= 5).alias("perfect5_rate"),
        (F.count(F.lit(1)) < INDICATIVE_BELOW).alias("indicative_only"),
    ]


def accuracy(measured: DataFrame) -> DataFrame:
    """Per strategy, over the queries for which it ran."""
    return measured.groupBy("strategy").agg(*_accuracy())


def accuracy_by_stratum(measured: DataFrame, queries: DataFrame) -> DataFrame:
    """(strategy, stratum, label, ...): overall, and by vocabulary, length and scope, in one pass over grouping sets.

    ``queries``: query_id, text, unmatched (terms that no document has), scope (a label)."""
    known = queries.select(
        "query_id",
        F.when(F.coalesce(F.size("unmatched"), F.lit(0)) > 0, "terms absent from corpus").otherwise("terms present").alias("vocabulary"),
        length_bucket(F.col("text")).alias("length"),
        "scope",
    )
    rows = measured.join(known, "query_id")
    sets = [[F.col("strategy")], *[[F.col("strategy"), F.col(c)] for c in ("vocabulary", "length", "scope")]]
    g = F.grouping_id("strategy", "vocabulary", "length", "scope")
    out = rows.groupingSets(sets, "strategy", "vocabulary", "length", "scope").agg(g.alias("g"), *_accuracy())
    stratum = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "vocabulary").when(F.col("g") == 5, "length").otherwise("scope")
    label = F.when(F.col("g") == 7, "all").otherwise(F.coalesce("vocabulary", "length", "scope"))
    return out.withColumns({"stratum": stratum, "label": label}).drop("g", "vocabulary", "length", "scope")


def graded(rankings: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, strategy, ndcg, recall, prec5, mrr, hit, zero, no_answer) against judged grades.

    Unjudged documents count as grade 0; nDCG and recall are null where nothing is relevant; the reciprocal rank
    looks at the whole ranking; precision at 5 always divides by 5."""
    judged = grades.groupBy("query_id").agg(F.count_if(F.col("grade") >= 1).alias("relevant"))
    rows = rankings.join(grades, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    good, within = F.col("grade") >= 1, F.col("rank") <= k
    out = rows.groupBy("query_id", "strategy").agg(
        F.sum(F.when(within, gain(F.col("grade")) * discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if(within & good).alias("found"),
        (F.count_if((F.col("rank") <= F.least(F.lit(5), F.lit(k))) & good) / 5).alias("prec5"),
        F.coalesce(F.max(F.when(good, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )
    out = out.join(judged, "query_id").join(ideal(grades, k), "query_id")
    return out.select(
        "query_id",
        "strategy",
        (F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))).alias("ndcg"),
        (F.col("found") / F.nullif(F.col("relevant"), F.lit(0))).alias("recall"),
        "prec5",
        "mrr",
        (F.col("found") > 0).cast("int").alias("hit"),
        (F.col("found") == 0).cast("int").alias("zero"),
        (F.col("relevant") == 0).cast("int").alias("no_answer"),
    )


def recorded(sides: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, strategy, doc_id, rank): logged sides as they were ranked then, and ``fusion_recorded``, the sides
    ``bm25`` and ``dense`` fused at equal weights, for scorers that cannot ask the embedder again."""
    from . import fusion

    kept = sides.filter(F.col("rank") <= top).select("query_id", "strategy", "doc_id", "rank")
    both = {name: (kept.filter(F.col("strategy") == name), 1.0) for name in ("bm25", "dense")}
    return kept.unionByName(fusion.fuse(both, top).select("query_id", F.lit("fusion_recorded").alias("strategy"), "doc_id", "rank"))


def graded_summary(scored: DataFrame) -> DataFrame:
    means = [_r(F.coalesce(mean(c), F.lit(0.0))).alias(f"mean_{c}") for c in ("ndcg", "recall", "prec5", "mrr", "hit", "zero")]
    return scored.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *means, F.sum("no_answer").alias("no_answer"))


def replay(measured: DataFrame, everything: DataFrame) -> DataFrame:
    """Per strategy over all queries (query_id, strategy), those without any result included."""
    rows = everything.join(measured, ["query_id", "strategy"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        _r(mean(zero("overlap5"))).alias("overlap5"),
        _r(mean(zero("overlap10"))).alias("overlap10"),
        _r(mean(zero("mrr"))).alias("mrr"),
        _r(mean((zero("mrr") == 1).cast("int"))).alias("top1"),
        _r(mean((zero("mrr") > 0).cast("int"))).alias("top1_in_10"),
        _r(mean((zero("overlap5") == 0).cast("int"))).alias("zero5"),
        _r(mean(F.col("overlap5").isNull().cast("int"))).alias("empty"),
    )


def win_loss(measured: DataFrame, before: str, after: str, metric: str = "overlap10") -> DataFrame:
    """One row: queries that are better, worse or the same under ``after`` than under ``before``."""
    side = lambda s, n: measured.filter(F.col("strategy") == s).select("query_id", F.col(metric).alias(n))
    both = side(before, "x").join(side(after, "y"), "query_id")
    return both.agg(F.count_if(F.col("y") > F.col("x")).alias("better"), F.count_if(F.col("y") < F.col("x")).alias("worse"), F.count_if(F.col("y") == F.col("x")).alias("unchanged"))


def compared(before: DataFrame, after: DataFrame, metrics: tuple[str, ...] = ("ndcg", "recall", "mrr")) -> DataFrame:
    """Means of shared queries before and after, and their difference, per strategy."""
    old = before.select("query_id", "strategy", *[F.col(m).alias(f"{m}_old") for m in metrics])
    both = after.join(old, ["query_id", "strategy"])
    average = lambda c: F.coalesce(mean(c), F.lit(0.0))
    columns = [c for m in metrics for c in (_r(average(f"{m}_old")).alias(f"{m}_before"), _r(average(m)).alias(f"{m}_after"), _r(average(m) - average(f"{m}_old")).alias(f"{m}_delta"))]
    return both.groupBy("strategy").agg(F.count(F.lit(1)).alias("shared"), *columns)


def fair_subset(remote: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id): queries whose remote results are all still in the corpus."""
    gone = remote.join(corpus.select("doc_id"), "doc_id", "left_anti").select("query_id")
    return remote.select("query_id").distinct().join(gone, "query_id", "left_anti")


def head_to_head(measured: DataFrame) -> DataFrame:
    """Per strategy, over the queries for which every strategy of ``measured`` ran: one denominator for all."""
    strategies = measured.agg(F.countDistinct("strategy").alias("all"))
    shared = measured.groupBy("query_id").agg(F.countDistinct("strategy").alias("n")).crossJoin(F.broadcast(strategies)).filter("n = all").select("query_id")
    rows = measured.join(shared, "query_id", "left_semi")
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), *[_r(mean(c)).alias(c) for c in ("overlap5", "overlap10", "mrr")], _r(mean((F.col("mrr") == 1).cast("int"))).alias("top1"))


def run_totals(runs: DataFrame) -> DataFrame:
    """One row of a judging run (query_id, judgments, missing, tokens, cost)."""
    return runs.agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("judgments").alias("judgments"),
        F.count_if(F.col("missing") > 0).alias("incomplete"),
        F.sum("tokens").alias("tokens"),
        _r(F.sum("cost")).alias("cost"),
    )


def by_local_date(entries: DataFrame) -> DataFrame:
    """(day, strategy, n, mean overlap): entries (ts in ms, strategy, overlap) by calendar day of the session's time zone."""
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    return entries.groupBy(day.alias("day"), "strategy").agg(F.count(F.lit(1)).alias("n"), _r(mean("overlap")).alias("overlap"))


def report_text(rows: list, columns: tuple[str, ...], indicative: str = "indicative_only") -> str:
    """A fixed-width table of an accuracy result that was collected, best nDCG first."""
    ordered = sorted(rows, key=lambda r: -(r["mean_ndcg"] or 0))
    table = [columns, *[tuple(str(r[c]) for c in columns) for r in ordered]]
    widths = [max(len(row[i]) for row in table) for i in range(len(columns))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(row, widths)).rstrip() for row in table]
    notes = [f"{r['strategy']}: n={r['n']}, indicative only" for r in ordered if r[indicative]]
    return "\n".join(lines + notes)
