"""Stored indexes against the operators that read everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import cells, dense, evaluation, inverted, lexical
from marlstone.streaming.runs import folder

WORDS = ["alpha", "beta", "gamma_1", "Delta", "İnci", "備份", "作業排程", "x", "42", "K9"]


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i * 37 - 500, " ".join(rng.choices(WORDS, [2**-i for i in range(len(WORDS))], k=rng.randrange(0, 30)))) for i in range(n)]
    return rows + [(10**12, "alpha 作業"), (10**12 + 1, None), (None, "alpha beta")]


def frame(spark, rows, id_col="doc_id"):
    return spark.createDataFrame(rows, f"{id_col} long, text string").repartition(3)


QUERIES = [(1, "alpha gamma_1"), (2, "備份作業"), (3, "nothing of it"), (4, ""), (5, None), (6, "delta x 42 K9 inci"), (None, "alpha"), (7, "alpha alpha")]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.mark.parametrize("top, block_bytes", [(3, 40), (10, 1 << 20)])
def test_index_equals_the_scan_and_the_join(spark, top, block_bytes):
    docs, asked, at = frame(spark, corpus(spark, 700)), frame(spark, QUERIES, "query_id"), folder(spark)
    inverted.build(docs, at)
    expected = rows_of(lexical.bm25(asked, docs, top))
    assert rows_of(inverted.search(asked, at, top, block_bytes=block_bytes)) == expected
    assert rows_of(lexical.bm25(asked, docs, top, block_terms=0)) == expected and len(expected) > top


def test_changes_come_as_signed_rows(spark):
    asked, at, then = frame(spark, QUERIES, "query_id"), folder(spark), folder(spark)
    first, second = corpus(spark, 300), corpus(spark, 300, seed=2)
    inverted.build(frame(spark, first), at)
    inverted.changed(frame(spark, first[:150]), frame(spark, second[:150]), at)  # replaced
    inverted.changed(frame(spark, first[150:200]), frame(spark, first[:0]), at)  # deleted
    inverted.changed(frame(spark, first[:0]), frame(spark, [(999_999, "alpha x")]), at)  # added
    now = frame(spark, second[:150] + first[200:] + [(999_999, "alpha x")])
    expected = rows_of(lexical.bm25(asked, now))
    assert rows_of(inverted.search(asked, at)) == expected
    inverted.compacted(spark, at, then)
    assert rows_of(inverted.search(asked, then)) == expected
    assert inverted.lists(spark, then).filter("sign < 0").isEmpty() and inverted.totals(spark, then) == inverted.totals(spark, at)


def test_bounds_leave_slices_unread_and_only_buckets_of_terms_are_read(spark):
    block = inverted.Block([(1, ["rare", "common"])], 2)
    block.weigh(16_384, 16_384 * 4, {"rare": 4, "common": 16_000})
    docs = np.arange(0, 16_000, dtype=np.int64)
    raw = lambda x, kind: np.asarray(x).astype(kind).tobytes()
    one = np.ones(16_000, np.int64)
    parts = np.unique(docs // inverted.SLICE)
    common = (block.names.index("common"), 1, raw(np.diff(docs, prepend=0), "<u2"), raw(one, "<i4"), raw(4 * one, "<i4"), raw(parts, "<u1"), raw(np.ones(len(parts)), "<i4"), raw(4 * np.ones(len(parts)), "<i4"))
    own = np.array([5, 300, 301, 9_000])
    near = np.unique(own // inverted.SLICE)
    rare = (block.names.index("rare"), 1, raw(np.diff(own, prepend=0), "<u2"), raw([1, 1, 2, 1], "<i4"), raw([4, 4, 4, 4], "<i4"), raw(near, "<u1"), raw([1, 2, 1], "<i4"), raw([4, 4, 4], "<i4"))
    kept = inverted.Kept(1, 2)
    scored = inverted.Chunk(0, [common, rare], block).search(kept)
    assert kept.doc.tolist() == [301, 5] and scored <= inverted.EAGER + 2 < len(parts)
    at = folder(spark)
    inverted.build(frame(spark, corpus(spark, 50)), at)
    plan = inverted.search(frame(spark, [(1, "alpha")], "query_id"), at)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]


def test_index_of_nothing(spark):
    at = folder(spark)
    inverted.build(frame(spark, []), at)
    assert inverted.search(frame(spark, QUERIES, "query_id"), at).collect() == []


def test_keywords_null_ids_and_single_characters(spark):
    docs = frame(spark, [(1, "subalphabet 備"), (2, None), (None, "alpha"), (3, "ALPHA_bet x1"), (4, "x 1 ａ"), (5, "")])
    asked = frame(spark, [(1, "alpha x1 x1"), (2, "備份 ａ"), (None, "alpha"), (3, "")], "query_id")
    assert rows_of(lexical.keyword_hits(asked, docs)) == [(1, 1, 1.0, 2), (1, 3, 3.0, 1), (2, 1, 1.0, 1), (2, 4, 1.0, 2)]


def vectors(rng, n, dims=6):
    groups = rng.normal(size=(5, dims))
    out = [(i, (groups[i % 5] + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]
    return out + [(n, [0.0] * dims), (n + 1, out[0][1]), (n + 2, out[0][1]), (None, out[1][1]), (n + 3, None), (n + 4, (-groups[0]).tolist())]


@pytest.mark.parametrize("top, positive", [(5, False), (5, True), (1000, False)])
def test_cells_equal_the_scan_and_most_stay_unread(spark, top, positive):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 600)
    stored = spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(q, rows[q * 7][1]) for q in range(12)] + [(50, [0.0] * 6), (51, None), (None, rows[0][1])], "query_id long, vec array<double>")
    at = folder(spark)
    cells.build(stored, at)
    found = cells.search(asked, at, top, positive)
    assert rows_of(found.rankings) == rows_of(dense.cosine_search(asked, stored, top, positive))
    assert found.read < 0.6 or top > 100
    assert rows_of(cells.search(asked, at, top, positive, block_bytes=600).rankings) == rows_of(found.rankings)


def test_cells_of_nothing(spark):
    schema, at = "doc_id long, vec array<double>", folder(spark)
    cells.build(spark.createDataFrame([], schema), at)
    assert cells.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>"), at).rankings.collect() == []
    at = folder(spark)
    cells.build(spark.createDataFrame([(1, [0.0, 0.0])], schema), at)
    assert [tuple(r) for r in cells.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>"), at).rankings.collect()] == [(1, 1, 0.0, 1)]


def test_means_are_rounded_once_and_do_not_depend_on_the_order(spark):
    # Ten measures whose mean ends in 5 at the seventh place; and thirds, which no double holds.
    for values in ([0.125, 0.25, 0.5, 1.0, 0.000005] + [0.2] * 5, [1 / 3] * 7 + [1 / 6, 1 / 7, 0.1]):
        means = set()
        for seed in range(4):
            rows = random.Random(seed).sample(list(enumerate(values)), 10)
            means.add(spark.createDataFrame(rows, "i int, v double").repartition(seed + 1).agg(F.round(evaluation.mean("v"), 6).alias("m")).first().m)
        assert means == ({0.287501} if 0.125 in values else {0.274286})
    assert spark.createDataFrame([(None,)], "v double").agg(evaluation.mean("v").alias("m")).first().m is None


def test_a_channel_and_a_tokenizer_of_ones_own(spark):
    from marlstone.functions import tables
    from marlstone.operators import recall

    docs, asked = frame(spark, [(1, "Alpha-beta one"), (2, "alpha two"), (3, None)]), frame(spark, [(1, "alpha-beta")], "query_id")
    spaced = lambda text: F.filter(F.split(F.lower(text), " +"), lambda t: t != "")
    assert [(r.doc_id, r["rank"]) for r in lexical.bm25(asked, docs, tokenize=spaced).collect()] == [(1, 1)]
    only = lambda queries, corpus, scope, pool: queries.select("query_id", F.lit(2).cast("long").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    found = recall.recall(asked, docs, requested="bm25", also={"two": (only, 5.0)})
    assert [r.doc_id for r in found.rankings.orderBy("rank").collect()] == [2, 1] and found.status == {"lexical": "ok", "two": "ok"} and found.served == "bm25"
    tables.register(spark, "my_terms", letters=list)
    docs.createOrReplaceTempView("my_docs")
    assert {tuple(r) for r in spark.sql("SELECT * FROM my_terms(TABLE(SELECT * FROM my_docs WHERE doc_id = 2), 'bm25')").collect()} == {(2, "alpha", 1, 2), (2, "two", 1, 2)}
    assert spark.sql("SELECT sum(tf) AS n FROM my_terms(TABLE(my_docs), 'letters')").first().n == 23
    with pytest.raises(Exception, match="no tokenizer"):
        spark.sql("SELECT * FROM my_terms(TABLE(my_docs), 'none')").collect()


def test_lists_meet_across_batches_without_a_call_for_each(spark):
    import pyarrow as pa

    docs, at, then = frame(spark, corpus(spark, 300)), folder(spark), folder(spark)
    inverted.build(docs, at)
    inverted.changed(frame(spark, corpus(spark, 300)[:90]), frame(spark, corpus(spark, 300, seed=3)[:90]), at)
    rows = inverted.lists(spark, at).orderBy("term", "chunk").toArrow().combine_chunks()
    batch = rows.to_batches()[0]
    key = lambda r: (r["bucket"], r["term"], r["chunk"])
    one = [r for b in inverted._met(iter([batch])) for r in b.to_pylist()]
    for step in (1, 3):  # a list's rows fall into several batches
        parts = [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
        assert [r for b in inverted._met(iter([parts[0].slice(0, 0), *parts])) for r in b.to_pylist()] == one
    assert len({key(r) for r in one}) == len(one) < batch.num_rows and all(r["sign"] == 1 for r in one)
    inverted.compacted(spark, at, then)
    assert sorted(map(key, one)) == sorted(key(r.asDict()) for r in inverted.lists(spark, then).collect())
    # No group is a call of Python: the index's rows go through whole batches.
    inverted.compacted(spark, then, again := folder(spark))
    assert inverted.lists(spark, again).count() == len(one) and isinstance(batch, pa.RecordBatch)
