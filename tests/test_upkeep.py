import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import dense, fusion, recorder, scope as scopes
from marlstone.sources import logs
from marlstone.sources.providers import Provider, choose, error_of, vectors_of

VECTORS = "id long, model string, hash string, vec array<double>, dims int, normalized boolean"


def rows_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, memory string").coalesce(1)


def test_batches_close_by_count_and_by_characters(spark):
    rows = rows_of(spark, "a" * 5, "b" * 6, "c", "d", "e", "f" * 30, None, "")
    got = {r.id: r.batch for r in dense.embedded(rows, lambda texts: [[1.0]] * len(texts), "m", inputs=3, chars=10).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 3, 7: 4}


@pytest.mark.parametrize("answer", [lambda t: [], lambda t: [[1.0]] * (len(t) + 1), lambda t: [[]] * len(t), lambda t: [[1.0], [1.0, 2.0]], lambda t: [None] * len(t), lambda t: 1 / 0])
def test_a_bad_answer_fails_its_batch_with_a_reason(spark, answer):
    got = dense.embedded(rows_of(spark, "a", "b"), answer, "m").collect()
    assert len(got) == 2 and all(r.error and r.vec is None and r.dims is None for r in got)


def test_upkeep_goes_on_until_nothing_remains(spark, tmp_path):
    seen = str(tmp_path)

    def embed(texts):
        import os

        marks = [os.path.join(seen, t) for t in texts if t.startswith("late")]
        new = [m for m in marks if not os.path.exists(m)]
        for m in new:
            open(m, "w").close()
        if new:
            raise ValueError("not yet")
        return [[3.0, 4.0 * len(t)] for t in texts]

    corpus = rows_of(spark, "x", "late1", "y", "late2")
    stored = spark.createDataFrame([(0, "m", "former", [1.0, 0.0], 2, True), (9, "m", "gone", [1.0, 0.0], 2, True), (2, "m", "95cb0bfd2977c761298d9624e4b4d4c72a39974a", [0.0, 2.0], 2, False)], VECTORS)
    kept, report = dense.upkeep(stored, corpus, embed, "m", inputs=1)
    got = {r.id: r.vec for r in kept.collect()}
    assert got.keys() == {0, 1, 2, 3} and got[2] == [0.0, 1.0] and np.allclose(got[0], [0.6, 0.8])
    assert [(r["embedded"], r["failed_batches"], r["remaining"], r["health"]) for r in report] == [(1, 2, 2, "partial"), (2, 0, 0, "none")]


def test_upkeep_stops_where_every_batch_fails(spark):
    def embed(texts):
        raise ValueError("503")

    kept, report = dense.upkeep(spark.createDataFrame([], VECTORS), rows_of(spark, "x", "y"), embed, "m")
    assert kept.count() == 0 and [(r["health"], r["first_error"]) for r in report] == [("persistent", "503")]
    kept, report = dense.upkeep(spark.createDataFrame([], VECTORS), rows_of(spark, "x").limit(0), embed, "m")
    assert kept.count() == 0 and [r["health"] for r in report] == ["none"]


def test_a_failed_rerank_has_a_reason_and_the_pool_its_order(spark):
    pool = spark.createDataFrame([(1, 7, 0.5, 1), (1, 8, 0.4, 2)], "query_id long, doc_id long, score double, rank int")
    queries, corpus = spark.createDataFrame([(1, "q")], "query_id long, text string"), spark.createDataFrame([(7, "a"), (8, "b")], "doc_id long, text string")
    scores = fusion.rerank(pool, queries, corpus, lambda q, texts: [1.0])
    assert [tuple(r) for r in scores.collect()] == [(1, None, None, "1 scores for 2 texts")]
    assert [r.doc_id for r in fusion.apply_rerank(pool, scores).orderBy("rank").collect()] == [7, 8]


def test_entries(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red apple", "u"), (2, "green apple pie", "u"), (3, "red car", "v")], "doc_id long, text string, user_id string")
    queries = spark.createDataFrame([(1, "apple red zebra car", "u"), (2, "nothing", "u"), (3, None, None)], "query_id long, text string, user_id string")
    remote = spark.createDataFrame([(1, 2, 0.9, 1), (1, 1, 0.5, 2)], "query_id long, doc_id long, score double, rank int")
    ranked = recorder.sides(queries, corpus, scope=["user_id"])
    got = {r.query_id: r for r in recorder.entries(queries, corpus, remote, ranked, F.lit(5), version="v", scope=["user_id"]).collect()}
    one = got[1]
    assert [h.id for h in one.localBm25] == ["1", "2"] and all(h.score == round(h.score, 4) for h in one.localBm25)
    assert one.unmatched == ["zebra", "car"] and one.scope == {"user_id": "u"} and (one.overlapBm25_5, one.mrrBm25) == (2, 0.5)
    assert {h.id for h in one.local} == {"1", "2", "3"} and one.overlap10 == 2 and one.localDense is None and one.overlapVec5 is None
    assert got[2].localBm25 is None and got[2].unmatched is None and got[2].local == [] and (got[2].overlap5, got[2].mrr) == (0, 0.0)
    assert got[3].query == "" and got[3].scope is None
    at = f"file://{tmp_path}/log"
    logs.append(recorder.entries(queries, corpus, remote, ranked, F.lit(5), scope=["user_id"]).drop("query_id"), at)
    assert {(r.ts, r.strategy, r.id, r["rank"]) for r in logs.side_rankings(logs.read(spark, at)).filter("strategy = 'bm25'").collect()} >= {(5, "bm25", "1", 1), (5, "bm25", "2", 2)}


def test_the_provider_that_is_asked():
    presets = [Provider("first", "m1", "e1"), Provider("second", "m2", "e2")]
    assert choose(presets, {"second": "k"}) == Provider("second", "m2", "e2", "k")
    assert choose(presets, {"first": "a", "second": "b"}).name == "first"
    assert choose(presets, {"first": "a"}, named="second") is None and choose(presets, {"first": "a"}, named="other") is None
    assert choose(presets, {}, fallback=("second", "f"), model="own") == Provider("second", "own", "e2", "f")
    assert choose(presets, {"first": "a"}, off=True) is None and choose(presets, {}) is None


def test_answers_of_an_embedder(spark):
    bodies = ['{"data":[{"embedding":[2,0],"index":1},{"embedding":[1,0],"index":0}]}', '{"data":[{"embedding":[1]},{"embedding":[2]}]}', '{"data":[]}', '{"data":[{"embedding":[]}]}', '{"data":[{"index":0}]}', "no json", None, '{"data":[{"embedding":[1,null]}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    got = [r.v for r in df.withColumn("v", vectors_of(F.col("b"))).orderBy("i").collect()]
    assert got == [[[1.0, 0.0], [2.0, 0.0]], [[1.0], [2.0]]] + [None] * 6
    errors = [r.e for r in df.withColumn("e", error_of("x", F.when(F.col("i") == 0, 403).otherwise(200), F.col("b"))).orderBy("i").collect()]
    assert errors[0].startswith("x 403: {") and errors[1] is None and errors[2] == "x: malformed response body"


def test_scope_sizes_of_nothing_and_of_nobody(spark):
    schema = "query_id long, user_id string"
    corpus = spark.createDataFrame([(1, "u"), (2, "u"), (3, None)], "doc_id long, user_id string")
    asked = spark.createDataFrame([(1, "u"), (2, None), (3, "*"), (4, "nobody"), (5, "")], schema)
    assert {tuple(r) for r in scopes.sizes(asked, corpus, ["user_id"]).collect()} == {(1, 2), (2, 3), (3, 3), (4, 0), (5, 3)}
    assert {r.n for r in scopes.sizes(asked, corpus.limit(0), ["user_id"]).collect()} == {0} and scopes.sizes(asked.limit(0), corpus, ["user_id"]).count() == 0


def test_cost_of_an_empty_corpus(spark):
    texts, cache = spark.createDataFrame([], "text string"), spark.createDataFrame([], "key string, model string, vec array<double>")
    assert tuple(dense.cold_cost(texts, cache, "m", 1.0).first()) == (0, None, 0, 0, 0.0, 0.0)
