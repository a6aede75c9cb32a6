import random

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from marlstone.functions.vectors import cosine, unit
from marlstone.operators import dense, fusion, lexical, recall
from marlstone.plans import search_queries, strategy as st

Q, D, R = "query_id long, text string", "doc_id long, text string", "query_id long, doc_id long, rank int"


def ids(df, query=1):
    return [r.doc_id for r in df.filter(F.col("query_id") == query).orderBy("rank").collect()]


def search(spark, query, docs, **more):
    return ids(lexical.bm25(spark.createDataFrame([(1, query)], Q), spark.createDataFrame(docs, D), **more))


CJK = [(1, "东京酒店推荐"), (2, "香港出发的航班"), (3, "veeam 备份作业 设置")]


def test_bm25_orderings(spark):
    assert search(spark, "香港出发", CJK)[0] == 2
    assert search(spark, "备份作业", CJK) == [3]
    assert search(spark, "rare common", [(1, "common common common common"), (2, "rare thing"), (3, "common sight"), (4, "common place")])[0] == 2
    assert search(spark, "cat", [(1, "cat " + "dog " * 40), (2, "cat dog")]) == [2, 1]
    assert search(spark, "", CJK) == [] and search(spark, "anything", []) == []
    assert len(search(spark, "x", [(i, "x") for i in range(30)], top=7)) == 7


def test_bm25_both_ways(spark):
    rng = random.Random(3)
    words = ["香港出发", "备份", "cat", "dog", "Bird", "x1", "猫", "it_is"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice("ab")) for i in range(300)] + [(900, None, "a")]
    asked = [(i, " ".join(rng.choices(words + ["unknown"], k=rng.randint(0, 4))), rng.choice("abc")) for i in range(20)]
    Q_, D_ = spark.createDataFrame(asked, Q + ", user_id string"), spark.createDataFrame(docs, D + ", user_id string").repartition(3)
    for scope in (None, ["user_id"]):
        one, two = (sorted(tuple(r) for r in lexical.bm25(Q_, D_, 7, scope, block_terms=n).collect()) for n in (0, 10_000))
        assert one == two and one
    texts = [t for _, t, _ in docs if t] + ["K İ Σας 𠀀", "a香b港c"]
    from marlstone.functions import text as tx

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tokens(F.col("t")).alias("x"), tx.token_count(F.col("t")).alias("n")).collect()
    assert all(tx.split_tokens(r.t) == r.x and len(r.x) == r.n for r in got)


SCOPED_Q = [(1, "cat dog", "u1", None), (2, "cat", None, "a"), (3, "cat", "", "*"), (4, "cat dog", "u1", "a"), (5, "cat", "u9", None), (6, None, "u1", None), (7, "cat", "u1", ""), (7, "cat", "u1", "")]
SCOPED_D = [(1, "cat", "u1", "a"), (2, "cat dog", "u1", None), (3, "cat cat", "u2", "a"), (4, "dog cat", None, None), (5, None, "u1", "a"), (6, "cat x", "", "a"), (7, "cat y", "*", "b")]


def sees(asked, held):
    return all(a in (None, "", "*") or a == h for a, h in zip(asked, held))


def scoped_frames(spark):
    more = ", user_id string, app_id string"
    return spark.createDataFrame(SCOPED_Q, Q + more), spark.createDataFrame(SCOPED_D, D + more).repartition(3)


def test_scopes_are_one_rule_in_every_channel(spark):
    queries, docs = scoped_frames(spark)
    names = ["user_id", "app_id"]
    held = {(q, d) for q, text, *a in SCOPED_Q for d, doc, *h in SCOPED_D if text and doc and sees(a, h) and set(text.split()) & set(doc.split())}
    by_block, by_join = (sorted(tuple(r) for r in lexical.bm25(queries, docs, 10, names, block_terms=n).collect()) for n in (10_000, 0))
    assert by_block == by_join and {(q, d) for q, d, *_ in by_block} == held
    # Statistics are those of what a query sees: its scope alone as a corpus gives the same scores.
    for q, text, *a in SCOPED_Q[:5]:
        own = docs.filter(F.col("doc_id").isin([d for d, _, *h in SCOPED_D if sees(a, h)] or [-1]))
        alone = lexical.bm25(queries.filter(F.col("query_id") == q).select("query_id", "text"), own.select("doc_id", "text"), 10).collect()
        assert sorted((r.doc_id, r.score) for r in alone) == sorted((d, s) for i, d, s, _ in by_block if i == q)
    legacy = recall.recall(queries, docs, requested="legacy", scope=names)
    assert {(r.query_id, r.doc_id) for r in legacy.rankings.collect()} == held
    late = recall.recall(queries, docs, requested="legacy", scope=names, top=2, reference_compat=True).rankings.collect()
    assert {(r.query_id, r.doc_id) for r in late} < held and len(late) < len(legacy.rankings.filter("rank <= 2").collect())
    vectors = spark.createDataFrame([(d, [1.0, float(d)]) for d, *_ in SCOPED_D], "doc_id long, vec array<double>")
    near = spark.createDataFrame([(q, [1.0, 1.0]) for q in range(1, 8)], "query_id long, vec array<double>")
    found = recall.recall(queries.dropDuplicates(["query_id"]), docs, vectors, near, requested="dense", scope=names).rankings.collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(q, d) for q, _, *a in SCOPED_Q for d, _, *h in SCOPED_D if sees(a, h)}
    late = recall.recall(queries.dropDuplicates(["query_id"]), docs, vectors, near, requested="dense", scope=names, top=3, reference_compat=True).rankings.collect()
    assert {(r.query_id, r.doc_id) for r in late} == {(q, d) for q, _, *a in SCOPED_Q for d, _, *h in SCOPED_D if sees(a, h) and d <= 3}


def test_the_best_of_a_batch():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, m, top in ((0, 3, 2), (5, 0, 2), (4, 3, 10), (50, 4, 7), (200, 3, 10)):
        scores, numbers = rng.integers(0, 4, (n, m)).astype(float), rng.permutation(n)
        rows, columns = lexical.best_of_batch(scores, numbers, top, least=0)
        found = [(c, numbers[r]) for r, c in zip(rows.tolist(), columns.tolist())]
        expected = [(c, numbers[r]) for c in range(m) for r in sorted(range(n), key=lambda r: (-scores[r, c], numbers[r]))[:top] if scores[r, c] > 0]
        assert found == expected


def test_ties_by_id(spark):
    assert search(spark, "x", [(3, "x"), (1, "x"), (2, "x")]) == [1, 2, 3]


def test_unmatched(spark):
    found = lexical.unmatched(spark.createDataFrame([(1, "香港 量子计算")], Q), spark.createDataFrame(CJK, D))
    assert {r.term for r in found.collect()} == {"量子", "子计", "计算"}


def test_keyword_hits(spark):
    docs = [(1, "truenas zvol snapshot 备份"), (2, "truenas 磁盘占用"), (3, "nothing")]
    found = lexical.keyword_hits(spark.createDataFrame([(1, "truenas zvol 备份")], Q), spark.createDataFrame(docs, D)).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in found] == [(1, 4.0), (2, 1.0)]
    twice = lexical.keyword_hits(spark.createDataFrame([(1, "a a b"), (2, "b")], Q), spark.createDataFrame([(1, "xax"), (2, "b")], D), block_bytes=1)
    assert {(r.query_id, r.doc_id, r.score) for r in twice.collect()} == {(1, 1, 2.0), (1, 2, 1.0), (2, 2, 1.0)}


def test_cosine(spark):
    def of(a, b):
        arrays = [F.array(*map(F.lit, v)) for v in (a, b)]
        return spark.range(1).select(cosine(*arrays).alias("x")).first().x

    assert of([1.0, 2.0], [1.0, 2.0]) == pytest.approx(1) and of([1.0, 0.0], [0.0, 3.0]) == 0
    assert of([1.0, 2.0], [2.0, 1.0]) == pytest.approx(of([10.0, 20.0], [2.0, 1.0])) and of([0.0, 0.0], [1.0, 1.0]) == 0
    assert spark.range(1).select(unit(F.array(F.lit(0.0), F.lit(0.0))).alias("x")).first().x == [0.0, 0.0]


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_cosine_search_against_brute_force(spark, block_bytes):
    import numpy as np

    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(6, 8))
    v[5] = 0
    V = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vec array<double>").repartition(4)
    Q_ = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vec array<double>")
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(norm(v) @ norm(q).T, 6)
    found = dense.cosine_search(Q_, V, 5, block_bytes=block_bytes)
    for i in range(6):
        assert ids(found, i) == np.lexsort((np.arange(300), -scores[:, i]))[:5].tolist()


def channel(spark, *docs):
    return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(docs)], R)


def test_fusion(spark):
    a, b, c, = 1, 2, 3
    words, near = channel(spark, a, b), channel(spark, b, c)
    fused = fusion.fuse({"lexical": (words, 1.0), "dense": (near, 1.0)})
    first = fused.filter("rank = 1").first()
    assert first.doc_id == b and first.ranks == {"lexical": 2, "dense": 1}
    assert fusion.fuse({"lexical": (channel(spark, a), 1.0)}).first().score == pytest.approx(1 / 61, abs=1e-6)
    assert ids(fusion.fuse({"lexical": (channel(spark, b), 1.0), "dense": (channel(spark, a), 1.0)})) == [a, b]
    assert ids(fusion.fuse({"lexical": (channel(spark, c), 0.4), "dense": (channel(spark, a), 1.0)})) == [a, c]
    assert set(ids(fusion.fuse({"lexical": (channel(spark, c), 0.0), "dense": (channel(spark, a), 1.0)}))) == {a, c}


def test_rerank(spark):
    pool = fusion.fuse({"x": (channel(spark, 1, 2, 3, 4), 1.0)})
    given = spark.createDataFrame([(1, 3, 0), (1, 1, 1), (1, 3, 2)], "query_id long, doc_id long, position long")
    assert ids(fusion.apply_rerank(pool, given)) == [1, 3, 2, 4]  # the last position counts; what has none follows
    queries, corpus = spark.createDataFrame([(1, "q")], Q), spark.createDataFrame([(i, "x" * i) for i in range(1, 5)], D)
    by_length = fusion.rerank(pool, queries, corpus, lambda q, texts: [len(t) for t in texts])
    assert ids(fusion.apply_rerank(pool, by_length)) == [4, 3, 2, 1]

    def broken(q, texts):
        raise ValueError

    assert ids(fusion.apply_rerank(pool, fusion.rerank(pool, queries, corpus, broken))) == [1, 2, 3, 4]


def test_rerank_responses(spark):
    bodies = [
        (1, '{"results": [{"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.5}, {"index": 1, "relevance_score": 0.1}]}'),
        (2, '{"data": [{"score": 0.2}, {"score": 0.8}, {"index": 9, "score": 1}]}'),
        (3, "{}"),
    ]
    pools = spark.createDataFrame([(i, [10, 11, 12]) for i in (1, 2, 3)], "query_id long, ids array<long>")
    found = fusion.parsed_positions(spark.createDataFrame(bodies, "query_id long, body string"), pools).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, 12), (1, 10), (1, 11), (2, 11), (2, 10)]


@pytest.mark.parametrize("requested", sorted(st.LADDERS))
@pytest.mark.parametrize("dense_", [None, "off"])
@pytest.mark.parametrize("rerank", [None, "off"])
def test_every_ladder_ends_in_a_strategy_that_can_be_served(requested, dense_, rerank):
    found = st.resolve(requested, dense_, rerank)
    assert not (found.strategy.needs_dense and dense_) and not (found.strategy.rerank and rerank)


def test_ladders():
    name = lambda *a, **k: (st.resolve(*a, **k).strategy.name, len(st.resolve(*a, **k).skipped))
    assert name("auto") == ("dense+rerank", 0)
    assert name("auto", rerank="no") == ("dense", 1)
    assert name("auto", dense="no", rerank="no") == ("bm25", 2)
    assert name("fusion+rerank", rerank="no") == ("dense", 1)
    assert name("bm25") == ("bm25", 0)
    assert st.parse("Dense") is None and st.parse("dense") == "dense" and st.parse(7) is None
    assert [st.lexical_weight(x) for x in ("", "abc", -1, "0", 0.7, None)] == [0.4, 0.4, 0.4, 0.0, 0.7, 0.4]


def test_recall_drops_a_failing_channel(spark):
    queries, corpus = spark.createDataFrame([(1, "x")], Q), spark.createDataFrame([(1, "x"), (2, "y")], D)
    bad = spark.createDataFrame([(1, "no vector")], "doc_id long, nothing string")
    good = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    found = recall.recall(queries, corpus, bad, good, requested="fusion")
    assert found.served == "bm25" and found.status["lexical"] == "ok" and found.status["dense"] != "ok" and ids(found.rankings) == [1]
    alone = recall.recall(queries, corpus, bad, good, requested="dense")
    assert alone.served == "none" and alone.rankings.count() == 0


#: Tokenizers of which the job fails, and which cannot be planned.
FAILING = [lambda text: F.array(F.raise_error(F.lit("no words")).cast("string")), lambda text: F.split(F.col("nothing"), " ")]


def test_recall_without_a_channel_tells_so_or_fails(spark):
    queries, corpus = spark.createDataFrame([(1, "x")], Q), spark.createDataFrame([(1, "x"), (2, "y")], D)
    vectors, asked = (spark.createDataFrame([(1, [1.0])], f"{c} long, vec array<double>") for c in ("doc_id", "query_id"))
    both = recall.recall(queries, corpus, vectors, asked, requested="fusion", tolerant=False)
    assert both.served == "fusion" and both.reason == "fusion as requested"
    for requested in ("fusion", "bm25"):
        with pytest.raises(PySparkException, match="no words"):  # a job is no matter of the plan
            recall.recall(queries, corpus, vectors, asked, requested=requested, tokenize=FAILING[0])
        with pytest.raises(AnalysisException, match="nothing"):
            recall.recall(queries, corpus, vectors, asked, requested=requested, tokenize=FAILING[1], tolerant=False)
    with pytest.warns(RuntimeWarning, match="without its channel lexical"):
        found = recall.recall(queries, corpus, vectors, asked, requested="fusion", tokenize=FAILING[1])
    assert found.served == "dense" and found.reason.startswith("fusion as requested; lexical: ") and "nothing" in found.reason


def damaged(spark, folder, **change):
    """Tables of which some are changed."""
    for name in ("documents", "benchmark", "embeddings"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        change.get(name, lambda df: df)(rows).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_no_query_gives_the_result_of_some_of_its_channels(spark, tmp_path):
    no_vectors = damaged(spark, tmp_path / "vectors", embeddings=lambda df: df.withColumn("embedding", F.col("embedding").cast("string")))
    for name in ("hybrid_scoped", "hybrid_search", "rerank_coverage", "dense_rerank", "ladder_auto", "cosine_scoped_before", "cosine_scoped_after"):
        with pytest.raises(AnalysisException, match="size"):
            search_queries.QUERIES[name](spark, no_vectors)
    no_texts = damaged(spark, tmp_path / "texts", documents=lambda df: df.withColumn("text", F.array("text")))
    for name in ("hybrid_scoped", "hybrid_search", "rerank_coverage", "ladder_without_vectors"):
        with pytest.raises(AnalysisException, match="coalesce"):
            search_queries.QUERIES[name](spark, no_texts)


@pytest.mark.parametrize("tokenize", FAILING)
def test_the_third_channel_is_no_less_needed_than_the_others(spark, tmp_path, monkeypatch, tokenize):
    with pytest.raises(AnalysisException, match="size"):
        search_queries.hybrid_three(spark, damaged(spark, tmp_path / "vectors", embeddings=lambda df: df.withColumn("embedding", F.col("embedding").cast("string"))))
    monkeypatch.setattr(search_queries, "_spaced", tokenize)
    with pytest.raises(PySparkException, match="no words|nothing"):
        search_queries.hybrid_three(spark, "/root/testdata/sf0.001")


def test_materialised_skips_tombstones(spark):
    rows = spark.createDataFrame([(1, True, "local"), (2, False, "local"), (3, None, "observed")], "doc_id long, deleted boolean, source string")
    found = recall.materialised(channel(spark, 1, 2, 3, 9), rows)
    assert ids(found) == [2, 3] and "deleted" not in found.columns


def test_fusion_does_not_depend_on_the_scale_of_scores(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdef", k=5))) for i in range(40)]
    queries = spark.createDataFrame([(1, "a b")], Q)
    words = lexical.bm25(queries, spark.createDataFrame(docs, D), 20)
    scaled = words.withColumn("score", F.col("score") * 1000)
    both = [ids(fusion.fuse({"lexical": (w, 0.4), "dense": (channel(spark, 3, 1, 2), 1.0)})) for w in (words, scaled)]
    assert both[0] == both[1]


def test_packing(spark):
    def brute(rows):
        out, batch, count, used = [], -1, 64, 0
        for i, n in rows:
            if count >= 64 or used + n > 16000:
                batch, count, used = batch + 1, 0, 0
            out.append((i, batch))
            count, used = count + 1, used + n
        return [x for x in out if x[1] < 8]

    rng = random.Random(2)
    for sizes in ([10] * 200, [9000] * 20, [20000, 1, 20000, 1], [rng.randint(1, 3000) for _ in range(700)], []):
        rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "id long, memory string")
        assert sorted((r.id, r.batch) for r in dense.packed(rows).collect()) == brute(list(enumerate(sizes)))


def test_vector_upkeep(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, memory string")
    import hashlib

    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    stored = spark.createDataFrame([(1, "m", sha("a"), [1.0], 1, True), (2, "m", sha("old"), [1.0], 1, True), (9, "m", sha("z"), [1.0], 1, True), (3, "other", sha("c"), [1.0], 1, True)], "id long, model string, hash string, vec array<double>, dims int, normalized boolean")
    assert {r.id for r in dense.targets(corpus, stored, "m").collect()} == {2, 3}

    def embed(texts):
        if "c" in texts:
            raise ValueError
        return [[3.0, 4.0] for _ in texts]

    batches = spark.createDataFrame([(2, 0, "b"), (3, 1, "c")], "id long, batch int, memory string")
    fresh = dense.embedded(batches, embed, "m")
    kept = {r.id: r for r in dense.maintained(stored, fresh, corpus, "m").collect()}
    assert set(kept) == {1, 2} and kept[2].vec == [0.6, 0.8] and kept[2].hash == sha("b")
