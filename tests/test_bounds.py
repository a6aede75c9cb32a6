"""What a task holds does not grow with its share of the corpus."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.operators import dense, lexical

SPACED = lambda text: F.filter(F.split(F.lower(text), " +"), lambda t: t != "")


def texts(n, size, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "備份"], size, p=[0.4, 0.3, 0.2, 0.05, 0.05])) for _ in range(n)]


def batch(rows, kind=pa.string()):
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(rows, kind)], ["doc_id", "text"])


def block():
    return lexical.Block([(1, (), ["alpha", "delta"]), (2, (), ["beta"])], [])


def weighed(whole):
    own = block()
    own.weigh([tuple(r.values()) for b in own.count(iter([whole])) for r in b.to_pylist()])
    return own


def test_texts_are_cut_by_bytes_and_a_task_gives_its_best_once(spark, monkeypatch):
    whole, seen = batch(texts(400, 40)), []
    cut = lexical.Block._entries
    expected = [b.to_pylist() for b in weighed(whole).score(iter([whole]), 3)]
    monkeypatch.setattr(lexical, "PIECE_BYTES", 4_000)
    monkeypatch.setattr(lexical, "WAITING", 5)
    monkeypatch.setattr(lexical.Block, "_entries", lambda self, t: seen.append(t.nbytes) or cut(self, t))
    found = [b.to_pylist() for b in weighed(whole).score(iter([whole.slice(0, 0), whole.slice(0, 150), whole.slice(150)]), 3)]
    assert found == expected and len(found) == 1 and len(found[0]) == 6
    assert len(seen) > 20 and max(seen) < 4_000 + 4 * 400


def test_pieces_of_texts_and_of_tokens_are_whole():
    for rows, kind in ((["a" * n for n in (0, 3, lexical.PIECE_BYTES * 2, 5, 0)], pa.string()), ([["ab"] * n for n in (0, 4, lexical.PIECE_BYTES, 2, 0)], pa.list_(pa.string()))):
        whole = batch(rows, kind)
        for part in (whole, whole.slice(1, 3)):
            parts = list(lexical.pieces(iter([part, part.slice(0, 0)]), "text", 2))
            assert sum((p.column("doc_id").to_pylist() for p in parts), []) == part.column("doc_id").to_pylist()
            assert max(p.num_rows for p in parts) <= 2 and len(parts) > 1


def test_keywords_are_looked_for_in_texts_cut_by_bytes(monkeypatch):
    whole, seen = batch(texts(300, 40)), []
    asked, held = [(1, (), ["alpha", "delt"]), (2, (), ["備", "gamma"])], lexical.Keywords.held
    expected = [b.to_pylist() for b in lexical.Keywords(asked, []).score(iter([whole]), 4)]
    monkeypatch.setattr(lexical, "PIECE_BYTES", 4_000)
    monkeypatch.setattr(lexical.Keywords, "held", lambda self, t: seen.append(t.nbytes) or held(self, t))
    found = [b.to_pylist() for b in lexical.Keywords(asked, []).score(iter([whole.slice(0, 99), whole.slice(99)]), 4)]
    assert found == expected and len(found) == 1 and len(found[0]) == 8
    assert len(seen) > 10 and max(seen) < 4_000 + 4 * 300


def test_keywords_of_every_length_are_found_without_a_call_for_each_run(monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda least, most: "".join(rng.choice(list("ab_1"), rng.integers(least, most)))
    tokens = list(dict.fromkeys([word(1, 12) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaab", "a" * 17, "備", "份"]))
    rows = [" ".join(word(1, 30) + rng.choice(["", "", "é", "備", "-"]) for _ in range(20)) for _ in range(50)] + ["", "a" * 40, "aaaaaaaa aaaaaaaab", " 份a"]
    own, walked = lexical.Keywords([(7, (), tokens)], []), []
    expected = [(d, i) for d, t in enumerate(rows) for i, token in enumerate(tokens) if token in t]
    monkeypatch.setattr(lexical, "RUN_BYTES", 64)
    for texts_ in (pa.array(rows), pa.array(["zz a", *rows, "b"]).slice(1, len(rows))):
        assert list(zip(*(x.tolist() for x in own.held(texts_)))) == expected
    assert len(own.automaton) == sum(len(t) > 8 for t in tokens) and len(own.single) == 2
    assert own.held(pa.array([], pa.string()))[0].size == 0 and own.held(pa.array(["é", ""]))[0].size == 0
    none = lexical.Keywords([(7, (), [])], [])
    assert none.held(pa.array(["a b"]))[0].size == 0
    short = lexical.Keywords([(7, (), ["ab", "b1"])], [])
    monkeypatch.setattr(short, "automaton", walked)  # what is short goes through none
    assert short.held(pa.array(["xab1 b", "b1"]))[1].tolist() == [0, 1, 1]


def test_tokens_times_texts_are_bounded(monkeypatch):
    seen, held = [], lexical.Keywords.held
    monkeypatch.setattr(lexical, "HELD", 40)
    monkeypatch.setattr(lexical.Keywords, "held", lambda self, t: seen.append(len(t)) or held(self, t))
    list(lexical.Keywords([(1, (), list("abcdefgh"))], []).score(iter([batch(["a b"] * 23)]), 3))
    assert seen == [5, 5, 5, 5, 3]


def test_what_a_task_of_the_three_searches_holds_follows_neither_its_batches_nor_their_rows(monkeypatch):
    for name, bound in (("PIECE_BYTES", 20_000), ("WAITING", 100), ("RUN_BYTES", 5_000)):
        monkeypatch.setattr(lexical, name, bound)
    monkeypatch.setattr(dense, "SCORES", 500)
    rng = np.random.default_rng(3)

    def rows(n):
        found = batch([" ".join(f"w{x}" for x in rng.integers(0, 10**9, 40)) for _ in range(n)])
        return found.append_column("vec", pa.array(list(rng.normal(size=(n, 16))), pa.list_(pa.float64())))

    def peak(run, parts):
        tracemalloc.start()
        out = [b.to_pylist() for b in run(iter(parts))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, out

    asked = [(q, (), [f"w{q}", "w12", f"alpha{q}", f"{q}"]) for q in range(5)]
    near = dense._scan(pd.DataFrame({"query_id": range(5), "vec": list(rng.normal(size=(5, 16)))}), [], 3, False)
    whole = rows(2000)
    own = lexical.Block(asked, [])
    own.weigh([tuple(r.values()) for b in own.count(iter([whole])) for r in b.to_pylist()])
    for run in (own.count, lambda b: own.score(b, 3), lambda b: lexical.Keywords(asked, []).score(b, 3), near):
        peak(run, [whole.slice(0, 100)])
        few, _ = peak(run, [whole.slice(0, 100)])
        large, one = peak(run, [whole])
        many, more = peak(run, [whole.slice(at, 100) for at in range(0, 2000, 100)])
        assert one == more and max(large, many) < 2 * few


def test_terms_that_many_queries_share_are_laid_out_in_parts(monkeypatch):
    terms = [f"w{i}" for i in range(30)]
    rng = np.random.default_rng(4)
    whole = batch([" ".join(rng.permutation(terms)[: 30 - i % 3]) for i in range(100)] + ["", "none"])
    asked = [(q, (), terms) for q in range(40)]
    own = lexical.Block(asked, [])
    own.weigh([tuple(r.values()) for b in own.count(iter([whole])) for r in b.to_pylist()])
    for run in (lambda: own.score(iter([whole]), 3), lambda: lexical.Keywords(asked, []).score(iter([whole]), 3)):
        found = []
        for most in (1 << 20, 2000, 7):
            monkeypatch.setattr(lexical, "LAID", most, raising=False)
            tracemalloc.start()
            found.append([b.to_pylist() for b in run()])
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert most > 2000 or peak < 100 * 29 * 40 * 8  # less than one number for each pair
        assert found[0] == found[1] == found[2] and len(found[0][0]) == 120


def test_a_tokenizer_of_ones_own_needs_no_postings(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(60, 9))] + [(99, None), (98, "")], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha  delta"), (2, "備份 備份 none"), (3, None)], "query_id long, text string")
    found = lexical.bm25(asked, docs, 5, tokenize=SPACED)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    assert rows(found) == rows(lexical.bm25(asked, docs, 5, block_terms=0, tokenize=SPACED)) and len(rows(found)) == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def _absent(spark, **limits):
    docs = spark.createDataFrame([(1, "alpha beta", "u", "a"), (2, "Gamma 備份", "v", "a"), (3, None, "u", "b"), (None, "x1", "u", None)], "doc_id long, text string, user_id string, app_id string")
    asked = [(1, "alpha gamma zeta", "u", "*"), (2, "備份 alpha", "v", ""), (3, "beta x1", None, "a"), (4, None, "u", "a"), (5, "gamma eta", "", None), (6, "alpha", "w", "a")]
    queries = spark.createDataFrame(asked, "query_id long, text string, user_id string, app_id string")
    one, two = lexical.unmatched(queries, docs, **limits), lexical.unmatched(queries, docs, ["user_id", "app_id"], **limits)
    return [sorted(tuple(r) for r in df.collect()) for df in (one, two)], [df._jdf.queryExecution().optimizedPlan().toString() for df in (one, two)]


def test_few_unmatched_terms_shuffle_no_word_of_a_document(spark):
    found, plans = _absent(spark)
    assert found[0] == [(1, "zeta"), (5, "eta")]
    assert found[1] == [(1, "gamma"), (1, "zeta"), (2, "alpha"), (3, "x1"), (5, "eta"), (6, "alpha")]
    assert all("LeftSemi" not in p for p in plans)


def test_many_unmatched_terms_meet_distinct_words(spark):
    found, plans = _absent(spark, block_terms=0)
    assert found == _absent(spark)[0]
    for plan in plans:  # the words' aggregation stands below the join
        assert "Aggregate" in plan.split("LeftSemi", 1)[1]


def test_terms_of_queries_are_not_sorted_to_meet_what_is_known(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
        asked = spark.createDataFrame([(q, "alpha zeta") for q in range(4)], "query_id long, text string")
        found = lexical.unmatched(asked, docs, block_terms=0)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert sorted(tuple(r) for r in found.collect()) == [(q, "zeta") for q in range(4)]
    finally:
        spark.conf.set(name, before)
    assert "ShuffledHashJoin" in plan.split("LeftAnti")[0] and plan.count("SortMergeJoin") <= 1


def test_a_stream_of_more_rows_is_written_by_more_tasks(spark, monkeypatch):
    from pathlib import Path

    from marlstone.plans import corpus_queries

    calls, name = [], "spark.sql.files.maxPartitionBytes"
    monkeypatch.setattr(corpus_queries.upkeep, "follow", lambda spark, rows, *_, files: calls.append((len(list(Path(rows.removeprefix("file://")).glob("part-*"))), files)))
    monkeypatch.setattr(corpus_queries.upkeep, "vectors", lambda spark, *_: spark.createDataFrame([], "id long, hash string, dims int, vec array<double>"))
    before = spark.conf.get(name)
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    for k, v in ((name, "150000"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(k, v)
    try:
        corpus_queries.vector_upkeep_stream(spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    (first, files), (both, _) = calls
    assert first == 2 * files > 4 and both == first + 3 * files // 2
