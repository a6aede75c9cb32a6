import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluation, gates, gold, ingest, mutations, scope
from marlstone.sources import logs, pages, tables
from marlstone.streaming import gate as gate_stream, runs

SIDE = "id long, side string, at long, deleted boolean, overflowed boolean"


def winner(m, d):
    """The merge rules in plain Python."""
    if d is None or m is None:
        return m or d
    if m[4] and not d[4]:
        return m
    if m[3] and not d[3] and m[2] >= d[2]:
        return m
    if d[3] and not m[3]:
        return d
    if m[2] != d[2]:
        return m if m[2] > d[2] else d
    return m if m[3] else d


def test_merge_all_combinations(spark):
    mine, disk = [], []
    for i, (md, dd, mo, do, (ma, da)) in enumerate(itertools.product([True, False], [True, False], [True, False], [True, False], [(1, 2), (2, 1), (1, 1)])):
        mine.append((i, "mine", ma, md, mo))
        disk.append((i, "disk", da, dd, do))
    mine.append((900, "mine", 1, False, False))
    disk.append((901, "disk", 1, None, None))
    M, D = spark.createDataFrame(mine, SIDE), spark.createDataFrame(disk, SIDE)
    got = {tuple(r) for r in mutations.merged(M, D).collect()}
    theirs, ours = {r[0]: r for r in disk}, {r[0]: r for r in mine}
    assert got == {winner(ours.get(i), theirs.get(i)) for i in ours.keys() | theirs.keys()}
    again = mutations.merged(mutations.merged(M, D), D)
    assert {tuple(r) for r in again.collect()} == got
    assert {tuple(r) for r in mutations.merged(M, D, wiped=True).collect()} == set(mine)


def test_unreadable_times_are_oldest(spark):
    at = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("soon",), (None,)], "t string").select(mutations.instant(F.col("t")).alias("x")).collect()
    assert at[0].x > at[1].x == at[2].x


STORE = "id string, memory string, created_at string, updated_at string, deleted boolean, source string, app_id string"
WRITES = "kind string, memory_id string, text string, app_id string, at string"


def test_offline_writes(spark):
    store = spark.createDataFrame([(i, "t", "1", "1", False, "observed", a) for i, a in (("a", "x"), ("b", "x"), ("c", "y"))], STORE)
    writes = spark.createDataFrame([("update", "a", "new", None, "2"), ("delete", "b", None, None, "2"), ("update", "z", "made", None, "3"), ("delete", "gone", None, None, "3")], WRITES)
    rows = {r.id: r for r in mutations.written(store, writes).collect()}
    assert set(rows) == {"a", "b", "c", "z"}
    assert rows["a"].memory == "new" and rows["a"].updated_at == "2" and rows["b"].deleted and rows["z"].source == "local" and not rows["c"].deleted


def test_adds(spark):
    writes = spark.createDataFrame([([("hi",), (None,), ("there",)], {"user_id": "u", "app_id": "*"}, "1"), ([], {}, "2")], "messages array<struct<content:string>>, scope map<string,string>, at string")
    rows = mutations.added(writes, F.concat(F.lit("local-"), F.col("at"))).orderBy("created_at").collect()
    assert (rows[0].memory, rows[0].add_payload, rows[0].id) == ("hi\nthere", {"user_id": "u"}, "local-1") and rows[1].memory == "(empty)"


def test_reconcile(spark):
    ops = spark.createDataFrame([("update", "a"), ("delete", "b")], "kind string, memory_id string")
    left = lambda *ids: {r.memory_id for r in mutations.reconciled(ops, spark.createDataFrame([(i,) for i in ids], "memory_id string")).collect()}
    assert left("a") == {"b"} and left(None) == set() and left() == {"a", "b"}


def test_permanent(spark):
    statuses = spark.createDataFrame([(s,) for s in (200, 400, 401, 403, 404, 408, 422, 429, 500)], "s int")
    assert {r.s for r in statuses.filter(mutations.permanent(F.col("s"))).collect()} == {400, 422}


def test_replay(spark):
    queue = [(1, 1, "op", "a", 400, 2), (1, 2, "op", "b", 404, 0), (1, 3, "add", "c", 200, 0), (1, 4, "add", "d", 503, 0), (1, 5, "op", "e", 200, 0), (2, 1, "op", "a", 400, 0), (2, 2, "add", "x", 401, 0)]
    df = spark.createDataFrame(queue, "store long, position long, kind string, id string, status int, failures int")
    got = {(r.store, r.position): (r.outcome, r.backoff_until) for r in mutations.replay(df, 1000).collect()}
    late = 1000 + mutations.BACKOFF_MS
    assert got == {(1, 1): ("retired", None), (1, 2): ("applied", None), (1, 3): ("applied", None), (1, 4): ("backoff", late), (1, 5): ("waiting", None), (2, 1): ("failed", None), (2, 2): ("backoff", late)}


class Model:
    """The gate written as a plain dictionary machine."""

    def __init__(self):
        self.cache, self.last, self.block = {}, None, 0

    def __call__(self, at, kind, key, status, retry, local):
        if kind.startswith("write"):
            self.cache = {}
            return "write" if status == 200 else "write-local"
        have = key in self.cache
        if have and at - self.cache[key] < gates.TTL_MS:
            return "hit"
        closed = at < self.block or (self.last is not None and at - self.last < gates.INTERVAL_MS)
        if closed and kind in gates.GATEABLE:
            return "gated-stale" if have else "gated-local" if local else "gated-none"
        if status == 200:
            self.cache[key], self.last, self.block = at, at, 0
            return "miss"
        if status == 429:
            self.block = at + (int(retry * 1000) if retry is not None else gates.BREAKER_MS)
        return "stale" if have else "fallback" if local else "error"


REQUESTS = "tenant long, seq long, at long, kind string, key string, status int, retry_after double, local boolean"


def random_requests(n=1500):
    rng, at = random.Random(4), 0
    rows = []
    for seq in range(n):
        at += rng.choice([1000, 600_000, 4_000_000, 30_000_000])
        kind = rng.choice(["read-search", "read-get", "read-history", "write-add"])
        rows.append((rng.randint(1, 5), seq, at, kind, rng.choice("abc"), rng.choice([200, 200, 429, 500]), rng.choice([None, 7200.5]), rng.random() < 0.7))
    return rows


def expected(rows):
    models, out = {}, set()
    for t, seq, at, kind, key, status, retry, local in sorted(rows, key=lambda r: (r[2], r[1])):
        out.add((t, seq, models.setdefault(t, Model())(at, kind, key, status, retry, local)))
    return out


def test_gate_against_a_model(spark):
    rows = random_requests()
    got = {tuple(r) for r in gates.folded(spark.createDataFrame(rows, REQUESTS).repartition(5)).collect()}
    assert got == expected(rows) and len({o for _, _, o in got}) >= 8


def test_gate_as_a_stream_keeps_state_between_batches(spark, tmp_path):
    rows = sorted(random_requests(600), key=lambda r: r[2])
    for i in range(3):
        spark.createDataFrame(rows[200 * i : 200 * (i + 1)], REQUESTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    got = {tuple(r) for r in runs.drained(gate_stream.gated(stream)).collect()}
    assert got == expected(rows)


def test_classify(spark):
    cases = {("GET", "/v1/memories/x/history/"): "read-history", ("POST", "/v2/memories/search/"): "read-search", ("POST", "/v3/memories/add"): "write-add", ("POST", "/v3/memories/"): "read-getall", ("GET", "/v3/memories/x"): "read-get", ("PATCH", "/v1/memories/x/"): "write-update", ("DELETE", "/v3/memories/x"): "write-delete", ("DELETE", "/v1/memories/"): "write-delete-all", ("GET", "/v1/ping"): "read-other", ("POST", "/else"): "other"}
    df = spark.createDataFrame(list(cases), "m string, p string")
    assert {(r.m, r.p): r.k for r in df.withColumn("k", gates.classify(F.col("m"), F.col("p"))).collect()} == cases


def test_harvest(spark):
    bodies = ['{"results": [{"id": "a", "memory": "x", "user_id": 5}, {"id": 1, "memory": "y"}, {"id": "b"}, 7]}', '[{"id": "c", "memory": "z", "created_at": "t0", "user_id": "u"}]', "not json", '{"id": "d", "memory": "bare"}', None]
    rows = ingest.harvest(spark.createDataFrame([(b, "now") for b in bodies], "body string, at string")).orderBy("id").collect()
    assert [(r.id, r.memory, r.created_at, r.updated_at, r.user_id) for r in rows] == [("a", "x", "now", "now", None), ("c", "z", "t0", "now", "u")]


def test_upsert_spares_local_rows_and_revives_tombstones(spark):
    store = spark.createDataFrame([("a", "mine", "local", False), ("b", "old", "observed", True), ("c", "stays", "observed", False)], "id string, memory string, source string, deleted boolean")
    incoming = spark.createDataFrame([("a", "theirs"), ("b", "new"), ("d", "more")], "id string, memory string")
    assert {tuple(r) for r in ingest.upsert(store, incoming).collect()} == {("a", "mine", "local", False), ("b", "new", "observed", False), ("c", "stays", "observed", False), ("d", "more", "observed", False)}


def test_quarantine_once_per_id(spark):
    rows = spark.createDataFrame([("a", "x" * 4001), ("a", "x" * 4001), ("b", "x" * 5000), ("c", "x")], "id string, memory string")
    known = spark.createDataFrame([("b",)], "id string")
    assert [(r.id, r.chars) for r in ingest.quarantine(rows, known).collect()] == [("a", 4001)]


def test_scope(spark):
    rows = spark.createDataFrame([(1, "u", "a"), (2, "u", None), (3, "v", "a")], "n int, user_id string, app_id string").withColumns({"agent_id": F.lit(None).cast("string"), "run_id": F.lit(None).cast("string")})
    got = lambda s: {r.n for r in scope.in_scope(rows, s).collect()}
    assert got({"user_id": "u"}) == {1, 2} and got({"user_id": "u", "app_id": "a"}) == {1} and got({"app_id": "*"}) == {1, 2, 3}
    assert got(None) == {1, 2, 3} and got({"other": "x"}) == {1, 2, 3} and got({"run_id": "r"}) == set() and got({"user_id": 5}) == {1, 2, 3}
    requests = spark.createDataFrame([("https://h.example/x?user_id=a+b&app_id=*", '{"filters": {"user_id": "body", "run_id": 7}}'), ("https://h.example/x?user_id=a+b", None), ("https://h.example/", "nope")], "url string, body string")
    assert [r.s for r in requests.select(scope.bound(F.col("url"), F.col("body")).alias("s")).collect()] == [{"user_id": "body"}, {"user_id": "a b"}, {}]


def test_agreement_metrics(spark):
    R, M = "query_id long, strategy string, doc_id long, rank int", "query_id long, doc_id long, rank int"
    listed = lambda q, s, ids: [(q, s, d, i + 1) for i, d in enumerate(ids)]
    remote = [(q, d, i + 1) for q, ids in ((1, [1, 2, 3, 4, 5]), (2, [3, 26, 6, 7, 8])) for i, d in enumerate(ids)]
    rankings = listed(1, "same", [1, 2, 3, 4, 5]) + listed(1, "none", [11, 12]) + listed(1, "back", [5, 4, 3, 2, 1]) + listed(2, "part", [1, 2, 3, 4, 5])
    got = {(r.query_id, r.strategy): r for r in evaluation.agreement(spark.createDataFrame(rankings, R), spark.createDataFrame(remote, M)).collect()}
    assert (got[1, "same"].overlap5, got[1, "same"].mrr, got[1, "same"].ndcg, got[1, "same"].top1) == (5, 1.0, 1.0, True)
    assert (got[1, "none"].overlap5, got[1, "none"].mrr, got[1, "none"].ndcg) == (0, 0.0, 0.0)
    assert 0 < got[1, "back"].ndcg < 1 and got[2, "part"].overlap5 == 1 and got[2, "part"].mrr == pytest.approx(1 / 3, abs=1e-6)


def test_graded_metrics(spark):
    R, G = "query_id long, strategy string, doc_id long, rank int", "query_id long, doc_id long, grade int"
    rankings = spark.createDataFrame([(1, "s", 7, 1), (1, "s", 8, 2), (2, "s", 9, 1)], R)
    grades = spark.createDataFrame([(1, 8, 2), (1, 5, 1), (2, 9, 0)], G)
    got = {r.query_id: r for r in evaluation.graded(rankings, grades).collect()}
    dcg, ideal = 3 / np.log2(3), 3 + 1 / np.log2(3)
    assert got[1].ndcg == pytest.approx(dcg / ideal, abs=1e-6) and (got[1].recall, got[1].prec5, got[1].mrr, got[1].hit) == (0.5, 0.2, 0.5, 1)
    assert (got[2].ndcg, got[2].recall, got[2].no_answer, got[2].zero) == (None, None, 1, 1)
    assert evaluation.graded_summary(evaluation.graded(rankings, grades)).first().mean_recall == 0.5


def test_report_text(spark):
    text = evaluation.report_text([{"strategy": "a", "n": 3, "mean_ndcg": 0.1, "indicative_only": True}, {"strategy": "b", "n": 40, "mean_ndcg": 0.2, "indicative_only": False}], ("strategy", "n", "mean_ndcg"))
    assert text.split("\n") == ["strategy  n   mean_ndcg", "b         40  0.2", "a         3   0.1", "a: n=3, indicative only"]


def reference_uniform(seed, n):
    """The generator with Python integers cut to 32 bits."""
    mask, out, a = 0xFFFFFFFF, [], seed & 0xFFFFFFFF
    for _ in range(n):
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask
        out.append(((t ^ (t >> 14)) & mask) / 2**32)
    return out


def test_seeded_shuffle():
    for seed in (0, 1, 42, 2**32 - 1):
        assert gold.uniform(seed, 50).tolist() == reference_uniform(seed, 50)
    assert sorted(gold.shuffle(list(range(20)), 7)) == list(range(20)) and gold.shuffle(list(range(20)), 7) == gold.shuffle(list(range(20)), 7)


def test_sample(spark):
    rows = spark.createDataFrame([(i, "t", s, i) for i, s in enumerate(["latin"] * 30 + ["mixed"] * 3 + ["terse-cjk"] * 10)], "query_id long, text string, shape string, seq long")
    shapes = [r["shape"] for r in gold.sample(rows, 12, 42, 100).collect()]
    assert {s: shapes.count(s) for s in set(shapes)} == {"latin": 4, "mixed": 3, "terse-cjk": 4}
    assert gold.sample(rows, 12, 42, 100).collect() == gold.sample(rows.repartition(7), 12, 42, 100).collect()


def test_places_of_a_shuffle_without_shuffling(spark):
    sizes = {"a": 1, "bb": 2, "c": 3, "dd": 400, "e": 57}
    rows = [(1000 * k + i, name, 7 * i % n if n % 7 else i) for k, (name, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, shape string, seq long").repartition(5)
    for seed, quota in ((42, 5), (2**31, 400), (0, 1)):
        got = {}
        for r in gold.shuffled(df, "shape", ["seq", "query_id"], F.lit(seed) + F.length("shape"), quota).orderBy("at").collect():
            got.setdefault(r["shape"], []).append(r.query_id)
        expected = {}
        for name in sizes:
            own = [q for q, _ in sorted(((q, s) for q, g, s in rows if g == name), key=lambda x: (x[1], x[0]))]
            expected[name] = gold.shuffle(own, seed + len(name))[:quota]
        assert got == expected


def test_sample_equals_the_sequential_one(spark):
    rows = [(i * 13 % 101, f"t{i}", s, i * 7 % 103) for i, s in enumerate(["latin"] * 60 + ["mixed"] * 3 + ["terse-cjk"] * 38)]
    df = spark.createDataFrame(rows, "query_id long, text string, shape string, seq long").repartition(4)
    for size, per_bucket in ((12, 100), (40, 9), (1, 1)):
        shapes = sorted({s for _, _, s, _ in rows})
        quota = min(max(1, -(-size // len(shapes))), per_bucket)
        picked = [x for name in shapes for x in gold.shuffle(sorted((r for r in rows if r[2] == name), key=lambda r: (r[3], r[0])), 42 + len(name))[:quota]]
        expected = sorted(gold.shuffle(picked, 42)[:size], key=lambda r: (r[1], r[0]))
        assert [tuple(r) for r in gold.sample(df, size, 42, per_bucket).collect()] == expected


def test_judge_replies(spark):
    assert gold.first_object('say {"a": "}{", "b": {"c": 1}} end') == {"a": "}{", "b": {"c": 1}}
    assert gold.first_object("{bad}") is None and gold.first_object('{"open": 1') is None and gold.first_object('{"q": "a\\"}b"}') == {"q": 'a"}b'}
    replies = [(1, 'ok {"grades": {"5": 2, "6": "1.4", "7": "x", "99": 1}}'), (2, "5: 1\n6 = 0\nnoise\n7: 3"), (3, '{"grades": [{"id": 5, "score": 9}, {"id": 6, "relevance": -1}]}'), (4, None)]
    pools = spark.createDataFrame([(q, d) for q in (1, 2, 3, 4) for d in (5, 6, 7)], "query_id long, doc_id long")
    got = {tuple(r) for r in gold.judged(spark.createDataFrame(replies, "query_id long, reply string"), pools).collect()}
    assert got == {(1, 5, 2), (1, 6, 1), (2, 5, 1), (2, 6, 0), (3, 5, 2), (3, 6, 0)}


def test_log(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    entries = spark.createDataFrame([(3, "remote", "b"), (1, "fallback", "a")], "ts long, mode string, query string")
    logs.append(entries, folder)
    (tmp_path / "log" / "torn.json").write_text('{"ts": 2, "mode": "remote", "remote": [{"id": "x", "score": 1}], "codeVersion": "1"}\n\n{"ts": \nnot json\n')
    rows = logs.read(spark, folder).collect()
    assert [r.ts for r in rows] == [1, 2, 3]
    assert [r.ts for r in logs.remote_entries(logs.read(spark, folder), "1").collect()] == [2]
    assert logs.remote_entries(logs.read(spark, folder), since=str(datetime.date(1970, 1, 2))).count() == 0
    body = spark.createDataFrame([('{"results": [{"id": "a", "score": 1.5}, {"id": null}, {"id": "b"}]}',), ("oops",)], "b string")
    assert [[tuple(h) for h in r.h] for r in body.select(logs.remote_hits(F.col("b")).alias("h")).collect()] == [[("a", 1.5), ("b", None)], []]


def test_pull_stops(spark):
    import json

    def fetch(page, size):
        n = {1: 500, 2: 200}.get(page, 0)
        return (200, json.dumps({"results": [{"id": f"{page}-{i}", "memory": "m"} for i in range(n)], "count": 4069}))

    got = pages.pull(spark, fetch)
    assert got.count() == 2
    assert ingest.harvest(got.select("body", F.lit("now").alias("at"))).count() == 700
    assert pages.pull(spark, lambda p, s: (500, "")).count() == 1
    assert pages.pull(spark, lambda p, s: (200, json.dumps({"results": [0] * s, "count": 1000}))).count() == 2


def test_versioned_table(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert tables.load(spark, folder).count() == 0
    for n in (2, 5):
        tables.save(spark.range(n).selectExpr("cast(id as string) id", "'m' memory"), folder)
        assert tables.load(spark, folder, "id string, memory string").count() == n
    (tmp_path / "store" / "v9").mkdir()
    assert tables.load(spark, folder, "id string, memory string").count() == 5
