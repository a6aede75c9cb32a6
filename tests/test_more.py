import json

from pyspark.sql import functions as F

from marlstone.operators import dense, gates, mutations


def test_wildcards_leave_a_body(spark):
    bodies = ['{"query":"a \\"b\\" c","filters":{"user_id":"u","app_id":"*","n":"*"},"top_k":5,"deep":{"x":[1,2]},"ok":true}', '{"filters":{"user_id":"u"}}', "no json", None, '{"filters":[1]}', '{"query":"x"}', '{"filters":{"app_id":"*"}}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    out = [r.x for r in rows.withColumn("x", gates.without_wildcards(F.col("b"))).orderBy("i").collect()]
    first = json.loads(bodies[0])
    del first["filters"]["app_id"]
    assert json.loads(out[0]) == first
    assert out[1:6] == bodies[1:6] and json.loads(out[6]) == {"filters": {}}


def test_filters_from_cache(spark):
    keys = ["GET /v1/memories/1/ ", "POST /v3/memories/ not json", 'POST /v3/memories/search/ {"filters": {}}', 'POST /v3/memories/?page=1 {"query": "a b", "filters": {"user_id": "u"}}', 'POST /v3/memories/ {"filters": {"user_id": "late"}}']
    cache = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "seq int, key string")
    assert gates.filters_from_cache(cache).first().filters == {"user_id": "u"}
    assert gates.filters_from_cache(cache.limit(0)).first().filters is None


def test_scope_repair(spark):
    schema = "seq int, source string, user_id string, agent_id string, app_id string, run_id string"
    store = spark.createDataFrame([(1, "local", "l", None, None, None), (2, "observed", None, None, None, ""), (3, "observed", "u", None, "a", None)], schema)
    adds = spark.createDataFrame([("x", {"note": "n"}), ("y", {"run_id": "r"}), ("z", {"user_id": ""})], "id string, add_payload map<string,string>")
    got = {r.id: r.add_payload for r in mutations.with_scope(adds, store).collect()}
    assert got == {"x": {"note": "n", "user_id": "u", "app_id": "a"}, "y": {"run_id": "r"}, "z": {"user_id": "u", "app_id": "a"}}
    assert {r.id: r.add_payload for r in mutations.with_scope(adds, store.limit(0)).collect()}["x"] == {"note": "n"}


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = spark.createDataFrame([("a", "m"), ("b", "other")], "t string, model string").select(dense.cache_key(F.col("t")).alias("key"), "model", F.array(F.lit(1.0)).alias("vec"))
    known, missing = dense.from_cache(texts, cache, "m")
    assert [r.text for r in known.collect()] == ["a"] and [r.text for r in missing.collect()] == ["b"]


STORE = "id string, memory string, created_at string, updated_at string, deleted boolean, source string"
WRITES = "kind string, memory_id string, text string, at string"


def test_echo(spark):
    store = spark.createDataFrame([(i, "t", "1", "1", False, "observed") for i in "abc"], STORE)
    writes = spark.createDataFrame([("update", "a", "new", "2"), ("delete", "b", None, "2"), ("update", "z", "made", "3")], WRITES)
    rows = {r.id: r for r in mutations.echoed(store, writes).collect()}
    assert rows["a"].memory == "new" and rows["a"].updated_at == "2" and rows["b"].deleted and rows["b"].updated_at == "1"
    assert rows["z"].source == "observed" and not rows["c"].deleted
    wiped = mutations.echoed(store, writes.unionByName(spark.createDataFrame([("delete-all", None, None, "2")], WRITES)))
    assert {r.id: r.deleted for r in wiped.collect()} == {"a": True, "b": True, "c": True, "z": False}


def test_replay_effects(spark):
    store = spark.createDataFrame([(i, "t", "1", "1", d, s) for i, d, s in (("a", False, "local"), ("b", False, "observed"), ("c", True, "observed"), ("d", False, "observed"), ("e", True, "observed"))], STORE)
    done = spark.createDataFrame([("add", "a", 200), ("update", "b", 404), ("delete", "c", 200), ("update", "d", 200)], "kind string, id string, status int")
    rows = {r.id: (r.source, r.updated_at) for r in mutations.replayed(store, done, "now").collect()}
    assert rows == {"a": ("observed", "now"), "d": ("observed", "1"), "e": ("observed", "1")}
    all_ = done.unionByName(spark.createDataFrame([("delete-all", "x", 200)], "kind string, id string, status int"))
    assert {r.id for r in mutations.replayed(store, all_, "now").collect()} == {"a", "d"}


def test_utf16_cap(spark):
    from marlstone.functions.text import clamped_utf16

    texts = ["x" * 4001, "x" * 3999 + "🙂", "🙂" * 2001, "short", None]
    out = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", clamped_utf16("t").alias("t")).orderBy("i").collect()]
    assert out == ["x" * 4000, "x" * 3999, "🙂" * 2000, "short", None]
