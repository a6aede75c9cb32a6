"""Stores, vectors and reports that are kept up to date by what changed."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluation, mutations
from marlstone.sources import buckets
from marlstone.streaming import report, upkeep
from marlstone.streaming.runs import folder

SCHEMA = "id long, at long, deleted boolean, overflowed boolean"


def rows(spark, ids, at, deleted=False):
    return spark.createDataFrame([(i, at, deleted, False) for i in ids], SCHEMA)


def stored(spark, at):
    return {r.id: (r.at, r.deleted) for r in buckets.load(spark, at, SCHEMA).collect()}


def test_a_save_rewrites_its_buckets_alone(spark):
    at = folder(spark)
    assert buckets.save(rows(spark, range(500), 1), at, mutations.merged, SCHEMA, buckets=32) == (1, 32)
    before = buckets.current(spark, at)
    assert buckets.save(rows(spark, [7, None], 2), at, mutations.merged, SCHEMA) == (2, 2)
    after = buckets.current(spark, at)
    assert sum(after.folders[b] != before.folders[b] for b in range(32)) == 2
    assert stored(spark, at) == {i: (2 if i in (7, None) else 1, False) for i in [*range(500), None]}
    assert buckets.save(rows(spark, [], 3), at, mutations.merged, SCHEMA) == (2, 0)
    old = {r.id: r.at for r in buckets.load(spark, at, SCHEMA, version=before).collect()}
    assert old[7] == 1 and buckets.drop_old(spark, at, keep=1) == 0  # the first folder still holds thirty buckets
    buckets.save(rows(spark, range(500), 4), at, mutations.merged, SCHEMA)
    assert buckets.drop_old(spark, at, keep=1) == 2 and len(stored(spark, at)) == 501


def test_sessions_that_save_at_once_lose_nothing(spark, monkeypatch):
    """A second session saves between the write and the commit of the first: once elsewhere, once in the same bucket."""
    at = folder(spark)
    buckets.save(rows(spark, range(200), 1), at, mutations.merged, SCHEMA, buckets=16)
    own = {r.id: r.b for r in rows(spark, range(200), 0).withColumn("b", buckets.bucket_of(16)).collect()}
    other = next(i for i in range(200) if own[i] != own[0])
    same = next(i for i in range(1, 200) if own[i] == own[0])
    commit, meanwhile = buckets._committed, []

    def slow(spark_, folder_, version):
        if meanwhile:
            buckets.save(rows(spark, [meanwhile.pop()], 9), at, mutations.merged, SCHEMA)
        return commit(spark_, folder_, version)

    monkeypatch.setattr(buckets, "_committed", slow)
    for second, wrote in ((other, 1), (same, 2)):
        meanwhile.append(second)
        number, n = buckets.save(rows(spark, [0], 5), at, mutations.merged, SCHEMA)
        assert n == wrote and buckets.current(spark, at).number == number
        found = stored(spark, at)
        assert found[0] == (5, False) and found[second] == (9, False) and len(found) == 200


def letters(calls):
    def embed(texts):
        with Path(calls).open("a") as out:
            out.write("".join(f"{t}\n" for t in texts))
        if any("fail" in t for t in texts):
            raise ValueError("503")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def asked(calls):
    return Path(calls).read_text().splitlines() if Path(calls).exists() else []


def put(spark, path, *rows_):
    spark.createDataFrame(rows_, upkeep.ROWS).coalesce(1).write.mode("append").parquet(path)


def test_vectors_follow_a_stream_and_nothing_is_asked_twice(spark, tmp_path):
    at, calls = folder(spark), str(tmp_path / "calls")
    source, vectors, place, embed = f"{at}-rows", f"{at}-vectors", f"{at}-place", letters(calls)
    follow = lambda: upkeep.follow(spark, source, vectors, place, embed, "m", files=1, inputs=1)
    have = lambda: {r.id: r.dims for r in upkeep.vectors(spark, vectors, "m").collect()}
    put(spark, source, (1, "one", False, 1), (2, "two", None, 1), (3, None, False, 1), (None, "none", False, 1), (4, "fail 4", False, 1), (1, "one older", False, 0))
    assert [d["asked"] for d in follow()] == [3] and have() == {1: 2, 2: 2}
    assert follow() == [] and sorted(asked(calls)) == ["fail 4", "one", "two"]
    put(spark, source, (1, "one", False, 2), (2, "two", False, 2))  # the same texts again
    assert follow() == [{"asked": 0, "failed": 0, "buckets": 0}] and len(asked(calls)) == 3
    put(spark, source, (1, "one", True, 3), (2, "two new", False, 3), (4, "four", False, 3))
    put(spark, source, (2, "two late", False, 1))
    follow()
    assert have() == {2: 2, 4: 2} and sorted(asked(calls))[-2:] == ["two", "two new"] and "two late" not in asked(calls)
    n = len(asked(calls))
    assert upkeep.again(spark, vectors, embed, "m") == {"asked": 0, "failed": 0, "buckets": 0} and len(asked(calls)) == n
    assert {r.dims for r in upkeep.vectors(spark, vectors, "m").collect()} == {2}


def test_a_stop_between_writing_and_noting_the_place(spark, tmp_path, monkeypatch):
    at, calls = folder(spark), str(tmp_path / "calls")
    source, vectors, place, embed = f"{at}-rows", f"{at}-vectors", f"{at}-place", letters(calls)
    for part in range(3):
        put(spark, source, *[(i, f"text {i}", False, 1) for i in range(part * 10, part * 10 + 10)])
    take, broken = upkeep.take, [True]

    def stopped(*args, **kw):
        done = take(*args, **kw)
        if broken and done["asked"]:
            broken.pop()
            raise RuntimeError("stopped")
        return done

    monkeypatch.setattr(upkeep, "take", stopped)
    with pytest.raises(Exception, match="stopped"):
        upkeep.follow(spark, source, vectors, place, embed, "m", files=1)
    done = upkeep.follow(spark, source, vectors, place, embed, "m", files=1)
    assert [d["asked"] for d in done] == [0, 10, 10] and len(asked(calls)) == len(set(asked(calls))) == 30
    assert upkeep.vectors(spark, vectors, "m").count() == 30


def entries(spark, n):
    rng = random.Random(3)
    rows_ = []
    for q in range(n):
        for s in ("bm25", "fusion", None):
            five = rng.randrange(6)
            rows_.append((q, s, five, five + rng.randrange(5), rng.choice([0.0, 1.0, 1 / 2, 1 / 3, 1 / 7]), rng.choice([None, rng.random()]), rng.random() < 0.3, f"v{q % 3}", rng.choice(["a", "b", None])))
    df = spark.createDataFrame(rows_, "query_id long, strategy string, overlap5 long, overlap10 long, mrr double, ndcg double, top1 boolean, version string, scope string")
    return df.withColumn("ts", F.timestamp_seconds("query_id"))


@pytest.mark.parametrize("split", [1, 7])
def test_the_report_is_the_same_after_any_split(spark, split):
    at, all_ = folder(spark), entries(spark, 120)
    for part in range(split):
        all_.filter(F.pmod(F.xxhash64("query_id", "strategy"), F.lit(split)) == part).coalesce(1).write.mode("append").parquet(f"{at}-log")
        if part % 3 == 0:
            report.ingest(spark, f"{at}-log", f"{at}-sums", ("scope",), files=2)
    report.ingest(spark, f"{at}-log", f"{at}-sums", ("scope",), files=2)
    assert report.ingest(spark, f"{at}-log", f"{at}-sums", ("scope",)) == 0
    got = report.report(spark, f"{at}-sums")
    whole = evaluation.accuracy(all_.filter("strategy IS NOT NULL"))
    columns = whole.columns
    assert sorted(map(tuple, got.filter("stratum = 'overall'").select(columns).collect())) == sorted(map(tuple, whole.collect()))
    for label in ("a", "b", "unknown"):
        own = evaluation.accuracy(all_.filter("strategy IS NOT NULL").filter(F.coalesce("scope", F.lit("unknown")) == label))
        assert sorted(map(tuple, got.filter(F.col("label") == label).select(columns).collect())) == sorted(map(tuple, own.collect()))
    assert {tuple(r.versions) for r in got.collect()} == {("v2", "v1", "v0")}


def test_a_batch_that_runs_again_counts_once(spark):
    at, all_ = folder(spark), entries(spark, 30)
    all_.coalesce(1).write.parquet(f"{at}-log")
    report.ingest(spark, f"{at}-log", f"{at}-sums")
    once = sorted(map(str, report.report(spark, f"{at}-sums").collect()))
    again = spark.read.parquet(f"{at}-sums/sums/batch=0")
    report.partial(all_).coalesce(1).write.mode("overwrite").parquet(f"{at}-sums/sums/batch=0")
    assert sorted(map(str, report.report(spark, f"{at}-sums").collect())) == once and again.columns
