from concurrent.futures import ThreadPoolExecutor

from marlstone.operators import mutations
from marlstone.sources import tables

ROWS = "id long, at long, deleted boolean, overflowed boolean"


def test_sessions_that_save_at_once_lose_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    session = lambda n: spark.createDataFrame([(i, n, False, False) for i in range(n, n + 3)], ROWS)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: tables.save_merged(session(n), at, mutations.merged, ROWS), range(4)))
    assert {(r.id, r.at) for r in tables.load(spark, at, ROWS).collect()} == {(i, min(i, 3)) for i in range(6)}


def test_a_version_has_one_owner_and_a_session_that_died_none(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, 1, False, False)], ROWS)
    tables._staged(rows.limit(0), at)
    assert tables.load(spark, at, ROWS).count() == 0 and tables.save_merged(rows, at, mutations.merged, ROWS) == 1
    assert not tables._committed(spark, at, tables._staged(rows.limit(0), at), 1) and tables.load(spark, at, ROWS).count() == 1
    assert tables.save(rows.limit(0), at) == 2 and tables.load(spark, at, ROWS).count() == 0


def test_torn_files_are_an_empty_store_if_asked(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    tables.save(spark.createDataFrame([(1, 1, False, False)], ROWS).coalesce(1), at)
    torn = next(p for p in (tmp_path / "store").glob("data-*/*") if p.name.endswith(".parquet"))
    torn.write_bytes(b"torn")
    for check in (tmp_path / "store").glob("data-*/.*.crc"):
        check.unlink()
    assert tables.load(spark, at, ROWS, tolerant=True).count() == 0


def test_the_state_of_two_copies(spark):
    schema = "part string, key string, value long"
    mine = spark.createDataFrame([("stats", "hits", 3), ("failures", "a", 1), ("quarantined", "a", 1), ("done", "x", 5), ("done", "y", 1), ("backoff_until", "", 7), ("stats", "null", None)], schema)
    disk = spark.createDataFrame([("stats", "hits", 2), ("stats", "other", 9), ("failures", "a", 2), ("failures", "b", 1), ("quarantined", "a", 4), ("quarantined", "b", 5), ("done", "x", 9), ("done", "z", 3), ("backoff_until", "", 8)], schema)
    got = {tuple(r) for r in mutations.merged_state(mine, disk, most=2).collect()}
    assert got == {("stats", "hits", 3), ("failures", "a", 2), ("failures", "b", 1), ("quarantined", "a", 1), ("quarantined", "b", 5), ("done", "x", 5), ("done", "z", 3), ("backoff_until", "", 8)}
    assert mutations.merged_state(mine.limit(0), disk.limit(0)).count() == 0


def test_a_cut_row_is_new_and_others_keep_their_record(spark):
    schema = "id long, memory string, updated_at string, overflow struct<originalChars:bigint,truncatedAt:bigint>"
    rows = spark.createDataFrame([(1, "a" * 4001, "old", None), (2, "b" * 4000, "old", (9000, 4000)), (3, None, "old", None), (4, "", "old", None)], schema)
    got = {r.id: (r.memory, r.updated_at, r.overflow and tuple(r.overflow)) for r in mutations.loaded(rows, "now").collect()}
    assert got == {1: ("a" * 4000, "now", (4001, 4000)), 2: ("b" * 4000, "old", (9000, 4000)), 3: (None, "old", None), 4: ("", "old", None)}
