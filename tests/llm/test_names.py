import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import names, queries

SF = "/root/testdata/sf0.001"


def distance(a, b):
    """Optimal string alignment, the whole matrix."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def brute(left, right, edits=2):
    out = defaultdict(list)
    for v, b in set(right):
        for c, a in left:
            if a and b and abs(len(a) - len(b)) <= edits and (k := distance(a, b)) <= edits:
                out[v, k].append(c)
    known = lambda ids: [c for c in ids if c is not None]
    return sorted(((v, k, len(ids), min(known(ids), default=None), sum(zlib.crc32(str(c).encode()) for c in known(ids))) for (v, k), ids in out.items()), key=repr)


def found(spark, left, right, **how):
    frames = [spark.createDataFrame([(*r, "z", "z") for r in rows], "id long, name string, key string, a string").repartition(3) for rows in (left, right)]
    return sorted(((r.id, r.distance, r.n, r.first_id, r.crc) for r in names.near_names(*frames, **how).collect()), key=repr)


def edited(rng, name, times):
    for _ in range(times):
        i, how = rng.randrange(len(name) + 1), rng.randrange(4)
        if how == 0:
            name = name[:i] + rng.choice("abcd") + name[i:]
        elif how == 1:
            name = name[:i] + name[i + 1 :]
        elif how == 2:
            name = name[:i] + rng.choice("abcd") + name[i + 1 :]
        else:
            name = name[:i] + name[i + 1 : i + 2] + name[i : i + 1] + name[i + 2 :]
    return name


@pytest.mark.parametrize("edits, q", [(2, 3), (2, 2), (1, 3), (3, 2), (0, 3)])
def test_random_names_of_every_length(spark, edits, q):
    rng = random.Random(edits * 10 + q)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 24))) for _ in range(60)]
    left = [(i, edited(rng, n, rng.randrange(4))) for i, n in enumerate(base * 2)]
    right = [(i, edited(rng, n, rng.randrange(4))) for i, n in enumerate(base)]
    assert found(spark, left, right, edits=edits, q=q) == brute(left, right, edits)


def test_awkward_names(spark):
    long = "äx" * 400
    left = [(1, None), (2, ""), (3, "a"), (4, "ab"), (4, "ab"), (None, "ab"), (5, "日本語"), (6, "🙂🙃 x"), (7, long), (8, "ca"), (9, "aaaaaaaaaaaaaaaaaaaaaaaa"), (10, "aaaaaaaaaaaaaaaaaaaaaa")]
    right = [(1, "b"), (1, "ab"), (2, "ba"), (2, "ba"), (None, "abc"), (3, None), (4, ""), (5, "日語本"), (6, "🙃🙂 x"), (7, long[:500] + "yy" + long[500:]), (8, "abc"), (9, "a" * 23)]
    assert found(spark, left, right) == brute(left, right)


def test_one_name_of_very_many_rows(spark):
    left = spark.range(100_000).select("id", F.lit("Elsama Berleyberez").alias("name"))
    right = spark.range(20_000).select("id", F.lit("Elsama Berleybreez").alias("name"))
    rows = names.near_names(left, right)
    assert rows.groupBy("distance", "n", "first_id").count().collect() == [(1, 100_000, 0, 20_000)]


def test_no_substring_is_edited_twice():
    assert names._distances(["ca", "abc", "ab"], ["abc", "ca", "ba"], 2).tolist() == [3, 3, 1]


def test_misspelt(spark):
    rows = [(i, n) for i in range(40) for n in ("", "x", "xy", "Äbc DÖ")] + [(None, "abc"), (3, None)]
    df = spark.createDataFrame(rows, "vendor_id long, name string").select("vendor_id", "name", names.folded(names.misspelt("name", "vendor_id")).alias("made"))
    for i, n, made in df.collect():
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if n and len(n) > 1 and h % 2 == 0:
            p = h % (len(n) - 1)
            n = n[:p] + n[p + 1] + n[p] + n[p + 2 :]
        assert made == (n and "".join(c.lower() if c.isascii() else c for c in n))


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == []


def test_query_against_sql_and_brute_force(spark):
    duck = duckdb.connect()
    tables = {}
    for t in ("clients", "vendors"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        tables[t] = duck.execute(f"SELECT {t[:-1]}_id, name FROM {t}").fetchall()
    got = queries.QUERIES["op13_names"](spark, SF)
    columns = ["vendor_id", "distance", "n_clients", "first_client_id", "clients_crc"]
    assert got.columns == columns
    ours = sorted((tuple(r) for r in got.collect()), key=repr)
    assert ours == sorted(duck.execute(queries.ORACLE_SQL["op13_names"]).fetchall(), key=repr)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    right = []
    for i, n in tables["vendors"]:
        h = zlib.crc32(str(i).encode())
        if n and len(n) > 1 and h % 2 == 0:
            p = h % (len(n) - 1)
            n = n[:p] + n[p + 1] + n[p] + n[p + 2 :]
        right.append((i, n and n.translate(low)))
    assert ours == brute([(i, n and n.translate(low)) for i, n in tables["clients"]], right)
