import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import line_dedup, queries

from .helpers import awkward, nothing, rows_of, texts_of

COLUMNS = ("doc_id", "text", "n_lines", "n_removed", "n_near")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def brute(rows, least, equal=1):
    places = {}
    rank = lambda d: (d is None, d or 0)
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(line.strip()) >= min(least, equal):
                places.setdefault(line.strip(), []).append((rank(d), n))
    first = {s: min(p) for s, p in places.items()}
    lines, later, links = [s for s in first if len(s) >= least], set(), 0
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                links += 1
                later.add(max(a, b, key=lambda s: first[s]))
    out = []
    for d, t in rows:
        keep, removed, near = [], 0, 0
        parts = t.split("\n") if t else []
        for n, line in enumerate(parts):
            s = line.strip()
            if s in first and (s in later or first[s] != (rank(d), n)):
                removed, near = removed + 1, near + (s in later)
            else:
                keep.append(line)
        out.append((d, None if t is None else "\n".join(keep), len(parts), removed, near))
    return sorted(out, key=repr), links


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at, how = rng.randint(0, len(chars)), rng.random()
        if how < 0.33:
            chars.insert(at, rng.choice("abé"))
        elif chars and how < 0.66:
            chars.pop(min(at, len(chars) - 1))
        elif chars:
            chars[min(at, len(chars) - 1)] = rng.choice("abé")
    return "".join(chars)


def test_banded_distance():
    rng = random.Random(1)
    pairs = []
    while len(pairs) < 3000:
        a = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 4))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    a, b = map(list, zip(*pairs))
    assert line_dedup.within(a, b).tolist() == [min(distance(x, y), 3) for x, y in pairs]


@pytest.mark.parametrize("chunk_bytes", [400, 1 << 20])
def test_against_brute_force(spark, chunk_bytes):
    rng = random.Random(5)
    pool = ["".join(rng.choices("ab ", k=rng.randint(8, 14))) for _ in range(30)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.randint(0, 3)) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, links = brute(rows, 6)
    found = line_dedup.LineJoin(docs, min_chars=6, chunk_bytes=chunk_bytes)
    assert found.links.count() == links
    assert rows_of(found.cut(), *COLUMNS) == expected


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert rows_of(line_dedup.dedup_lines(docs, min_chars=20), *COLUMNS) == brute(texts_of(docs), 20)[0]
    assert rows_of(line_dedup.dedup_lines(docs, min_chars=20, equal_chars=20), *COLUMNS) == brute(texts_of(docs), 20, 20)[0]
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    rows = brute(texts_of(docs), line_dedup.MIN_CHARS)[0]
    assert kept.count() == sum(t is None or not gone or bool(t.strip()) for _, t, _, gone, _ in rows)


def test_a_document_of_repeated_lines_goes(spark):
    line = "a line that is long enough to be compared with others"
    docs = spark.createDataFrame([(1, line), (2, line), (3, line + "\nshort"), (4, "short")], "doc_id long, text string")
    assert texts_of(line_dedup.without_repeated_lines(docs)) == [(1, line), (3, "short")]
    assert texts_of(line_dedup.without_repeated_lines(docs, equal_chars=10)) == [(1, line), (3, "short"), (4, "short")]


def test_short_lines_go_if_equal(spark, tmp_path):
    near = "a line that is long enough to be compared with others"
    rows = [(1, f"MIT License.\n\nx\n{near}"), (2, f" MIT License.\n\nMIT Licence.\n{near}s"), (3, "x"), (4, None), (5, "MIT License.\ny\nx\ny\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    cut = rows_of(line_dedup.dedup_lines(docs, chunk_bytes=40), *COLUMNS)
    assert cut == [(1, rows[0][1], 4, 0, 0), (2, "\nMIT Licence.", 4, 2, 1), (3, "", 1, 1, 0), (4, None, 0, 0, 0), (5, "y\n", 5, 3, 0)]
    # The registered query compares every line that is not blank.
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(queries.op2_line_dedup(spark, str(tmp_path)), "doc_id", "n_removed", "n_near") == [(d, r, n) for d, _, _, r, n in cut]
    assert texts_of(line_dedup.without_repeated_lines(docs)) == [(d, t) for d, t, *_ in cut if d != 3]


def test_empty(spark):
    assert line_dedup.dedup_lines(nothing(spark)).collect() == []


def test_columns_that_are_never_null(spark):
    line = "a line of more than thirty-two characters"
    docs = spark.range(3).selectExpr("id AS doc_id", f"if(id < 2, '{line}', 'another') AS text", "'x' AS batch", "named_struct('a', id, 'b', array(1)) AS nested", "map('k', 1) AS pairs")
    assert not docs.schema["doc_id"].nullable and not docs.schema["batch"].nullable
    rows = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs).collect()}
    assert rows.keys() == {0, 2} and rows[2].nested.a == 2 and rows[0].batch == "x" and rows[0].pairs == {"k": 1}
