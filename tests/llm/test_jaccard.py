import random
from collections import Counter, defaultdict

import pytest

from marlstone.llm import jaccard
from marlstone.llm.components import components

from .test_repeats import thue_morse
from .helpers import LOWER, WORD, awkward, nothing, rows_of, texts_of

COLUMNS = ("doc_id", "n_shingles", "component_id")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent, n):
    sets = [(d, shingles(t, n)) for d, t in rows]
    first = {}
    for d, s in sets:
        if s and d is not None:
            first[s] = min(first.get(s, d), d)
    holders, reps = defaultdict(set), list(first.items())
    for i, (s, _) in enumerate(reps):
        for x in s:
            holders[x].add(i)
    parent = {d: d for _, d in reps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (s, d) in enumerate(reps):
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(reps[j][0]) - both):
                a, b = root(d), root(reps[j][1])
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), root(first[s]) if s else d) for d, s in sets), key=repr)


def near_copies():
    rng = random.Random(7)
    bases = [[rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(80)] for _ in range(6)]
    rows = []
    for i in range(300):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["xx", "yy", "aa", f"Zz{rng.randrange(9)}"])
        rows.append((i, " ".join(w)))
    return rows + [(400, None), (401, ""), (402, "a"), (403, "A"), (404, "a b"), (405, "b a"), (406, " a\tb "), (407, "a a a a a"), (408, "a  a a"), (409, "é É x")]


@pytest.mark.parametrize("percent, n, chunk_bytes, block", [(90, 3, 1 << 20, 1500), (90, 3, 2000, 20), (80, 5, 500, 7)])
def test_against_brute_force(spark, percent, n, chunk_bytes, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.jaccard_components(docs, percent, n, chunk_bytes=chunk_bytes, block=block)
    assert rows_of(found, *COLUMNS) == brute(rows, percent, n)


def test_awkward_rows(spark):
    docs = awkward(spark).filter("doc_id IS NOT NULL")
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(texts_of(docs), 90, 3)
    assert jaccard.jaccard_components(awkward(spark)).count() == awkward(spark).count()


@pytest.mark.parametrize("size", [1024, 4096])
def test_no_hash_cancels(spark, size):
    one, other = thue_morse(size)
    rows = [(1, "".join(one)), (2, "".join(other)), (3, " ".join(one)), (4, " ".join(other)), (5, " ".join([*one, "c"]))]
    rows += [(6, f"x {''.join(one)} y"), (7, f"x {''.join(other)} y"), (8, f"x {''.join(one)} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(rows, 90, 3)
    assert rows_of(jaccard.jaccard_components(docs, n=size), *COLUMNS) == brute(rows, 90, size)


def test_empty(spark):
    assert jaccard.jaccard_components(nothing(spark)).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_words_that_collide_under_known_numbers(spark):
    from marlstone.llm import wordhash

    pairs = [("ng5by1a2atpaaaaa", "1qne1nys594cup1i")]
    rows = []
    for i, (x, y) in enumerate(pairs * 3):
        rows += [(10 * i, f"{x} is here today {i}"), (10 * i + 1, f"{y} is here today {i}"), (10 * i + 2, x * (i + 1)), (10 * i + 3, y * (i + 1))]
    import numpy as np
    import pyarrow as pa

    known = wordhash.Words(pa.array([f"{x} {y}" for x, y in pairs])).hashes()
    assert known[0] == known[1]
    drawn = wordhash.Words(pa.array([f"{x} {y}" for x, y in pairs]), secret=0x1234567890ABCDEF).hashes()
    assert drawn[0] != drawn[1] and len(np.unique(drawn)) == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.jaccard_components(docs), *COLUMNS) == brute(rows, 90, 3)
