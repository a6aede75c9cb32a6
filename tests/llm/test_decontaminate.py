import random

import pytest

from marlstone.llm import decontaminate

from .helpers import awkward, nothing

TEXT = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of unusual strength near the old mill"


def best(pattern, text):
    """Least edits between a pattern and any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(500):
        p, t = "".join(rng.choices("ab", k=rng.randint(1, 70))), "".join(rng.choices("ab", k=rng.randint(1, 90)))
        found = decontaminate.best_end(decontaminate.Item(0, p, 0).masks, len(p), t, 999)
        assert found is None or found[0] >= best(p, t)
        if best(p, t) < len(p):
            assert found[0] == best(p, t)


@pytest.mark.parametrize("seed", range(3))
def test_every_occurrence_within_the_budget_is_found(spark, seed):
    rng = random.Random(seed)
    words = TEXT.split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 20)))) for i in range(12)]
    rows = []
    for d in range(150):
        parts = rng.choices(words, k=rng.randint(0, 60))
        if rng.random() < 0.5:
            chars = list(decontaminate.normalise(rng.choice(items)[1]))
            for _ in range(rng.randint(0, 9)):
                chars[rng.randrange(len(chars))] = rng.choice("abcxyz ")
            parts.insert(rng.randrange(len(parts) + 1), "".join(chars))
        rows.append((d, rng.choice([" ", "  ", "! ", "\n"]).join(parts).title()))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect()}
    expected = set()
    for d, t in rows:
        for i, item in items:
            p = decontaminate.normalise(item)
            if len(p) >= 24 and best(p, decontaminate.normalise(t)) <= len(p) // 16:
                expected.add((d, i))
    assert found == expected and expected
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench, block_bytes=300).collect()}
    assert blocks == found
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, block_bytes=300).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in found}


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "short"), (5, TEXT), (6, TEXT), (7, "one two three four five six seven")], "item_id long, text string")
    hits = decontaminate.find_contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in hits} == {(13, 7, 0)} and len(hits) == 2  # it stands there twice


def test_short_items_count_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "What is a Cat?"), (2, "concatenate cats"), (3, "a cat"), (4, "CAT"), (5, "the quick brown foxes (and so on)"), (6, "the, quick brown fox"), (7, "cat cat x cat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat"), (2, "The quick brown fox!")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.find_contamination(docs, bench).collect())
    assert found == [(1, 1, 10, 13, 0), (3, 1, 2, 5, 0), (4, 1, 0, 3, 0), (6, 2, 0, 19, 0), (7, 1, 0, 3, 0), (7, 1, 4, 7, 0), (7, 1, 10, 13, 0)]


def test_drop_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "short"), (5, TEXT), (6, TEXT), (7, "one two three four five six seven")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 1
    assert decontaminate.find_contamination(nothing(spark), bench).collect() == []
    assert decontaminate.find_contamination(docs, bench.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_null_and_repeated_item_ids(spark):
    first, second = "alpha beta gamma delta epsilon zeta", "delta epsilon zeta eta theta iota kappa"
    text = "so alpha beta gamma delta epsilon zeta eta theta iota kappa it ends"
    docs = spark.createDataFrame([(1, text), (2, "nothing of the kind")], "doc_id long, text string")
    for ids in ((None, None), (7, 7), (None, 7)):
        items = spark.createDataFrame([(ids[0], first), (ids[1], second), (ids[1], second)], "item_id long, text string")
        found = sorted(((r.item_id, r.start) for r in decontaminate.find_contamination(docs, items).collect()), key=repr)
        assert found == sorted([(ids[0], 3), (ids[1], 20)], key=repr)
        assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]
