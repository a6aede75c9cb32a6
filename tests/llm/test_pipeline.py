"""The pipeline's stages against brute force, one after the other."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from marlstone.llm import decontaminate
from marlstone.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file
from marlstone.llm.shared import scratch, shared_dir

from .helpers import nothing
from .test_decontaminate import best
from .test_jaccard import brute as brute_groups
from .test_line_dedup import brute as brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(p.STAGES)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    found = stages["language_id"](spark, docs, SF)
    assert found.columns == docs.columns and rows(found) == [(d, t) for d, t in rows(docs) if any(c.isalpha() for c in t)]

    # The quadratic distance is only worked out for lines that start or end alike or share their middle.
    cut = stages["line_dedup"](spark, found, SF)
    assert cut.columns == docs.columns
    short = found.filter("length(text) < 1500")
    few = short.orderBy("doc_id").limit(40)
    expected, _ = brute_lines(rows(few), 32)
    assert rows(stages["line_dedup"](spark, few, SF)) == sorted((d, t) for d, t, n, gone, _ in expected if not gone or t.strip())
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    grouped = stages["ngram_jaccard"](spark, cut, SF)
    assert rows(grouped) == sorted((d, t) for (d, t), (_, _, c) in zip(rows(cut), sorted(brute_groups(rows(cut), 80, 5))) if c == d)

    clean = stages["decontaminate"](spark, grouped, SF)
    dirty = {d for d, t in rows(grouped) if any(i[:40] in decontaminate.normalise(t) and best(i, decontaminate.normalise(t)) <= len(i) // 16 for i in items)}
    assert rows(clean) == [(d, t) for d, t in rows(grouped) if d not in dirty]

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    encoded = {r.doc_id: r.ids for r in stages["sentencepiece"](spark, clean, SF).collect()}
    assert encoded == {d: model.encode(t) + [2] for d, t in rows(clean)}
    with scratch() as paths:
        assert {r.doc_id: r.ids for r in p.run(spark, SF).collect()} == encoded
    assert not paths  # a run has scopes of its own


def test_a_run_leaves_one_table(spark):
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    p.run(spark, SF)
    left = set(os.listdir(at)) - before
    assert len(left) == 1 and left.pop().startswith("stage-decontaminate")


BENCHMARK = "Which of the seven wizards brewed a potion of unusual strength near the old mill?"
LINE = "a line of some forty characters that stands in several places"
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
CLASHING = ("row_0", "member", "of", "n", "high", "low", "chunk", "rest", "node", "label", "clear", "items")


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame([(1, BENCHMARK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def frame(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(d, t, "en" if t else None, None, len(t or "")) + ("z",) * len(CLASHING) for d, t in rows], ", ".join([columns, *[f"{c} string" for c in CLASHING]])).repartition(3)


def stage_rows(spark, name, rows, folder):
    docs = frame(spark, rows)
    found = dict(p.STAGES)[name](spark, docs, folder)
    assert name == "sentencepiece" or (found.columns == docs.columns and dict(found.dtypes) == dict(docs.dtypes))
    return found.collect()


def both(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def test_language_stage_cases(spark, folder):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, TEXT), (4, TEXT), (None, TEXT), (5, TEXT * 2000), (6, "日本語の文章です。" * 50)]
    found = stage_rows(spark, "language_id", rows, folder)
    # 6 is learned from too: it is labelled.
    assert both(found) == sorted([(4, TEXT), (4, TEXT), (None, TEXT), (5, TEXT * 2000), (6, rows[-1][1])], key=repr)
    assert {r.lang for r in found} == {"en"}


def test_line_stage_cases(spark, folder):
    rows = [(1, None), (2, ""), (3, f"{LINE}\nx"), (4, f"{LINE}\n\nother words\n{LINE[:-1]}"), (5, LINE), (6, "x"), (7, "y\n" * 20_000), (None, f"{LINE}\nno id"), (8, "z"), (8, "z")]
    found = stage_rows(spark, "line_dedup", rows, folder)
    assert both(found) == sorted([(1, None), (2, ""), (3, f"{LINE}\nx"), (4, "\nother words"), (7, "y\n"), (None, "no id"), (8, "z"), (8, "z")], key=repr)
    assert {(r.doc_id, r.n_chars) for r in found} >= {(1, None), (2, 0), (4, 12), (7, 2)}


def test_document_stage_drops_rows_not_ids(spark, folder):
    near = TEXT.replace("twenty", "20")
    rows = [(1, TEXT), (1, "a text of its own that shares an id with a copy of another text"), (2, near), (2, "another text of its own"), (None, TEXT), (None, "no id and no copy")]
    rows += [(3, "w " * 30_000), (4, "w " * 30_000 + "v"), (5, None), (5, None), (6, ""), (7, " "), (8, "short"), (9, "SHORT"), (10, "equal rows"), (10, "equal rows"), (0, near)]
    found = stage_rows(spark, "ngram_jaccard", rows, folder)
    # The sets of 3 and 4 have two shingles and one of them: they are not near.
    gone = [(1, TEXT), (2, near), (None, TEXT), (9, "SHORT"), (10, "equal rows")]
    left = list(rows)
    for row in gone:
        left.remove(row)
    assert both(found) == sorted(left, key=repr)


def test_benchmark_stage_cases(spark, folder):
    rows = [(1, None), (2, ""), (3, f"x {BENCHMARK.upper()} y"), (3, f"x {BENCHMARK.upper()} y"), (4, BENCHMARK.replace("seven", "sevan")), (3, "clean"), (None, BENCHMARK), (5, TEXT * 500), (6, TEXT * 500 + BENCHMARK)]
    assert both(stage_rows(spark, "decontaminate", rows, folder)) == sorted([rows[0], rows[1], rows[5], rows[7]], key=repr)


def test_encoding_stage_cases(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rows = [(1, None), (2, ""), (3, TEXT), (3, TEXT), (None, "x"), (5, TEXT * 3000)]
    found = stage_rows(spark, "sentencepiece", rows, folder)
    expected = [(d, model.encode(t or "") + [2]) for d, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in found), key=repr) == sorted(expected, key=repr) and all(r.n_tokens == len(r.ids) for r in found)


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_stages_of_no_rows(spark, folder, name):
    assert dict(p.STAGES)[name](spark, nothing(spark).withColumn("n_chars", F.col("n_chars").cast("long")), folder).collect() == []


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
