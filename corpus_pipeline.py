"""A training corpus from raw documents, in five stages that each call one operator.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; columns beside those of ``documents`` pass through,
whatever their names. Stages decide on rows: rows with equal ids, or with none,
are judged each by its own text. What a stage writes on its way is removed when
its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm import decontaminate, jaccard, language_id, line_dedup, sentencepieces
from marlstone.llm.queries import table, tokenizer_file
from marlstone.llm.shared import remove, scratch, stash

#: Near-duplicate documents: words of a shingle, and the least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; ``lang`` becomes the language that the models predict.

    The models learn from a bounded sample of the labelled documents. A text has no language if no letter is in it, or
    if every model needs clearly more bits for it than eight for each byte.
    Cases: a null or empty text has no language and goes; a null lang is not learned from and gets one; short texts
    stay unless they are clearly foreign; long texts are scored whole; ties go to the smaller name; repeated rows stay
    repeated; if nothing can be learned (an empty table among others), nothing stays.
    """
    return language_id.keep_identified(docs, language_id.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, or within two edits of an earlier one, and documents of which no word is left.

    Near lines are those of 32 characters or more; equal ones of any length but blank go. ``n_chars`` is that of the text left.
    Cases: a null text stays null, with its n_chars null; an empty text stays; blank lines stay; the earliest place, by id
    and then by line, keeps its line, and rows with equal ids keep each their first (a null id is the latest);
    an empty table gives none.
    """
    cut = line_dedup.without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays.

    Rows get a number of their own, written with them, by which they are grouped and dropped.
    Cases: null, empty and wordless texts are near to none and stay; a null id is larger than any other; of rows with
    the smallest id one stays; repeated rows are near-duplicates of each other; an empty table gives none.
    """
    row = next(name for name in (f"row_{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard.jaccard_components(rows, SIMILAR_PERCENT, SHINGLE_WORDS, id_col=row)
    groups = stash(groups.filter("n_shingles > 0").select(F.col("doc_id").alias("member"), F.col("component_id").alias("of")), "groups")
    # Groups of one, which most are, need no comparison of ids.
    several = groups.groupBy("of").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("of")
    members = groups.join(several, "of").join(rows.select(F.col(row).alias("member"), F.col("doc_id").alias("id")), "member")
    members = stash(members.select("of", "member", F.struct(F.col("id").isNull(), "id", "member").alias("rank")), "members")
    first = members.groupBy("of").agg(F.min("rank").alias("least"))
    gone = members.join(first, "of").filter(F.col("rank") > F.col("least")).select(F.col("member").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of ``benchmark`` occurs, within its error budget, go.

    Cases: null and empty texts hold no item and stay; null items and items without letters or digits are in no text;
    long texts are searched whole; repeated rows are judged alike; an empty table gives none, and no items leave all.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text that they decode to, a row for each row.

    Cases: a null text counts as empty, and an empty one is the end id alone; a null id stays null; long texts are
    encoded whole; repeated rows give equal rows; other columns are left out; an empty table gives none.
    """
    found = sentencepieces.encode_decode(docs, tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontaminate", remove_benchmarks),
    ("sentencepiece", encode),
]

#: SQL expresses neither the language models nor the tokenizer: the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scratch() as paths:
            docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        remove(spark, written + paths[:-1])
        written = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
