import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import language_id
from marlstone.llm.shared import bytes_of

from .helpers import awkward, nothing

SF = "/root/testdata/sf0.01"


class Brute:
    """Frozen counts of orders 3 to 0, method C, in plain dictionaries; contexts of three bytes from ``min_count`` on in all samples."""

    def __init__(self, samples, min_count):
        self.known = {b for texts in samples.values() for t in texts for b in t} | {10}
        self.counts, deep = {}, Counter()
        for lang, texts in samples.items():
            seen = self.counts[lang] = {}
            for t in texts:
                padded = b"\n\n\n" + t
                for i in range(3, len(padded)):
                    deep[padded[i - 3 : i]] += 1
                    for k in range(4):
                        seen.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
        for seen in self.counts.values():
            for context in [c for c in seen if len(c) == 3 and deep[c] < min_count]:
                del seen[context]
        self.memory = {}

    def cost(self, lang, context, b):
        if (lang, context, b) not in self.memory:
            p = 1 / 256
            for k in range(4):
                # A byte that was never learned opens no context.
                c = self.counts[lang].get(context[3 - k :]) if set(context[3 - k :]) <= self.known else None
                if c:
                    n, d = sum(c.values()), len(c)
                    p = c[b] / (n + d) + d / (n + d) * p
            self.memory[lang, context, b] = -math.log2(p)
        return self.memory[lang, context, b]

    def bits(self, lang, text):
        padded = b"\n\n\n" + text
        return sum(self.cost(lang, padded[i - 3 : i], padded[i]) for i in range(3, len(padded)))


@pytest.mark.parametrize("min_count", [1, 2, 3])
def test_code_lengths_are_those_of_the_escape_rule(min_count):
    samples = {"x": [b"abracadabra abra", b"cad abra"], "y": [b"zzz yyy zzz", b"bra"], "z": [b"a"]}
    trees, plain = language_id.Trees(samples, min_count=min_count), Brute(samples, min_count)
    for text in (b"abra zad?\xff", b"", b"zzzzbraabracad", b"?\xff\xfeabra"):
        found = trees.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] / language_id.UNITS
        assert found.tolist() == pytest.approx([plain.bits(lang, text) for lang in trees.langs], abs=len(text) / language_id.UNITS + 1e-9)


def test_no_cost_is_clipped():
    """After a frequent context that never failed, a byte never seen costs more than 16 bits of 1/2048 bit could hold."""
    samples = {"x": [b"ab" * 200_000], "y": [b"abc"]}
    trees, plain = language_id.Trees(samples), Brute(samples, 3)
    text = b"ababc?"
    found = trees.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0] / language_id.UNITS
    assert found[0] > 64 and found.tolist() == pytest.approx([plain.bits(lang, text) for lang in trees.langs], abs=1e-3)


def test_the_whole_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.filter("length(text) < 3000").unionByName(awkward(spark, False).filter("length(text) < 3000").withColumn("n_chars", F.length("text").cast("long")))
    rows = docs.collect()
    samples = {}
    for r in sorted(rows, key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.text or "")):
        if r.lang and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            samples.setdefault(r.lang, {}).setdefault(r.doc_id, r.text)
    samples = {lang: [t.encode() for t in list(found.values())[:12]] for lang, found in samples.items()}
    plain, expected = Brute(samples, 3), []
    for r in rows:
        bits = {lang: plain.bits(lang, (r.text or "").encode()) for lang in sorted(samples)}
        best = min(bits, key=bits.get)
        clear = any(c.isalpha() for c in r.text or "")
        expected.append((r.doc_id, best if clear else "und", 1 / sum(2 ** max(-1000, bits[best] - b) for b in bits.values()) if clear else 0.0, bits[best]))
    trees = language_id.learn(docs, sample_docs=12)
    found = [(r.doc_id, r.lang_pred, r.score, r.bits) for r in language_id.predict(docs, trees).collect()]
    order = lambda r: (r[0] is None, r[0], r[3])
    for a, b in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=0.05)


def test_texts_of_a_batch_do_not_see_each_other():
    trees = language_id.Trees({"x": [b"abc abd abe"], "y": [b"xyz xy"]}, min_count=1)
    texts = ["abc", "", "a", "bd", "x", "", "yz abe", ""]
    raw, ends = bytes_of(pa.array(texts))
    together = trees.code_lengths(raw, ends)
    for i, t in enumerate(texts):
        raw, ends = bytes_of(pa.array([t]))
        assert trees.code_lengths(raw, ends)[0].tolist() == together[i].tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predict(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").select("*", language_id.held_out().alias("held_out")).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_awkward_rows(spark):
    docs = awkward(spark)
    trees = language_id.learn(docs)
    found = {(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, trees).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (14, "und", 0.0), (4, "en", 1.0)} <= found
    kept = language_id.keep_identified(docs, trees)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= {d for d, lang, _ in found if lang != "und"}
    assert {(r.doc_id, r.lang) for r in kept.collect()} <= {(d, lang) for d, lang, _ in found}


def test_texts_that_no_model_explains_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    trees = language_id.learn(docs)
    odd = spark.createDataFrame([(-1, "日本語の文章です。" * 5), (-2, None), (-3, "12 34"), (-4, "The"), (-5, "")], "doc_id long, text string")
    both = docs.unionByName(odd, allowMissingColumns=True)
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(both, trees).collect()}
    predicted = {r.doc_id: r.lang_pred for r in language_id.predict(both, trees).collect() if r.doc_id not in (-1, -2, -3, -5)}
    assert kept == predicted and len(kept) == docs.count() + 1
    assert language_id.keep_identified(both.limit(0), trees).collect() == []


def test_any_number_of_languages(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('text of ', id % 1200) AS text", "cast(id % 1200 AS string) AS lang")
    rows = docs.filter(~language_id.held_out())
    assert len(language_id._smallest(rows.selectExpr("lang", "doc_id", "md5(cast(doc_id AS string)) AS pick"), 2)) >= 1_200
    assert language_id.learn(docs.filter("lang < '11'")).langs == sorted(r.lang for r in rows.filter("lang < '11'").select("lang").distinct().collect())


def test_languages_of_long_texts_alone_are_learned(spark):
    english, german = "the quick brown fox jumps over the lazy dog and ", "der schnelle braune Fuchs springt über den faulen Hund und "
    docs = spark.range(24).selectExpr("id AS doc_id", f"repeat(if(id % 2 = 0, '{english}', '{german}'), 23000) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    trees = language_id.learn(docs)
    assert {r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in language_id.predict(docs, trees).collect()} == {True}
    assert language_id.keep_identified(docs, trees).count() == 24
    small = language_id.learn(docs, sample_bytes=100)
    assert small.langs == ["de", "en"]


def test_nothing_to_learn_from(spark):
    docs = awkward(spark).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(docs)).collect()} == {"und"}
    assert language_id.predict(nothing(spark), language_id.learn(nothing(spark))).collect() == []


def test_the_sample_is_the_smallest_picks(spark):
    rows = [("en", i) for i in range(3000)] + [("fr", i) for i in range(40)] + [("de", 7)] * 50
    df = spark.createDataFrame(rows, "lang string, doc_id long").repartition(9).selectExpr("lang", "doc_id", "md5(cast(doc_id AS string)) AS pick")
    expected = []
    for lang in ("de", "en", "fr"):
        expected += sorted((lang, hashlib.md5(str(d).encode()).hexdigest(), d) for d in {d for x, d in rows if x == lang})[:50]
    assert language_id._smallest(df, 50) == expected
