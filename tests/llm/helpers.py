"""Fixtures shared by the operators' tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Null and empty texts, ties, repeated rows, odd characters; a long text is added by ``awkward``.
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "A"), (6, "a  b\tc"), (6, "a  b\tc"), (7, "a b c"), (8, "a b c"), (None, "no id"), (9, None),
    (10, "日本 語 🙂 é ́"), (11, "x\x01y  z ▁ w\x00v"), (12, "The the, THE. the! token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""),
    (13, "one two three four five six seven eight nine ten\none two three four five six seven eight nine ten"), (14, "12 34 . , ; 5"),
]
#: Names that operators use for columns of their own.
CLASHES = ("chunk", "rest", "h", "norm", "part", "seq", "node", "label", "content", "start", "n", "bucket", "clear", "finds", "_found", "key")


def awkward(spark, extra=True):
    rows = ROWS + [(20, "wörd längere " * 40_000), (21, "x" * 300_000)]
    columns = ["doc_id long", "text string", "lang string", "source string", "n_chars int"]
    values = [(d, t, "en" if (d or 0) % 2 else None, None, len(t or "")) for d, t in rows]
    if extra:
        columns += [f"{c} string" for c in CLASHES]
        values = [v + ("z",) * len(CLASHES) for v in values]
    return spark.createDataFrame(values, ", ".join(columns)).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def texts_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)
