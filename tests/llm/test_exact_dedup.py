import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm.exact_dedup import exact_dedup, md5_128

from .helpers import awkward, nothing, rows_of, texts_of

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), i == ids.index(keep), hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, weak):
    docs = awkward(spark)
    content_hash = (lambda t: F.substring(F.unhex(F.md5(t)), 1, 0)) if weak else md5_128  # every hash collides
    assert rows_of(exact_dedup(docs, content_hash=content_hash), *COLUMNS) == brute(texts_of(docs))


def test_empty(spark):
    assert exact_dedup(nothing(spark)).collect() == []
