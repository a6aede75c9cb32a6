import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from marlstone.llm import repeats
from marlstone.llm.wordhash import Words

from .helpers import WORD, awkward, nothing, rows_of, texts_of

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, k):
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in words for i in range(len(w) - k + 1))
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_words_and_their_hashes():
    rng = random.Random(3)
    texts = ["", " ", "a", "a b  c", "\n x\ty\x0bz ", "é ü k w"] + ["".join(rng.choices("ab \n", k=rng.randint(0, 40))) for _ in range(300)]
    words, by_word = Words(pa.array(texts)), defaultdict(set)
    hashes = words.hashes()
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        assert [words.raw[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.stops[a:b])] == WORD.findall(text)
        for word, h in zip(WORD.findall(text), hashes[a:b].tolist()):
            by_word[word].add(h)
    assert all(len(v) == 1 for v in by_word.values())
    assert len(set.union(*by_word.values())) == len(by_word)


def thue_morse(n, a="a", b="b"):
    """A sequence and its complement: polynomials modulo a power of two do not tell them apart from 1,024 symbols on."""
    symbols = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in symbols], [(b, a)[x] for x in symbols]


@pytest.mark.parametrize("size", [1024, 4096])
def test_no_hash_cancels(spark, size):
    one, other = thue_morse(size)
    words = Words(pa.array(["".join(one) + " " + "".join(other) + " " + " ".join(one) + " " + " ".join(other)]))
    for seed in (0, 1):
        assert words.hashes(seed)[0] != words.hashes(seed)[1]
        runs = words.runs(size, seed)[0]
        assert len(set(runs.tolist())) == len({tuple(x) for x in zip(*[(["x", "y"] + one + other)[i : i + len(runs)] for i in range(size)])})
    # The words themselves in windows, and windows of the sequences.
    filler = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*filler[:17], "".join(x), *filler[17:]])) for i, x in enumerate((one, other))]
    rows += [(10 + i, " ".join(x)) for i, x in enumerate((one, other))] + [(20, " ".join(f"{w}{i}" for i, w in enumerate(one)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (35, size):
        assert rows_of(repeats.digests(repeats.remove_repeats(docs, k)), *COLUMNS) == brute(rows, k)


@pytest.mark.parametrize("k, chunk_bytes", [(3, 300), (5, 1 << 20), (8, 300), (1, 500), (7, 1 << 20)])
def test_against_brute_force(spark, k, chunk_bytes):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(["a", "b", "c", " ", "  ", "\n"], k=rng.randint(0, 200)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (5, "a b c a b c a b c a b c"), (5, "a b c a b c a b c a b c"), (6, "zz " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.digests(repeats.remove_repeats(docs, k, chunk_bytes=chunk_bytes)), *COLUMNS) == brute(rows, k)


@pytest.mark.parametrize("k", [2, 35])
def test_awkward_rows(spark, k):
    docs = awkward(spark)
    assert rows_of(repeats.digests(repeats.remove_repeats(docs, k)), *COLUMNS) == brute(texts_of(docs), k)


def test_empty(spark):
    assert repeats.remove_repeats(nothing(spark)).collect() == []
