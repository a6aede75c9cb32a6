import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marlstone.llm import packing, queries

from .helpers import awkward, nothing

FILE = "word_bpe_49k.json"


def naive_best_fit(sizes, length):
    bins = []
    for s in sorted(sizes, reverse=True):
        fitting = [b for b in bins if b + s <= length]
        if fitting:
            bins[bins.index(max(fitting))] += s
        else:
            bins.append(s)
    return len(bins)


def fewest(sizes, length):
    """The true number of bins of a few pieces, by trying all."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {*bins}:
            if b + sizes[i] <= length:
                at = bins.index(b)
                place(i + 1, bins[:at] + [b + sizes[i]] + bins[at + 1 :])
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("length", [10, 13, 24])
def test_bound_and_best_fit_around_the_true_number(length):
    rng, tight = random.Random(length), 0
    for _ in range(120):
        sizes = [rng.randrange(1, length + 1) for _ in range(rng.randrange(0, 9))]
        bound = packing.lower_bound(np.bincount(np.array(sizes, int), minlength=length + 1), length)
        bins, offsets, room = packing.best_fit_decreasing(np.array(sizes, np.int64), length)
        assert bound <= fewest(sizes, length) <= len(room) == naive_best_fit(sizes, length)
        used = defaultdict(list)
        for s, b, o in zip(sizes, bins.tolist(), offsets.tolist()):
            used[b].append((o, s))
        for b, parts in used.items():
            ends = np.cumsum([s for _, s in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] == length - room[b]
        tight += bound == fewest(sizes, length)
    assert tight > 110


def test_bound_is_more_than_the_volume():
    counts = np.zeros(11, np.int64)
    counts[[6, 4, 3]] = 5, 0, 4  # each 6 needs a bin, and a 3 fits beside it
    assert packing.lower_bound(counts, 10) == 5
    counts[:] = 0
    counts[4] = 7  # two of 4 to a bin of 10
    assert packing.lower_bound(counts, 10) == 4


def test_partitions_exchange_until_certified(spark):
    rng = random.Random(3)
    rows = [(i, min(2047, int(rng.paretovariate(1.1) * 40))) for i in range(3_000)]
    items = spark.createDataFrame(rows, "uid long, length long").repartition(4)
    found, bins, least = packing.assigned(items, pool=100)
    got = found.collect()
    assert len(got) == len({r.uid for r in got}) == len(rows)
    sizes, fill = dict(rows), defaultdict(list)
    for r in got:
        fill[r.pool, r.bin].append((r.offset, sizes[r.uid]))
    assert len(fill) == bins
    for parts in fill.values():
        ends = np.cumsum([s for _, s in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    alone = naive_best_fit([s for _, s in rows], 2048)
    first = packing._sums(packing._dealt(items, 0, 100, 2048))[0]
    assert least <= alone <= bins <= alone + 1 < first  # 30 partitions lose some; the exchange wins them back


def checked(spark, docs, packed, length=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file(FILE))
    rows = packed.rows.collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    expected = sorted((repr(d), p // length, p, x[p : p + length]) for d, texts in ids.items() for x in texts for p in range(0, len(x), length))
    assert sorted((repr(r.doc_id), r.piece, r.start, list(r.ids)) for r in rows) == expected
    fill = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        ends = np.cumsum([s for _, s in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= length
    assert len(fill) == packed.sequences >= packed.bound
    for r in packed.filled().collect():
        for d in r.docs:
            assert any(list(r.ids[d.offset : d.offset + d.length]) == x[d.piece * length : d.piece * length + d.length] for x in ids[d.doc_id])
    assert packed.filled().count() == packed.sequences
    return fill


@pytest.mark.parametrize("length", [7, 2048])
def test_awkward_documents(spark, length):
    docs = awkward(spark).filter("doc_id IS NULL OR doc_id <> 20") if length == 7 else awkward(spark)
    checked(spark, docs, packing.pack_documents(docs, queries.tokenizer_file(FILE), end_id=0, length=length), length)


def test_equal_rows(spark):
    docs = spark.range(5_000).selectExpr("id % 2 AS doc_id", "'one and the same text' AS text")
    packed = packing.pack_documents(docs, queries.tokenizer_file(FILE), end_id=0, pool=2_000)
    assert packed.rows.groupBy("sequence_id").agg({"length": "sum"}).selectExpr("max(`sum(length)`) <= 2048 AS ok").first().ok
    assert packed.sequences - packed.bound <= 1 and packed.rows.count() == 5_000


def test_empty(spark):
    packed = packing.pack_documents(nothing(spark), queries.tokenizer_file(FILE), end_id=0)
    assert packed.rows.collect() == [] and packed.sequences == packed.bound == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.QUERIES["op11_packing"](spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = queries.table(spark, sf, "documents")
    packed = packing.pack_documents(docs, queries.tokenizer_file(FILE), end_id=0)
    checked(spark, docs, packed)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(columns).collect())) == sorted(map(tuple, packed.rows.select(columns).collect()))
    assert rows.select("sequence_id").distinct().count() == packed.sequences
