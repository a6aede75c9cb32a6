"""Operator 4: an exact Jaccard join of word-shingle sets by vertical partitioning.

Documents link when 100 * |intersection| >= percent * |union| of their sets of
hashed n-word shingles; the result has each document's connected component.

A census counts the holders of every shingle. The global order of shingles is by
that count, then by hash; it is cut into fragments that hold about equal numbers
of occurrences, at pivots read off a histogram of the counts. Every set is cut at
the pivots. A fragment's part of a group of sets is a task of its own that counts
the partial overlaps of its pairs; partial overlaps meet by group, are summed for
each pair, and decide the links. Pairs travel in bulk, not as a row each.

Which sets meet in a group: in the global order a set that can link at all shares
one of its first |x| - ceil(t |x|) + 1 shingles with its partner, and shingles of
one holder can be left out, so that most documents of a corpus meet nobody. The
sets that are connected by such shingles are a family. A small family is one
group. In a large one sets go to bands of length, since only neighbouring bands
can link, and to blocks. First each block is a group, together with a few leaders
of its band and of the band before, which already connects near-copies however
many they are, for a cost in proportion to their number. Then what is not yet
connected is compared, by pairs of blocks of which one holds sets outside the
component that most are in: among all sets of the family, or among those that
meet at one shingle, whichever moves fewer shingles.

A group holds two blocks at most and returns what its links connect, as pairs of
a set and one set that its links reach: at most one fewer than it has sets.
Documents of one set are one node from the start. Shingles are 64-bit hashes under
a number that is drawn for each run and known to nobody, so that no words can be
made to collide, and sets are told apart by 128 bits of them: two documents could
only be taken for more alike than they are if two of their own shingles collided,
by chance, once in 2^64.

Cases: a null or wordless text has the empty set, n_shingles 0 and is its own
component; with fewer words than n the whole sequence is the one shingle; rows
with equal ids are one node if they have one set, else each links for itself
under that id; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import census
from .census import column, in_order
from .components import components
from .shared import released, stash
from .wordhash import Words, mix

#: Sets of a block, and shingles of its sets; a group, so also a small family, holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 400, 1 << 20
#: Fragments of the global order.
FRAGMENTS = 4
#: Leaders of a band.
LEADERS = 8
#: Sets, and shingles of them, in the groups that one call takes together.
CALL_SETS, CALL_SHINGLES = 100, 1 << 17


class Sets:
    """The shingle sets of a chunk's documents: sorted distinct hashes, one after another."""

    def __init__(self, table: pa.Table, n: int, secret: int):
        self.table = in_order(table)
        words = Words(column(self.table, "text"), lower=True, secret=secret)
        hashes, offsets = words.runs(n)
        sizes = np.diff(words.first)
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            # The whole sequence of a shorter text, marked by its length.
            w = words.hashes()
            extra = np.zeros(len(short), np.uint64)
            for i, d in enumerate(short.tolist()):
                x = np.full(1, sizes[d], np.uint64)
                for j in range(words.first[d], words.first[d + 1]):
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w[j : j + 1])
                extra[i] = x[0]
            hashes = np.insert(hashes, offsets[short], extra)
            offsets = offsets + np.concatenate([[0], np.cumsum((sizes > 0) & (sizes < n))])
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        # Sorted by document and hash: the hashes of each document in ascending order, then repeats removed.
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = hashes[new], doc[new]
        self.offsets = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.sizes = np.diff(self.offsets)
        raw = memoryview(np.ascontiguousarray(self.hashes.astype("<u8")).view(np.uint8))
        self.raw = [raw[8 * a : 8 * b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]
        digests = [xxhash.xxh128_intdigest(x) for x in self.raw]
        self.high = np.array([d >> 64 for d in digests], np.uint64).view(np.int64)
        self.low = np.array([d & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64)

    def one_each(self) -> np.ndarray:
        """One document of each set in the chunk, by its place."""
        seen: dict[tuple[int, int], int] = {}
        for i, key in enumerate(zip(self.high.tolist(), self.low.tolist())):
            seen.setdefault(key, i)
        return np.fromiter(seen.values(), np.int64, len(seen))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes over one document of each set, with their counts."""
        self.chosen = self.one_each()
        mine = np.zeros(len(self.sizes), bool)
        mine[self.chosen] = True
        at = np.repeat(mine, self.sizes)
        distinct, inverse, counts = np.unique(self.hashes[at], return_inverse=True, return_counts=True)
        self.where = np.full(len(self.hashes), -1, np.int64)
        self.where[at] = inverse
        return distinct, counts


def _required(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any set that links to it: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


ROWS = "kind int, doc_id long, n long, high long, low long, shingle long, fragment int, members binary"
DOC, MEETS, SEGMENT = 0, 1, 2


def place(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the global order: by the census's byte, then by hash (less its last bits)."""
    return codes.astype(np.uint64) << np.uint64(56) | hashes >> np.uint64(8)


def _pivots(counted: DataFrame, fragments: int) -> np.ndarray:
    """Where fragments of the order begin, so that they hold about equal numbers of occurrences of shared shingles."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.bincount(np.frombuffer(counts.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["code", "n"])

    each = np.zeros(256)
    rows = counted.select("counts").mapInArrow(histogram, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for code, n in rows.collect():  # one row for each byte
        each[code] = n
    each[:2] = 0
    ends = np.cumsum(each)
    goals = ends[-1] * np.arange(1, fragments) / fragments
    code = np.minimum(np.searchsorted(ends, goals), 255)
    part = (goals - ends[code] + each[code]) / np.maximum(each[code], 1)  # hashes of one count are spread evenly
    return (code.astype(np.uint64) << np.uint64(56)) + (np.clip(part, 0, 1 - 1e-9) * 2.0**56).astype(np.uint64)


def _select(left: pa.Table, right: pa.Table, n: int, secret: int, percent: int, pivots: np.ndarray) -> pa.Table:
    """Of a chunk: all documents; the shingles by which one of each set can meet others; and the segments of these sets."""
    sets = Sets(left, n, secret)
    sets.distinct()
    frequency = census.answers(right)
    meets: list[tuple[int, np.ndarray]] = []
    segments: list[bytes] = []
    for i in sets.chosen.tolist():
        a, b = int(sets.offsets[i]), int(sets.offsets[i + 1])
        first = b - a - _required(b - a, percent) + 1
        f = frequency[sets.where[a:b]]
        shared = np.flatnonzero(f > 1)
        alone = (b - a) - len(shared)
        if b > a and alone < first:
            order = shared[np.argsort(f[shared], kind="stable")]  # hashes ascend already
            hashes = sets.hashes[a + order]
            meets.append((i, hashes[: first - alone].view(np.int64)))
            cuts = np.searchsorted(place(f[order], hashes), pivots)
            segments += [x.astype("<u8").tobytes() for x in np.split(hashes, cuts)]
    at, parts = np.array([i for i, _ in meets], np.int64), len(pivots) + 1
    each = np.repeat(at, [len(x) for _, x in meets]) if meets else at
    kinds = [(DOC, np.arange(len(sets.sizes))), (MEETS, each), (SEGMENT, np.repeat(at, parts))]
    rows = np.concatenate([x for _, x in kinds])
    sizes = [len(x) for _, x in kinds]
    shingles = np.concatenate([x for _, x in meets]) if meets else np.zeros(0, np.int64)
    return pa.table(
        {
            "kind": pa.array(np.repeat([k for k, _ in kinds], sizes), pa.int32()),
            "doc_id": column(sets.table, "doc_id").take(pa.array(rows)),
            "n": pa.array(sets.sizes[rows].astype(np.int64)),
            "high": pa.array(sets.high[rows]),
            "low": pa.array(sets.low[rows]),
            "shingle": pa.array(np.concatenate([np.zeros(sizes[0], np.int64), shingles, np.zeros(sizes[2], np.int64)])),
            "fragment": pa.array(np.concatenate([np.zeros(sizes[0] + sizes[1], np.int32), np.tile(np.arange(parts, dtype=np.int32), len(at))])),
            "members": pa.concat_arrays([pa.nulls(sizes[0] + sizes[1], pa.binary()), pa.array(segments, pa.binary())]),
        }
    )


def _families(meets: DataFrame) -> DataFrame:
    """(node, label) over one edge for each document and shingle: to the least document that meets there, a minimum that is
    taken before rows move. ``node`` is half of a set's digest: a collision joins two families, which costs work and
    changes no result."""
    rows = stash(meets.select("shingle", F.col("high").alias("node")).distinct(), "jaccard-nodes")
    least = rows.groupBy("shingle").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    edges = rows.join(least, "shingle").filter("node <> least").select("node", "least").distinct()
    return components(edges, "node", "least")


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


#: A group of sets as its fragments see it: the sets (the same in each), and the pairs with their partial overlaps.
PARTIAL = "call long, unit long, fragment int, highs binary, lows binary, sizes binary, pairs binary, overlaps binary"


def partial_overlaps(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x * m + y, x < y) of m segments that hold a shingle in common, and how many. Sets of lengths that cannot
    link are left out, and with two sides the pairs within a side."""
    m = len(sets)
    doc = np.repeat(np.arange(m), [len(s) for s in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    number, doc = number[shared], doc[shared]
    by_number = np.argsort(number, kind="stable")
    holders, firsts = doc[by_number], np.searchsorted(number[by_number], np.arange(len(counts) + 1))
    lists = np.split(number, np.searchsorted(doc, np.arange(1, m)))
    pairs, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    two = bool((sides != sides[0]).any())
    for x, mine in enumerate(lists):
        if len(mine):
            lengths = firsts[mine + 1] - firsts[mine]
            at = np.repeat(firsts[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            overlap = np.bincount(holders[at], minlength=m)[x + 1 :]
            near = (overlap > 0) & (100 * np.minimum(sizes[x], sizes[x + 1 :]) >= percent * np.maximum(sizes[x], sizes[x + 1 :]))
            if two:
                near &= sides[x + 1 :] != sides[x]
            found = np.flatnonzero(near)
            pairs.append(x * m + x + 1 + found)
            overlaps.append(overlap[found])
    return np.concatenate(pairs), np.concatenate(overlaps)


def _groups(units: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(units)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(units)])


def _count(table: pa.Table, percent: int) -> pa.Table:
    """The partial overlaps of the groups of one call in one fragment."""
    table = table.sort_by([("unit", "ascending"), ("side", "ascending"), ("high", "ascending"), ("low", "ascending")]).combine_chunks()
    units, sides, high, low, sizes = (column(table, c).to_numpy() for c in ("unit", "side", "high", "low", "n"))
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in column(table, "members")]
    call, fragment = (column(table, c)[0].as_py() for c in ("call", "fragment"))
    rows = []
    for a, b in _groups(units):
        pairs, overlaps = partial_overlaps(sets[a:b], sizes[a:b], sides[a:b], percent)
        named = [x[a:b].tobytes() if not fragment else b"" for x in (high, low, sizes)]
        rows.append((int(units[a]), *named, pairs.astype("<u4").tobytes(), overlaps.astype("<u4").tobytes()))
    unit, *parts = zip(*rows)
    names = ("highs", "lows", "sizes", "pairs", "overlaps")
    same = lambda value, kind: pa.array(np.full(len(rows), value, kind))
    return pa.table({"call": same(call, np.int64), "unit": pa.array(unit, pa.int64()), "fragment": same(fragment, np.int32), **{k: pa.array(v, pa.binary()) for k, v in zip(names, parts)}})


LINK = ["high_a", "low_a", "high_b", "low_b"]


def _sum(table: pa.Table, percent: int) -> pa.Table:
    """The sums over fragments of each pair's partial overlaps, and what the links of each group connect: each set with one
    set of its component in the group, so that paths stay short however long the chains of links are."""
    table = table.sort_by([("unit", "ascending"), ("fragment", "ascending")]).combine_chunks()
    out: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    value = lambda name, at, kind: np.frombuffer(table.column(name)[at].as_buffer(), kind)
    for a, b in _groups(column(table, "unit").to_numpy()):
        high, low, sizes = (value(c, a, "<i8") for c in ("highs", "lows", "sizes"))
        pairs = np.concatenate([value("pairs", i, "<u4") for i in range(a, b)]).astype(np.int64)
        overlaps = np.concatenate([value("overlaps", i, "<u4") for i in range(a, b)])
        pairs, at = np.unique(pairs, return_inverse=True)
        overlap = np.bincount(at, weights=overlaps, minlength=len(pairs)).astype(np.int64)
        x, y = np.divmod(pairs, len(sizes))
        links = 100 * overlap >= percent * (sizes[x] + sizes[y] - overlap)
        forest = _Forest(len(sizes))
        for i, j in zip(x[links].tolist(), y[links].tolist()):
            forest.join(i, j)
        roots = np.array([forest.root(i) for i in range(len(sizes))], np.int64)
        i = np.flatnonzero(roots != np.arange(len(sizes)))
        out.append(np.stack([high[i], low[i], high[roots[i]], low[roots[i]]], axis=1))
    return pa.table(dict(zip(LINK, np.concatenate(out).T.copy())))


def _links(tasks: DataFrame, segments: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Links of groups: ``tasks`` has (unit, side, high, low, n), a row for each set of a group. Small groups share calls;
    with ``apart`` each has its own."""
    if apart:
        call = F.col("unit")
    else:
        rows, shingles = tasks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        call = F.pmod(F.xxhash64("unit"), F.lit(max(1, math.ceil(rows / CALL_SETS), math.ceil(shingles / CALL_SHINGLES))))
    cut = tasks.join(segments, ["high", "low"]).withColumn("call", call)
    counted = cut.groupBy("call", "fragment").applyInArrow(lambda table: released(_count(table, percent)), PARTIAL)
    return counted.groupBy("call").applyInArrow(lambda table: released(_sum(table, percent)), ", ".join(f"{c} long" for c in LINK))


def _blocks(block: int) -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")


def _own_block(blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64("high", "low"), F.col(blocks)).cast("int").alias("block")


SET = ["high", "low", "n"]


def _first_groups(sets: DataFrame, block: int) -> DataFrame:
    """Groups of large families: the blocks of a band of lengths, each with leaders of its band and the band before."""
    sizes = sets.groupBy("label", "band").agg(_blocks(block))
    unit = lambda: F.xxhash64("label", "band", "block").alias("unit")
    own = sets.join(sizes, ["label", "band"]).withColumn("block", _own_block())
    heads = sets.groupBy("label", "band", F.pmod(F.xxhash64("low", "high"), F.lit(LEADERS)).alias("salt")).agg(F.min(F.struct(*SET)).alias("set"))
    heads = heads.select("label", "band", "set.*")
    both = heads.withColumn("off", F.lit(0)).unionByName(heads.select("label", F.col("band") + 1, *SET, F.lit(1).alias("off")).toDF("label", "band", *SET, "off"))
    led = both.join(sizes, ["label", "band"]).withColumn("mine", _own_block()).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    led = led.filter("off = 1 OR block <> mine")
    return own.select(unit(), F.lit(0).alias("side"), *SET).unionByName(led.select(unit(), F.lit(0).alias("side"), *SET))


def _pairs_of_blocks(meets: DataFrame, block: int) -> DataFrame:
    """Groups at each ``at`` of (at, label, high, low, n, band, part): pairs of blocks, the first of sets outside the part
    in which most of its sets are. Places at which the same sets meet count once."""
    folded = [F.bit_xor(x).alias(x) for x in ("high", "low")]
    parts = meets.groupBy("at", "part").agg(F.count(F.lit(1)).alias("c"), *folded)
    places = parts.groupBy("at").agg(F.max(F.struct("c", "part")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("c").alias("c"), *folded)
    places = places.filter("parts > 1").groupBy("c", "high", "low").agg(F.min(F.struct("at", F.col("most.part").alias("main"))).alias("s")).select("s.*")
    sets = stash(meets.join(places, "at").withColumn("outside", F.col("part") != F.col("main")).drop("part", "main"), "jaccard-meets")
    key = ["at", "band", "outside"]
    sizes = sets.groupBy(*key).agg(_blocks(block))
    rows = sets.join(sizes, key).withColumn("block", _own_block())
    blocks = stash(sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"), "jaccard-blocks")
    one, two = (blocks.select("at", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "outside", "block")]) for s in "ab")
    near = (F.abs(F.col("band_a") - F.col("band_b")) <= 1) & (~F.col("outside_b") | (F.struct("band_a", "block_a") <= F.struct("band_b", "block_b")))
    pairs = one.filter("outside_a").join(two, "at").filter(near)
    pairs = pairs.withColumn("unit", F.xxhash64("at", "band_a", "block_a", "band_b", "outside_b", "block_b"))

    def side(s: str, number: int) -> DataFrame:
        here = pairs if s == "a" else pairs.filter(~F.col("outside_b") | (F.col("band_a") != F.col("band_b")) | (F.col("block_a") != F.col("block_b")))
        here = here.select("at", *[F.col(f"{c}_{s}").alias(c) for c in ("band", "outside", "block")], "unit")
        return rows.join(here, [*key, "block"]).select("label", "unit", F.lit(number).alias("side"), *SET)

    return stash(side("a", 0).unionByName(side("b", 1)), "jaccard-pairs")


def _second_groups(meets: DataFrame, block: int) -> DataFrame:
    """Groups of what is not yet connected in large families, from (shingle, label, high, low, n, band, part)."""
    ways = {
        "family": _pairs_of_blocks(meets.drop("shingle").distinct().withColumn("at", F.col("label")), block),
        "shingle": _pairs_of_blocks(meets.withColumnRenamed("shingle", "at"), block),
    }
    cost = None
    for way, rows in ways.items():
        own = rows.groupBy("label").agg(F.sum(F.col("n") + 16).alias(way))
        cost = own if cost is None else cost.join(own, "label", "full")
    cost = stash(cost.select("label", (F.coalesce("family", F.lit(0)) > F.coalesce("shingle", F.lit(0))).alias("by_shingle")), "jaccard-ways")
    chosen = [rows.join(cost.filter("by_shingle" if way == "shingle" else "NOT by_shingle").select("label"), "label", "left_semi") for way, rows in ways.items()]
    return chosen[0].unionByName(chosen[1]).drop("label")


def jaccard_components(
    docs: DataFrame,
    percent: int = 90,
    n: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = census.CHUNK_BYTES,
    block: int = BLOCK,
    fragments: int = FRAGMENTS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    assert 4 * block * block < 2**32, "pairs of two blocks are numbers of 32 bits"
    secret = secrets.randbits(64)
    dealt, buckets = census.chunked(docs, id_col, text_col, chunk_bytes)
    counted = stash(census.replies(dealt, buckets, lambda table: Sets(table, n, secret).distinct()), "jaccard-counts")
    pivots = _pivots(counted, fragments)
    found = stash(dealt.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(lambda left, right: released(_select(left, right, n, secret, percent, pivots)), ROWS), "jaccard")

    set_of = ["high", "low"]
    nodes = stash(found.filter(F.col("kind") == DOC).filter("n > 0").groupBy(*set_of).agg(F.min("doc_id").alias("node")), "nodes")
    meets, parts = found.filter(F.col("kind") == MEETS), found.filter(F.col("kind") == SEGMENT)
    families = _families(meets)
    segments = parts.groupBy(*set_of, "fragment").agg(F.first("members").alias("members"))
    sets = parts.filter("fragment = 0").groupBy(*set_of).agg(F.first("n").alias("n")).join(families.withColumnRenamed("node", "high"), "high")
    large = ((F.col("count") > 2 * block) | (F.col("shingles") > 2 * BLOCK_SHINGLES)).alias("large")
    sizes = sets.groupBy("label").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles")).filter("count > 1").select("label", large)
    # Sets that can link differ in length by a factor of 100 / percent, which is one band, at most.
    band = F.floor(F.log("n") / F.lit(max(math.log(100 / percent), 1e-9) * (1 + 1e-9))).alias("band")
    sets = stash(sets.join(sizes, "label").select(*SET, "label", "large", band), "jaccard-sets")
    links = _links(sets.filter("NOT large").select(F.col("label").alias("unit"), F.lit(0).alias("side"), *SET), segments, percent)
    many = sets.filter("large")
    if not many.isEmpty():
        first = stash(_links(stash(_first_groups(many, block), "jaccard-first"), segments, percent, apart=True), "jaccard-links")
        name = lambda s: F.concat(F.hex(f"high{s}"), F.lit(" "), F.hex(f"low{s}"))
        parts_of = components(first.select(name("_a").alias("a"), name("_b").alias("b"))).withColumnRenamed("label", "part")
        left = meets.select(*set_of, "shingle").join(many.select(*SET, "label", "band"), set_of).withColumn("node", name("")).join(parts_of, "node", "left")
        left = left.select("shingle", "label", *SET, "band", F.coalesce("part", "node").alias("part"))
        second = _links(stash(_second_groups(stash(left, "jaccard-left"), block), "jaccard-second"), segments, percent, apart=True)
        links = links.unionByName(first).unionByName(second)

    a, b = (nodes.select(F.col("high").alias(f"high_{s}"), F.col("low").alias(f"low_{s}"), F.col("node").alias(s)) for s in "ab")
    links = links.join(a, ["high_a", "low_a"]).join(b, ["high_b", "low_b"]).select("a", "b")
    reached = components(links)
    reached = stash(nodes.join(reached, "node", "left").select(*set_of, F.coalesce("label", "node").alias("component_id")), "reached")
    documents = found.filter(F.col("kind") == DOC).select("doc_id", F.col("n").alias("n_shingles"), *set_of)
    empty = documents.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return documents.filter("n_shingles > 0").join(reached, set_of).select("doc_id", "n_shingles", "component_id").unionByName(empty)
