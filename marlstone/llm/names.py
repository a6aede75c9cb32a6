"""Operator 13: names within a few edits of each other, by positional q-grams.

Distance is optimal string alignment: insertions, deletions and substitutions of
one code point and exchanges of two neighbours, no substring edited twice. One
edit touches at most q + 1 of a name's q-grams (an exchange does; the others touch
q), so of names within k edits all grams but t = k (q + 1) stand in both, shifted
by what was inserted and deleted before them. Grams are put in one order for both
tables, rare ones first. If a name has more than t grams, the first t + 1 of it
and those of its partner share one: the least gram that stays is in both prefixes,
as grams that stay keep their sequence.

The inverted index is a join of prefixes on gram, position and length, one side
with each shift d and difference D of lengths that |d| + |D - d| <= k allows. The
join itself drops pairs by counts that fit in words: an edit flips at most two bits
of the parities of code points and six of those of digrams; and by the distance
without exchanges, of which one counts two but flips no parity. What is left, once
for each pair of different names, is measured in a band of 2 k + 1 diagonals.

Names of t grams or fewer may share none: two such names meet in the buckets of
their lengths, within a bucket by what k deletions leave of them, which is equal
for some choice of deletions if they are within k edits. So no bucket is compared
pair by pair.

Equal names are one from the start, so a name that a third of all rows has is a
count. The order comes from a histogram of ``BUCKETS`` hashed grams, whatever the
input's size; nothing else goes to the driver or to all tasks. A collision there
or in a join key costs a comparison and loses nothing.

Cases: null and empty names take no part; a name may be of any length (long ones
are measured alone); repeated rows of a table count as often as they stand there
on the left, and once on the right; null ids count as rows but are neither first
nor in a sum of checksums; empty tables give no pair; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .shared import released, stash
from .wordhash import mix

#: Code points of a gram, edits, and buckets of the histogram of grams.
GRAM, EDITS, BUCKETS = 3, 2, 1 << 16
#: Cells of a batch's matrix of code points.
CELLS = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def folded(name: Column | str) -> Column:
    """The name with A-Z, and no other letter, in lower case."""
    return F.translate(F.col(name) if isinstance(name, str) else name, _UPPER, _LOWER)


def misspelt(name: str, identifier: str) -> Column:
    """The name with two neighbours exchanged at a place that the identifier's checksum h gives; unchanged if h is odd, the
    identifier is null, or the name has less than two code points."""
    n, h = F.length(name), F.crc32(F.col(identifier).cast("string").cast("binary"))
    at = (h % F.greatest(n - 1, F.lit(1))).cast("int")
    cut = lambda start, size: F.substring(F.col(name), start, size)
    swapped = F.concat(cut(F.lit(1), at), cut(at + 2, F.lit(1)), cut(at + 1, F.lit(1)), cut(at + 3, n))
    return F.when((n >= 2) & (h % 2 == 0), swapped).otherwise(F.col(name))


class Codes:
    """The code points of a batch of names, one after another."""

    def __init__(self, names: list[str]):
        self.names = names
        self.points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
        self.sizes = np.fromiter(map(len, names), np.int64, len(names))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, place, hash) of each gram of ``q`` code points."""
        n = np.maximum(self.sizes - q + 1, 0)
        name = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(name)) - np.repeat(np.cumsum(n) - n, n)
        at = self.first[name] + place
        h = np.full(len(name), q, np.uint64)
        for i in range(q):
            h = mix(h * _ODD[0] + self.points[at + i])
        return name, place, h

    def parities(self, name: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For each name 64 parities of how often its hashes fall on each bit."""
        odd = np.bincount(name * 64 + (h >> np.uint64(58)).astype(np.int64), minlength=64 * len(self.sizes)) & 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1).view("<i8").ravel()


def _histogram(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            _, _, h = Codes(batch.column("name").to_pylist()).grams(q)
            total += np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def _order(q: int, *tables: DataFrame) -> np.ndarray:
    """How frequent the grams of each bucket are among the different names of all tables: a fixed number of buckets."""
    each = [t.select("name").mapInArrow(_histogram(q), "bucket long, n long") for t in tables]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    found = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return np.unique(found, return_inverse=True)[1].astype(np.int32)


def shifts(edits: int) -> list[tuple[int, int]]:
    """(d, D): shifts of a gram that stays, and differences of lengths, between names within ``edits``."""
    span = range(-edits, edits + 1)
    return [(d, more) for more in span for d in span if abs(d) + abs(more - d) <= edits]


def _left_over(name: str, edits: int) -> set[str]:
    """What the name can be after at most ``edits`` deletions."""
    n = len(name)
    return {"".join(name[i] for i in range(n) if i not in gone) for k in range(min(edits, n) + 1) for gone in map(set, combinations(range(n), k))}


def _postings(order: np.ndarray, q: int, edits: int, many: bool):
    """(key, points, digrams, name) of each name's prefix; with ``many`` a row for every shift. Names too short for it also
    have rows for the buckets of their lengths."""
    most = edits * (q + 1)
    moves = shifts(edits) if many else [(0, 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                names = whole.column("name").slice(at, 5000).to_pylist()
                codes = Codes(names)
                name, place, h = codes.grams(q)
                by = np.lexsort((place, h, order[(h >> np.uint64(48)).astype(np.int64)], name))
                name, place, h = name[by], place[by], h[by]
                first = np.searchsorted(name, np.arange(len(names)))
                kept = np.arange(len(name)) - first[name] <= most
                name, place, h = name[kept], place[kept], h[kept]
                rows, keys = [], []
                for d, more in moves:
                    rows.append(name)
                    keys.append(mix(h + (place + d).astype(np.uint64) * _ODD[1] + (codes.sizes[name] + more).astype(np.uint64) * _ODD[2]))
                short = [
                    (i, xxhash.xxh64_intdigest(f"{len(names[i]) + more} {rest}".encode("utf-8", "surrogatepass")))
                    for i in np.flatnonzero(codes.sizes - q + 1 <= most).tolist()
                    for rest in _left_over(names[i], edits)
                    for more in (range(-edits, edits + 1) if many else (0,))
                ]
                rows.append(np.array([i for i, _ in short], np.int64))
                keys.append(np.array([k for _, k in short], np.uint64))
                row = np.concatenate(rows)
                points = codes.parities(np.repeat(np.arange(len(names)), codes.sizes), mix(codes.points.astype(np.uint64) * _ODD[0]))
                twos, _, pair = codes.grams(2)
                columns = [np.concatenate(keys).view(np.int64), points[row], codes.parities(twos, pair)[row]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(names, pa.string()).take(pa.array(row))], ["key", "points", "digrams", "name"])
        released()

    return run


POSTING = "key long, points long, digrams long, name string"


def _distances(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Distances of these pairs, anything above ``edits`` standing for all that is."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    matrix, most = [], int(max(la.max(initial=0), lb.max(initial=0)))
    for names, sizes, pad in ((a, la, -1), (b, lb, -2)):
        codes = Codes(names)
        cells = np.full((most + edits + 1, len(names)), pad, np.int64)  # places in rows: a step reads one row
        row = np.repeat(np.arange(len(names)), sizes)
        cells[np.arange(len(row)) - codes.first[row], row] = codes.points
        matrix.append(cells)
    x, y = matrix
    far = edits + 1
    width = 2 * edits + 1
    start = np.full((width, len(a)), far, np.int64)
    for o in range(edits, width):
        start[o] = o - edits
    two, one = np.full_like(start, far), start
    out = np.where(np.abs(la - lb) <= edits, far, far + 1)
    inside = np.flatnonzero(np.abs(la - lb) <= edits)
    for i in range(int(la.max(initial=0)) + 1):
        if i:
            now = np.full_like(start, far)
            for o in range(width):
                j = i + o - edits
                if j < 0:
                    continue
                if j == 0:
                    now[o] = i
                    continue
                best = one[o] + (x[i - 1] != y[j - 1])
                if o + 1 < width:
                    np.minimum(best, one[o + 1] + 1, out=best)
                if o:
                    np.minimum(best, now[o - 1] + 1, out=best)
                if i > 1 and j > 1:
                    crossed = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                    np.minimum(best, np.where(crossed, two[o] + 1, far), out=best)
                now[o] = best
            two, one = one, now
        done = inside[la[inside] == i]
        out[done] = np.minimum(one[lb[done] - i + edits, done], far)
    return np.minimum(out, far)


def _measured(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Pairs of like lengths together, a long one alone.
            sizes = np.maximum(*(np.array([len(x) for x in whole.column(c).to_pylist()], np.int64) for c in ("a", "b"))) if whole.num_rows else np.zeros(0, np.int64)
            by = np.argsort(sizes, kind="stable")
            done = 0
            while done < len(by):
                n = 1
                while done + n < len(by) and (n + 1) * (sizes[by[done + n]] + edits + 1) <= CELLS and n < 20_000:
                    n += 1
                part = whole.take(pa.array(by[done : done + n]))
                found = _distances(part.column("a").to_pylist(), part.column("b").to_pylist(), edits)
                near = np.flatnonzero(found <= edits)
                chosen = part.take(pa.array(near))
                yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b"), pa.array(found[near].astype(np.int32))], ["a", "b", "distance"])
                done += n

    return run


def edit_join(left: DataFrame, right: DataFrame, edits: int = EDITS, q: int = GRAM) -> DataFrame:
    """(a, b, distance): each pair of names within ``edits``, once, of two tables of different names (``name``, neither
    null nor empty). Both tables are read several times: write them before."""
    order = _order(q, left, right)
    a, b = (t.select("name").mapInArrow(_postings(order, q, edits, many), POSTING).alias(s) for t, s, many in ((left, "a", False), (right, "b", True)))
    flips = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    met = (F.col("a.key") == F.col("b.key")) & (flips("points") <= 2 * edits) & (flips("digrams") <= 6 * edits)
    # Without exchanges an exchange is two edits, and it alone flips no parity of code points: so the more flips, the fewer it can be.
    apart = F.levenshtein(F.col("a.name"), F.col("b.name"), 2 * edits)
    met = met & (apart >= 0) & (2 * apart + flips("points") <= 4 * edits)
    pairs = a.hint("merge").join(b, met).select(F.col("a.name").alias("a"), F.col("b.name").alias("b")).distinct()
    return pairs.mapInArrow(_measured(edits), "a string, b string, distance int")


def near_names(left: DataFrame, right: DataFrame, edits: int = EDITS, q: int = GRAM) -> DataFrame:
    """For each ``id`` of the right table and exact distance of at most ``edits``: id, distance, and of the left table's rows at
    that distance n (rows), first_id (the smallest id) and crc (the sum of the unsigned checksums of their decimal ids).

    Both tables: ``id`` long and ``name``. An id of the right table with several names has the pairs of each."""
    named = lambda t: t.select(F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name")).filter("name <> ''")
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    sums = [F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.coalesce(F.sum(crc), F.lit(0)).alias("crc")]
    mine = stash(named(left).groupBy("name").agg(*sums), "names-left")
    theirs = stash(named(right).distinct(), "names-right")
    other = stash(theirs.select("name").distinct(), "names-right-once")
    pairs = edit_join(mine, other, edits, q)
    # At most one row for each distance of a name, so a name of very many rows meets few.
    sums = [F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.sum("crc").alias("crc")]
    found = pairs.join(mine.withColumnRenamed("name", "a").hint("merge"), "a").groupBy("b", "distance").agg(*sums)
    return theirs.withColumnRenamed("name", "b").join(found.hint("merge"), "b").groupBy("id", "distance").agg(*sums)
