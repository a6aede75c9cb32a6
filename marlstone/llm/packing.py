"""Operator 11: documents packed into as few sequences as possible, with a proof of how few they can be.

Texts become ids with an end id each; only a document longer than a sequence is
cut, into full pieces and a last shorter one. Full pieces are sequences of their
own. The others are dealt to partitions, each of which packs its pieces by best
fit, longest first, and bounds its own number of sequences from below by dual
feasible functions: functions of lengths under which whatever fits a sequence
still does, so that their sum says how many are needed.

A partition that needs as many as its bound is certified; nothing can pack its
pieces better. But bounds are rounded up partition by partition, so it gives back
the emptiest of its sequences; a partition with a gap gives back all. What came
back is dealt anew, among as few partitions as may hold it, and packed again.
A deal that saves nothing is not kept. Rounds end when the whole reaches the bound
of the whole, when one partition held all that came back, or after ``BARREN``
deals in a row that saved nothing.

A piece is a row of the written table (its ids beside it); what is packed is rows
of two numbers, and a partition holds ``POOL`` of them. The driver sees one
histogram of lengths and the sums of a round.

Cases: a null text counts as empty, its document is the end id alone; rows with
equal or null ids are documents of their own; an empty table gives no row; other
columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import by_bytes, id_text, released, stash, texts_of
from .token_files import words

#: Tokens of a sequence, pieces that a partition packs, and deals in a row that may save nothing.
LENGTH, POOL, BARREN = 2048, 500_000, 2
#: Largest k of the rounding functions.
STEPS = 24

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, one row each, with a number of their own in ``uid``: the task and the place in it, so
    write the rows before you use them twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, uid = words(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, most=5 << 20):
            ids, ends = model.encode(texts_of(batch), end_id)
            sizes = np.diff(ends)
            n = -(-sizes // length)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * length
            size = np.minimum(length, sizes[doc] - start)
            stops = np.concatenate([[0], np.cumsum(size)])
            raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(doc))),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids)),
                ],
                ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )
            uid += len(doc)
        released()

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, length: int) -> int:
    """The least number of sequences of ``length`` for ``counts[x]`` pieces of each length x (1 to ``length``): the best of
    dual feasible functions, in whole numbers. With e = 0 up to half a sequence, lengths above length - e count as a
    sequence and those under e as nothing; on these lengths, u_k rounds (k + 1) x / length down, in k-ths, but leaves
    whole multiples as they are."""
    x = np.arange(length + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    if not counts.any():
        return 0
    # Without rounding, for every e: sums over the lengths from e to length - e, and counts above.
    many, size = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(length // 2 + 1)
    top = length - e
    best = int((-(-((many[-1] - many[top + 1]) * length + size[top + 1] - size[e]) // length)).max())
    for k in range(1, STEPS + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % length == 0, k * x, scaled // length * length)  # in parts of k * length
        worth = np.concatenate([[0], np.cumsum(counts * value)])
        total = (many[-1] - many[top + 1]) * (k * length) + worth[top + 1] - worth[e]
        best = max(best, int((-(-total // (k * length))).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the room left in each bin. Longest first, each goes where it leaves the least room;
    of bins with equal room to the one that came to it last."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    some, room = 0, []  # bit r of ``some``: there is a bin with room r
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = some >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            own = by_room[r].pop()
            if not by_room[r]:
                some ^= 1 << r
        else:
            r, own = length, len(room)
            room.append(length)
        bins[i], offsets[i] = own, length - r
        room[own] = r = r - size
        if r:
            by_room[r].append(own)
            some |= 1 << r
    return bins, offsets, np.array(room, np.int64)


PACKED = "uid long, length long, pool long, bin long, offset long, bins long, bound long, back boolean, back_bins long"


def _pack(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes = table.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(sizes, length)
        bound = lower_bound(np.bincount(sizes, minlength=length + 1), length)
        if len(room) > bound:
            back, back_bins = np.ones(len(sizes), bool), len(room)
        else:
            back, back_bins = bins == room.argmax(), 1
        same = lambda v: pa.array(np.full(len(sizes), v, np.int64))
        columns = [table.column("uid"), table.column("length"), table.column("pool"), pa.array(bins), pa.array(offsets), same(len(room)), same(bound), pa.array(back), same(back_bins)]
        return pa.table(columns, names=["uid", "length", "pool", "bin", "offset", "bins", "bound", "back", "back_bins"])

    return run


def _dealt(items: DataFrame, deal: int, pool: int, length: int) -> DataFrame:
    """The pieces (uid, length) packed in partitions of about ``pool``; the number of the deal tells its pools apart."""
    n = items.count()
    pools = max(1, math.ceil(n / pool))
    key = F.pmod(F.xxhash64(F.lit(deal), "uid"), F.lit(pools)) + F.lit(deal << 32)
    return stash(items.select("uid", "length", key.alias("pool")).groupBy("pool").applyInArrow(lambda table: released(_pack(length)(table)), PACKED), "packing")


def _sums(packed: DataFrame) -> tuple[int, int, int]:
    """Sequences of a deal, sequences that come back, and pools."""
    pools = packed.groupBy("pool").agg(F.first("bins").alias("bins"), F.first("back_bins").alias("back_bins"))
    bins, back, n = pools.agg(F.sum("bins"), F.sum("back_bins"), F.count(F.lit(1))).first()
    return bins or 0, back or 0, n


def assigned(items: DataFrame, length: int = LENGTH, pool: int = POOL) -> tuple[DataFrame, int, int]:
    """(uid, pool, bin, offset) of each piece of (uid, length), all shorter than ``length``; how many bins there are; and how
    many there must be."""
    counts = np.zeros(length + 1, np.int64)
    for x, n in items.groupBy("length").count().collect():  # one row for each length
        counts[x] = n
    least = lower_bound(counts, length)
    place = ["uid", "pool", "bin", "offset"]
    packed = _dealt(items, 0, pool, length)
    total, back_bins, pools = _sums(packed)
    back, kept, deal, barren = packed.filter("back"), packed.filter("NOT back").select(*place), 0, 0
    while total > least and pools > 1 and barren < BARREN:
        deal += 1
        packed = _dealt(back.select("uid", "length"), deal, pool, length)
        bins, again, n = _sums(packed)
        if bins < back_bins:
            total, barren = total - back_bins + bins, 0
            kept = kept.unionByName(packed.filter("NOT back").select(*place))
            back, back_bins, pools = packed.filter("back"), again, n
        else:
            barren += 1
            if n == 1:  # one partition held them all: no other deal would differ
                break
    return kept.unionByName(back.select(*place)), total, least


class Packed:
    """Packed documents: ``rows`` has each piece with its place (doc_id, piece, start, length, ids_crc32, ids, sequence_id,
    offset), ``sequences`` their number, and ``bound`` the number below which no packing goes."""

    def __init__(self, rows: DataFrame, sequences: int, bound: int):
        self.rows, self.sequences, self.bound = rows, sequences, bound

    def filled(self) -> DataFrame:
        """(sequence_id, ids, docs): the ids of each sequence, and the documents in it with their places."""
        part = F.struct("offset", "length", "doc_id", "piece", "ids").alias("part")
        found = self.rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        spans = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length")))
        return found.select("sequence_id", F.flatten("parts.ids").alias("ids"), spans.alias("docs"))


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", pool: int = POOL
) -> Packed:
    """All documents in sequences of at most ``length`` tokens. A full piece's sequence has a negative number, made of its
    ``uid``; another's is made of its partition and its place there."""
    cut = stash(pieces(docs, tokenizer_path, end_id, length, id_col, text_col), "pieces")
    open_ = cut.filter(F.col("length") < length).select("uid", "length")
    found, bins, bound = assigned(open_, length, pool)
    full = cut.filter(F.col("length") == length)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    placed = cut.join(found, "uid").select(*columns, (F.col("pool") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset")
    alone = full.select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = full.count()
    return Packed(placed.unionByName(alone), bins + whole, bound + whole)
