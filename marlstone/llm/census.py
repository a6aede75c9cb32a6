"""How often does each of very many hashes occur in the whole corpus?

Documents are dealt to chunks of a few megabytes by a hash of their id. A chunk
sends the distinct hashes of its documents to buckets, as one binary row for
each bucket instead of one row for each hash: 32 bits of a hash and, where it
is above one, its count in the chunk; the bucket stands for the leading bits.
A bucket counts over all chunks and answers each chunk with one byte per hash,
in the order in which the chunk sent them (that of the hashes). The byte is the
count up to 128 and grows with its logarithm beyond, to 4e11. The chunk,
computing its hashes again from the same documents, reads the answers off.

A hash that many documents hold reaches its bucket once per chunk, so a hot
value costs no more than the number of chunks. All parts are pure functions of
a chunk's documents, sorted, so a lost executor's part can be computed again.
Two hashes that differ only in bits not sent count as one: counts are upper
bounds, exact for all but a few in ten thousand; callers treat them as such.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import id_text, released

PAYLOAD = "bucket int, chunk int, hashes binary, many binary"
REPLY = "chunk int, bucket int, counts binary"
#: Bytes of text in a chunk: a task holds one chunk, and some thirty times its size in arrays.
CHUNK_BYTES = 2 << 20
#: Chunks to a bucket: rows between them are chunks * buckets, and a bucket holds a chunk's share of so many chunks.
CHUNKS_PER_BUCKET = 4


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of buckets; that of chunks comes from the bytes of all texts."""
    rows = id_text(docs, id_col, text_col)
    n = chunk_count(rows, "text", chunk_bytes)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return rows.select(chunk.alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), math.ceil(n / CHUNKS_PER_BUCKET)


def chunk_count(docs: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's documents in an order that depends on nothing but themselves."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found if isinstance(found, pa.Array) else found.chunk(0)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal ranges of hashes: ascending hashes have ascending buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


#: The least count of each byte: itself up to 128, then four steps to each doubling.
COUNTS = np.concatenate([np.arange(129), np.ceil(128 * 2 ** (np.arange(1, 128) / 4))]).astype(np.int64)[:256]


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that never fall when counts rise."""
    return (np.searchsorted(COUNTS, counts, side="right") - 1).astype(np.uint8)


def payload(chunk: int, distinct: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """What a chunk sends: ``distinct`` ascending, with its count in the chunk's documents."""
    at = np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1))
    low, many = distinct.astype("<u4"), coded(counts)
    rows = [(b, low[s:e].tobytes(), many[s:e].tobytes() if (many[s:e] > 1).any() else None) for b, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if e > s]
    b, h, m = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array(h, pa.binary()), "many": pa.array(m, pa.binary())})


def tally(table: pa.Table) -> pa.Table:
    """A bucket's answers: the counts over all chunks, as bytes."""
    hashes, many = column(table, "hashes").to_pylist(), column(table, "many").to_pylist()
    sizes = [len(h) // 4 for h in hashes]
    each = np.concatenate([np.frombuffer(m, np.uint8) if m else np.ones(n, np.uint8) for m, n in zip(many, sizes)])
    _, inverse = np.unique(np.frombuffer(b"".join(hashes), "<u4"), return_inverse=True)
    total = coded(np.bincount(inverse, weights=COUNTS[each]))[inverse]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return pa.table(
        {
            "chunk": column(table, "chunk"),
            "bucket": column(table, "bucket"),
            "counts": pa.array([total[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
        }
    )


def answers(replies: pa.Table, field: str = "counts") -> np.ndarray:
    """A chunk's answers in the order of its distinct hashes."""
    ordered = replies.sort_by("bucket")
    return np.frombuffer(b"".join(x.as_py() for x in ordered.column(field)), np.uint8)


def replies(docs: DataFrame, buckets: int, distinct: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The answers to all chunks. ``distinct`` gives a chunk's distinct hashes, ascending, and their counts."""

    def send(table: pa.Table) -> pa.Table:
        return released(payload(column(table, "chunk")[0].as_py(), *distinct(in_order(table)), buckets))

    sent = docs.groupBy("chunk").applyInArrow(send, PAYLOAD)
    return sent.groupBy("bucket").applyInArrow(lambda table: released(tally(table)), REPLY)
