"""Operator 2: near-duplicate lines, by a segment-partition edit join.

Lines (of at least ``min_chars`` characters, without white space at their ends)
are duplicates if at most ``TAU`` edits apart. A line is cut into TAU + 1
segments; a line within TAU edits has one of them unchanged, at a place that the
difference in length and the segment's number restrict to a few (at most twelve
substrings for TAU = 2 over the lengths l, l - 1 and l - 2). Equal lines are one
line from the start, told apart by 128 bits.

All keys (length, segment number, substring) of all lines go through an exchange
like that of `census`: 32 bits of a key, and for segments which line has it, in
bulk rows from chunk to bucket and back. Only lines with a key that another line
has go on, as rows; they join by the whole 64-bit key under a condition on length
and on a parity sketch of bigrams that no true pair fails. Candidate pairs are
distinct and are verified by a banded bit-parallel edit distance over their texts,
many pairs at a time.

A line goes if the same line stands earlier in the corpus, or if a line within
TAU edits of it first stands earlier, in the order of document id and line.
Shorter lines, down to ``equal_chars`` characters (default: every line that is not
blank), are compared for equality only.

Cases: a null text has no lines; blank lines, and lines under both bounds, stay and
are not compared; an empty text stays empty; rows with equal ids count
as one document, whose equal lines stay in each; lines of any length are taken;
an empty table gives none; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import census
from .census import column
from .shared import by_bytes, released, stash
from .wordhash import mix

TAU = 2
MIN_CHARS = 32
# Odd multipliers; one for the characters of a substring, two that set lengths and segment numbers apart.
_FACTOR, _LENGTH, _SEGMENT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Characters of the matrices of pairs that are verified in step.
MATRIX = 1 << 20
#: Sketch bits that TAU edits can flip: an edit takes up to two bigrams away and brings up to two.
FLIPS = 4 * TAU

#: (difference in length, segment, shift) of the substrings that a line probes, the shorter line's own places first.
PROBES = [
    (d, i, s)
    for d in range(TAU + 1)
    for i in range(TAU + 1)
    for s in range(-TAU, 2 * TAU + 1)
    if -i <= s <= i and -(TAU - i) <= s - d <= TAU - i
]


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the factor and of its inverse, modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        rows = [np.full(max(n, 1 << 16), f, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
        for row in rows:
            row[0] = 1
        _tables[:] = [np.cumprod(row, dtype=np.uint64) for row in rows]
    return _tables[0][:n], _tables[1][:n]


class Lines:
    """The distinct lines of a chunk that are compared, where they stand, and which of them are long enough to be near others."""

    def __init__(self, table: pa.Table, min_chars: int, equal_chars: int):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        least = min(min_chars, equal_chars)
        number: dict[str, int] = {}
        ordinal, line_no, line = [], [], []
        for d, text in enumerate(column(self.table, "text").to_pylist()):
            for n, raw in enumerate(text.split("\n")):
                bare = raw.strip()
                if len(bare) >= least:
                    ordinal.append(d)
                    line_no.append(n)
                    line.append(number.setdefault(bare, len(number)))
        self.ordinal, self.line_no, self.line = (np.array(x, np.int64) for x in (ordinal, line_no, line))
        self.texts = list(number)
        digests = [xxhash.xxh128_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.texts]
        self.high = np.array([d >> 64 for d in digests], np.uint64)
        self.low = np.array([d & (1 << 64) - 1 for d in digests], np.uint64)
        self.length = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.start = np.cumsum(self.length) - self.length
        self.long = np.flatnonzero(self.length >= min_chars)
        self.code = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        up, self.down = _powers(len(self.code) + 1)
        self.sums = np.zeros(len(self.code) + 1, np.uint64)
        np.cumsum((self.code + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def keys(self, less: int, segment: int, shift: int) -> np.ndarray:
        """For each long line the key of its substring that a line shorter by ``less`` may have as a segment (shifted)."""
        length, start = self.length[self.long], self.start[self.long]
        shorter = length - less
        a, b = shorter * segment // (TAU + 1), shorter * (segment + 1) // (TAU + 1)
        at = start + np.clip(a + shift, 0, length - (b - a))
        h = (self.sums[at + (b - a)] - self.sums[at]) * self.down[at]
        return mix(h + shorter.astype(np.uint64) * np.uint64(_LENGTH) + np.uint64((segment + 1) * _SEGMENT & (1 << 64) - 1))

    def index_keys(self) -> np.ndarray:
        return np.stack([self.keys(0, i, 0) for i in range(TAU + 1)]) if len(self.long) else np.zeros((TAU + 1, 0), np.uint64)

    def probe_keys(self) -> np.ndarray:
        """All probes but a line's own segments, which stand for themselves."""
        rest = [p for p in PROBES if p[0] or p[2]]
        return np.stack([self.keys(*p) for p in rest]) if len(self.long) else np.zeros((len(rest), 0), np.uint64)

    def sketches(self) -> np.ndarray:
        """64 parities of the numbers of bigrams by a hash of them."""
        n = len(self.texts)
        if not n:
            return np.zeros(0, np.uint64)
        pair = mix(self.code[:-1] * np.uint64(0x110000) + self.code[1:]) >> np.uint64(58)
        line = np.repeat(np.arange(n), self.length)
        inner = np.ones(len(self.code) - 1, bool)
        inner[(self.start + self.length - 1)[:-1]] = False
        odd = np.bincount(line[:-1][inner] * 64 + pair[inner].astype(np.int64), minlength=64 * n).reshape(n, 64) % 2
        return np.packbits(odd.astype(np.uint8), axis=1).view("<u8").reshape(-1)

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct index keys, the line that has each (0 if several have), distinct probe keys; all ascending."""
        keys = self.index_keys().reshape(-1)
        lines = np.tile(self.high[self.long], TAU + 1)
        order = np.argsort(keys, kind="stable")
        keys, lines = keys[order], lines[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if len(keys):
            lines = np.where(np.minimum.reduceat(lines, starts) == np.maximum.reduceat(lines, starts), lines[starts], 0)
        return keys[starts], lines.astype(np.uint64), np.unique(self.probe_keys())


def _send(table: pa.Table, buckets: int, min_chars: int, equal_chars: int) -> pa.Table:
    chunk = column(table, "chunk")[0].as_py()
    index, lines, probes = Lines(table, min_chars, equal_chars).sent()
    edges = np.arange(buckets + 1)
    at, to = (np.searchsorted(census.bucket_of(k, buckets), edges).tolist() for k in (index, probes))
    index, probes = index.astype("<u4"), probes.astype("<u4")
    rows = [(b, index[at[b] : at[b + 1]].tobytes(), lines[at[b] : at[b + 1]].tobytes(), probes[to[b] : to[b + 1]].tobytes()) for b in range(buckets) if at[b + 1] > at[b] or to[b + 1] > to[b]]
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), **{n: pa.array(c, pa.binary()) for n, c in zip(("keys", "lines", "probes"), cols[1:])}})


def _match(table: pa.Table) -> pa.Table:
    """A bucket's answers: for each segment whether another line has or probes it, for each probe whether a line has it."""
    parts = {n: column(table, n).to_pylist() for n in ("keys", "lines", "probes")}
    keys, lines, probes = (np.frombuffer(b"".join(parts[n]), kind) for n, kind in (("keys", "<u4"), ("lines", "<u8"), ("probes", "<u4")))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    known, firsts = np.unique(ordered, return_index=True)
    asked = np.unique(probes)
    if len(known):
        low, high = np.minimum.reduceat(lines[order], firsts), np.maximum.reduceat(lines[order], firsts)
        several = (low != high) | (low == 0)
        wanted = np.isin(known, asked, assume_unique=True)
        flag = (several * 2 + wanted).astype(np.uint8)
        has = flag[np.searchsorted(known, keys)]
    else:
        has = np.zeros(0, np.uint8)
    hit = np.isin(probes, known).astype(np.uint8)
    cut = lambda name, size: np.concatenate([[0], np.cumsum([len(x) // size for x in parts[name]])]).tolist()
    a, b = cut("keys", 4), cut("probes", 4)
    return pa.table(
        {
            "chunk": column(table, "chunk"),
            "bucket": column(table, "bucket"),
            "has": pa.array([has[x:y].tobytes() for x, y in zip(a, a[1:])], pa.binary()),
            "hit": pa.array([hit[x:y].tobytes() for x, y in zip(b, b[1:])], pa.binary()),
        }
    )


ROWS = "kind int, chunk int, ordinal int, doc_id long, line_no int, high long, low long, key long, probe boolean, length int, sketch long, line string"
PLACE, KEY, TEXT = 0, 1, 2


def _select(left: pa.Table, right: pa.Table, min_chars: int, equal_chars: int) -> pa.Table:
    """Of a chunk: where its lines stand, the keys that other lines may share, and the texts of lines with such keys."""
    lines = Lines(left, min_chars, equal_chars)
    index, _, probes = lines.sent()
    has, hit = census.answers(right, "has"), census.answers(right, "hit")
    own, far = lines.index_keys(), lines.probe_keys()
    own_flag = has[np.searchsorted(index, own)] if len(index) else np.zeros(own.shape, np.uint8)
    far_flag = hit[np.searchsorted(probes, far)] if len(probes) else np.zeros(far.shape, np.uint8)
    # A segment goes as such if anything matches it, and as a probe if another line has it in the same place.
    found = [(own[own_flag > 0], np.nonzero(own_flag > 0)[1], False), (own[own_flag > 1], np.nonzero(own_flag > 1)[1], True), (far[far_flag > 0], np.nonzero(far_flag > 0)[1], True)]
    key = np.concatenate([k for k, _, _ in found])
    key_line = lines.long[np.concatenate([x for _, x, _ in found])]
    probe = np.concatenate([np.full(len(k), p) for k, _, p in found])
    text_line = np.unique(key_line)
    line = np.concatenate([lines.line, key_line, text_line])
    sizes = (len(lines.line), len(key), len(text_line))
    sketch = lines.sketches()
    signed = lambda x: pa.array(x.astype(np.uint64).view(np.int64))
    fill = lambda values, at, kind: pa.concat_arrays([pa.nulls(sum(sizes[:at]), kind), pa.array(values, kind), pa.nulls(sum(sizes[at + 1 :]), kind)])
    chunk = column(left, "chunk")[0].as_py() if left.num_rows else 0
    return pa.table(
        {
            "kind": pa.array(np.repeat([PLACE, KEY, TEXT], sizes), pa.int32()),
            "chunk": pa.array(np.full(len(line), chunk, np.int32)),
            "ordinal": fill(lines.ordinal, 0, pa.int32()),
            "doc_id": pa.concat_arrays([column(lines.table, "doc_id").take(pa.array(lines.ordinal)), pa.nulls(sizes[1] + sizes[2], pa.int64())]),
            "line_no": fill(lines.line_no, 0, pa.int32()),
            "high": signed(lines.high[line]),
            "low": signed(lines.low[line]),
            "key": pa.concat_arrays([pa.nulls(sizes[0], pa.int64()), signed(key), pa.nulls(sizes[2], pa.int64())]),
            "probe": fill(probe, 1, pa.bool_()),
            "length": pa.array(lines.length[line].astype(np.int32)),
            "sketch": signed(sketch[line]),
            "line": fill([lines.texts[i] for i in text_line.tolist()], 2, pa.string()),
        }
    )


def within(a: list[str], b: list[str], most: int = TAU) -> np.ndarray:
    """The edit distance of each pair of strings, or ``most + 1`` if it is more. Lengths may differ by at most ``most``.

    Banded and bit-parallel: a column of the table within ``most`` of the diagonal is 2 * most + 1 bits of vertical
    differences, aligned with the diagonal so that it shifts by one row with each column; all pairs go in step. The
    distance on the diagonal is counted along, and the last rows' differences lead from there to the corner.
    """
    out = np.full(len(a), most + 1, np.int64)
    lengths = np.array([len(x) for x in b], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # As many pairs as fill a matrix of a set size, at the length of the longest of them.
        sizes = np.arange(1, len(order) - at + 1) * (lengths[order[at:]] + 1)
        block = order[at : at + max(1, int(np.searchsorted(sizes, MATRIX, side="right")))]
        out[block] = _band([a[i] for i in block.tolist()], [b[i] for i in block.tolist()], most)
        at += len(block)
    return np.minimum(out, most + 1)


def _codes(texts: list[str], pad: int, before: int, width: int) -> np.ndarray:
    """Characters in a matrix: ``before`` columns of a value that is no character, the text, then more of them."""
    length = np.array([len(x) for x in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full((len(texts), before + width), pad, np.uint32)
    out[np.repeat(np.arange(len(texts)), length), before + np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def _band(a: list[str], b: list[str], most: int) -> np.ndarray:
    width = 2 * most + 1
    m, n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    last = int(n.max(initial=0))
    rows = _codes(a, 0xFFFFFFFF, most, max(last, int(m.max(initial=0))) + most + 1).T.copy()
    cols = _codes(b, 0xFFFFFFFE, 0, last).T.copy()
    full = np.uint32((1 << width) - 1)
    plus = np.full(len(a), ((1 << width) - 1) ^ ((1 << most) - 1), np.uint32)
    minus = np.full(len(a), (1 << most) - 1, np.uint32)
    score = np.zeros(len(a), np.int64)
    done = np.where(n == 0, m, -1)
    for j in range(last):
        eq = np.zeros(len(a), np.uint32)
        for k in range(width):
            eq |= (rows[j + k] == cols[j]).astype(np.uint32) << np.uint32(k)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | (~(diagonal | plus) & full)
        down = diagonal & plus
        below = diagonal >> np.uint32(1)
        plus = down | (~(below | up) & full)
        minus = below & up
        score += 1 - ((diagonal >> np.uint32(most)) & np.uint32(1)).astype(np.int64)
        at = np.flatnonzero(n == j + 1)
        if len(at):
            # From row n to row m in column n: bit k is the difference at row n + 1 - most + k.
            total = score[at].copy()
            for step in range(most):
                d = lambda k: ((plus[at] >> np.uint32(k)) & np.uint32(1)).astype(np.int64) - ((minus[at] >> np.uint32(k)) & np.uint32(1)).astype(np.int64)
                total += np.where(m[at] - n[at] > step, d(most + step), 0)
                if step < most:
                    total -= np.where(n[at] - m[at] > step, d(most - 1 - step), 0)
            done[at] = total
    return done


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes([batch], "line_a"):
            edits = within(part.column("line_a").to_pylist(), part.column("line_b").to_pylist())
            near = part.drop_columns(["line_a", "line_b"]).append_column("edits", pa.array(edits.astype(np.int32)))
            yield near.filter(pa.array(edits <= TAU))
    released()


def _open(kind: pa.DataType) -> pa.DataType:
    """The type with every field of a struct, and every element of a list, nullable."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _open(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_open(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(kind.key_type, pa.field("value", _open(kind.item_type)))
    return kind


class LineJoin:
    """The chunks of a corpus, its lines, and the links between different lines (written once, read by all that follows)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, chunk_bytes: int = census.CHUNK_BYTES, equal_chars: int = 1):
        equal_chars = max(1, equal_chars)
        rows = docs.select(F.struct(F.lit(None).cast("boolean").alias("_"), *[F.col(c) for c in docs.columns if c != text_col]).alias("rest"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(text_col).isNull().alias("was_null"))
        chunks = census.chunk_count(docs, text_col, chunk_bytes)
        buckets = -(-chunks // (4 * census.CHUNKS_PER_BUCKET))  # a line sends a few keys, not one for each word
        self.dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
        sent = self.dealt.groupBy("chunk").applyInArrow(lambda t: released(_send(t, buckets, min_chars, equal_chars)), "bucket int, chunk int, keys binary, lines binary, probes binary")
        matched = sent.groupBy("bucket").applyInArrow(lambda t: released(_match(t)), "chunk int, bucket int, has binary, hit binary")
        self.found = stash(self.dealt.groupBy("chunk").cogroup(matched.groupBy("chunk")).applyInArrow(lambda left, right: released(_select(left, right, min_chars, equal_chars)), ROWS), "lines")
        self.links = stash(self._links(), "line-links")

    def _links(self) -> DataFrame:
        """(high_a, low_a, high_b, low_b, edits), each pair of different lines once."""
        keys = self.found.filter(F.col("kind") == KEY).select("key", "probe", "high", "low", "length", "sketch").distinct()
        side = lambda s, p: keys.filter(F.col("probe") == p).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("high", "low", "length", "sketch")])
        less = F.col("length_b") - F.col("length_a")
        # Of equal lengths each pair is met from both sides: one is enough.
        once = (less > 0) | (F.struct("high_a", "low_a") < F.struct("high_b", "low_b"))
        differ = (F.col("high_a") != F.col("high_b")) | (F.col("low_a") != F.col("low_b"))
        alike = F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) <= FLIPS
        ends = ["high_a", "low_a", "high_b", "low_b"]
        pairs = side("a", False).hint("merge").join(side("b", True), "key").filter(less.between(0, TAU) & once & differ & alike).select(*ends).distinct()
        texts = self.found.filter(F.col("kind") == TEXT).groupBy("high", "low").agg(F.first("line").alias("line"))
        for s in "ab":
            pairs = pairs.join(texts.select(*[F.col(c).alias(f"{c}_{s}") for c in ("high", "low", "line")]), [f"high_{s}", f"low_{s}"])
        return pairs.select(*ends, "line_a", "line_b").mapInArrow(_verify, "high_a long, low_a long, high_b long, low_b long, edits int")

    def removals(self) -> DataFrame:
        """(chunk, ordinal, line_no, near) of each line that goes; ``near``: for a line that is not the same."""
        line = ["high", "low"]
        places = self.found.filter(F.col("kind") == PLACE).select("chunk", "ordinal", "doc_id", "line_no", *line)
        at = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "line_no")
        firsts = stash(places.groupBy(*line).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("places")), "line-firsts")
        named = lambda s: firsts.select(*[F.col(c).alias(f"{c}_{s}") for c in line], F.col("first").alias(f"first_{s}"))
        both = self.links.join(named("a"), ["high_a", "low_a"]).join(named("b"), ["high_b", "low_b"])
        a_later = F.struct("first_a", "high_a", "low_a") > F.struct("first_b", "high_b", "low_b")
        later = both.select(F.when(a_later, F.col("high_a")).otherwise(F.col("high_b")).alias("high"), F.when(a_later, F.col("low_a")).otherwise(F.col("low_b")).alias("low")).distinct()
        marked = firsts.join(later.withColumn("later", F.lit(True)), line, "left").filter("later OR places > 1")
        decided = stash(marked.select(*line, "first", F.coalesce("later", F.lit(False)).alias("near")), "line-decided")
        return places.join(decided, line).filter(F.col("near") | (at != F.col("first"))).select("chunk", "ordinal", "line_no", "near")

    def cut(self) -> DataFrame:
        """(rest, doc_id, text, n_lines, n_removed, n_near): the texts without the lines that go."""
        dealt = self.dealt
        # The other columns travel as one struct, so that no name among them can clash; nothing in it need be declared non-null.
        rest = dealt.schema["rest"].dataType.simpleString()

        def apply(left: pa.Table, right: pa.Table) -> pa.Table:
            table = left.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
            gone: dict[int, dict[int, bool]] = {}
            for o, n, near in zip(*(right.column(c).to_pylist() for c in ("ordinal", "line_no", "near"))):
                gone.setdefault(o, {})[n] = near
            texts = column(table, "text").to_pylist() if table.num_rows else []
            out, lines, near = [], [], []
            for o, text in enumerate(texts):
                cut, parts = gone.get(o, {}), text.split("\n") if text else []
                lines.append(len(parts))
                near.append(sum(cut.values()))
                out.append("\n".join(p for n, p in enumerate(parts) if n not in cut) if cut else text)
            removed = [len(gone.get(o, ())) for o in range(len(texts))]
            return pa.table(
                {
                    "rest": table.column("rest").cast(_open(table.schema.field("rest").type)),
                    "doc_id": table.column("doc_id"),
                    "text": pa.array([None if null else t for t, null in zip(out, table.column("was_null").to_pylist())], pa.string()),
                    **{n: pa.array(x, pa.int64()) for n, x in (("n_lines", lines), ("n_removed", removed), ("n_near", near))},
                }
            )

        schema = f"rest {rest}, doc_id long, text string, n_lines long, n_removed long, n_near long"
        return dealt.groupBy("chunk").cogroup(self.removals().groupBy("chunk")).applyInArrow(apply, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, chunk_bytes: int = census.CHUNK_BYTES, equal_chars: int = 1) -> DataFrame:
    """One row per document: doc_id, text (without the lines that go), n_lines, n_removed, n_near (removed for a line that is not the same)."""
    return LineJoin(docs.select(id_col, text_col), id_col, text_col, min_chars, chunk_bytes, equal_chars).cut().drop("rest")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, equal_chars: int = 1) -> DataFrame:
    """``docs`` with its texts cut, all columns kept; a document of which no word is left goes."""
    cut = LineJoin(docs, id_col, text_col, min_chars, equal_chars=equal_chars).cut()
    kept = cut.filter(F.col("text").isNull() | (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
