"""Operator 9: language identification by prediction by partial matching (PPM).

Each language has a variable-order context model over bytes. A context of up to
``order`` bytes predicts the next byte from its counts; with the escape
probability d / (n + d) (method C: n symbols seen in the context, d of them
distinct) it passes to the next shorter context, and below the empty context to
a uniform distribution over 256 bytes. Statistics are frozen after learning, so
the cost of a byte depends only on the bytes before it, and a language's tree
compiles to a row of costs for each context that the language has: two bytes of
context choose a node, a third refines it where the deeper context is in a tree,
and a node points to the row of its longest suffix in the language's own tree.
Costs are fixed-point code lengths (1/65536 bit, up to 65,536 bits), so a text's
code length is an exact integer sum, the same in any order and in any batch;
whole texts are scored.

The learned language with the shortest code wins (ties: the smaller name); the
score is its posterior under equal priors, 1 / sum of 2^-(difference in bits).

Learning uses a bounded sample: per language the ``sample_docs`` labelled
documents of smallest md5 of their id, up to ``sample_bytes`` of text, of which the
last document gives its start. No more of any text than that reaches the driver.
The contexts of a language are bounded by its sample.

Cases: a null text or one without a letter is ``und`` with score 0; with no
learned language every text is ``und``; a null lang is not learned from; rows
with equal ids are scored one by one; an empty table gives none; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import by_bytes, bytes_of, texts_of

#: Fixed point of a code length: units in a bit. A cost fits in 32 bits whatever the sample: 65,536 bits.
UNITS = 1 << 16
#: Bits of a byte in the uniform code, and by how many bits of a text it must win before the text counts as of no language.
UNIFORM, EVIDENCE = 8, 64
UNDETERMINED = "und"


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


class Trees:
    """Context models of order 3 of several languages, compiled into tables of costs.

    Bytes are ranked: those seen in learning get a rank, all others share one, whose cost is that of a byte never
    seen. Nodes are contexts of two ranks, ``rank[i-2] * R + rank[i-1]``, and deeper ones, refined by ``rank[i-3]``,
    that occur ``min_count`` times or more in all samples; a text starts as if after line feeds. A language has a row
    of costs for each of its own contexts, and for each node the place of the row that applies.
    """

    def __init__(self, samples: dict[str, list[bytes]], min_count: int = 3):
        self.langs = sorted(samples)
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        seen[10] = True
        self.rank = np.full(256, int(seen.sum()), np.int64)
        self.rank[seen] = np.arange(int(seen.sum()))
        self.size = R = int(seen.sum()) + 1
        places = {lang: self._places(samples[lang]) for lang in self.langs}
        contexts, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(deep for deep, _ in places.values())]), return_counts=True)
        own = contexts[counts >= min_count]
        # Of all contexts of three bytes the node: its own, or that of its last two bytes.
        self.deeper = np.tile(np.arange(R * R, dtype=np.int32), R)
        self.deeper[own] = R * R + np.arange(len(own), dtype=np.int32)
        self.rows, self.costs = [], []
        for lang in self.langs:
            rows, costs = self._compiled(*places[lang], own)
            self.rows.append(rows)
            self.costs.append(costs)

    def _places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of a language's sample its context of three ranks, as one number, and its rank."""
        R, first = self.size, np.full(3, self.rank[10])
        ranked = [np.concatenate([first, self.rank[np.frombuffer(t, np.uint8)]]) for t in texts]
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return join([(x[:-3] * R + x[1:-2]) * R + x[2:-1] for x in ranked]), join([x[3:] for x in ranked])

    def _compiled(self, deep: np.ndarray, symbol: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the place of its row, and all rows of costs, one after another."""
        R = self.size
        below = np.full((1, R), 1 / 256)
        tables, row = [], np.zeros(1, np.int64)  # of each context of the order at hand, the row that applies
        total = 0
        for order in range(4):
            context = deep % R**order
            if order == 3:
                at = np.searchsorted(own, context)
                kept = at < len(own)
                kept[kept] = own[at[kept]] == context[kept]
                context, after = context[kept], symbol[kept]
            else:
                after = symbol
            known, number = np.unique(context, return_inverse=True)
            counts = np.bincount(number * R + after, minlength=len(known) * R).reshape(-1, R).astype(np.float64)
            if order == 0:
                p, known = _after(counts if len(counts) else np.zeros((1, R)), below), np.zeros(1, np.int64)
                before = row
            else:
                # Ranges of contexts one byte longer, all on the row of their suffix until they have their own.
                before = np.tile(row, R) if order < 3 else row[own % R**2]
                at = known if order < 3 else np.searchsorted(own, known)
                p = _after(counts, np.concatenate(tables)[before[at]]) if len(known) else np.zeros((0, R))
            row = before.copy()
            row[known if order < 3 else np.searchsorted(own, known)] = total + np.arange(len(known))
            if order == 2:
                two = row
            total += len(known)
            tables.append(p)
        costs = np.round(-np.log2(np.concatenate(tables)) * UNITS).astype(np.uint32).reshape(-1)
        return (np.concatenate([two, row]) * R).astype(np.int32 if len(costs) < 2**31 else np.int64), costs

    def code_lengths(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Units of each text (rows) in each language (columns). ``ends``: offsets of the texts in ``raw``."""
        n, R, first = len(ends) - 1, self.size, self.rank[10]
        if not len(raw):
            return np.zeros((n, len(self.langs)), np.int64)
        x = self.rank[raw]
        starts = ends[:-1][np.diff(ends) > 0]
        before = []
        for k in (1, 2, 3):
            b = np.empty_like(x)
            b[k:] = x[:-k] if k < len(x) else x[:0]
            b[:k] = first
            for j in range(k):  # the first k bytes of a text must not see the text before it; past a shorter text they are the next one's first bytes
                at = starts + j
                b[at[at < len(x)]] = first
            before.append(b)
        node = self.deeper[(before[2] * R + before[1]) * R + before[0]]
        out = np.empty((n, len(self.langs)), np.int64)
        cost = np.zeros(len(x) + 1, np.uint32)
        for i, (rows, costs) in enumerate(zip(self.rows, self.costs)):
            np.take(costs, rows[node] + x, out=cost[:-1])
            out[:, i] = np.add.reduceat(cost, ends[:-1], dtype=np.int64)
        out[np.diff(ends) == 0] = 0
        return out


def _after(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with these counts, escaping to the shorter contexts' probabilities."""
    n = counts.sum(axis=-1, keepdims=True)
    d = (counts > 0).sum(axis=-1, keepdims=True)
    escape = np.where(n > 0, d / np.maximum(n + d, 1), 1.0)
    return counts / np.maximum(n + d, 1) + escape * shorter


def _smallest(rows: DataFrame, n: int) -> list[tuple[str, str, int]]:
    """(lang, pick, doc_id): the n smallest picks of each language, in order.

    ``pick`` is hexadecimal and evenly spread, so a bound on its leading digits that should leave 2n of a language's
    rows goes into the filter, and no more than these reach the driver, whatever the rows and tasks; a language that
    is left with too few is asked again with a bound twice as large."""
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    share = {lang: min(1.0, 2 * n / count) for lang, count in counts.items()}
    out: list[tuple[str, str, int]] = []
    while share:
        bound = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, "g" if part >= 1 else f"{int(part * 2**32):08x}")])[F.col("lang")]
        near = rows.filter(F.col("lang").isin(list(share)) & (F.substring("pick", 1, 8) < bound)).distinct().collect()
        for lang in list(share):
            own = sorted((r.lang, r.pick, r.doc_id) for r in near if r.lang == lang)
            if len(own) >= min(n, counts[lang]) or share[lang] >= 1:
                out += own[:n]
                del share[lang]
            else:
                share[lang] = min(1.0, 2 * share[lang])
    return sorted(out)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 300, sample_bytes: int = 1 << 20) -> Trees:
    """Models from the labelled documents that are not held out; the sample of a language is bounded by the two parameters:
    its documents of the smallest picks, in that order, until ``sample_bytes`` are full. The document that fills the
    bound gives its start, so that a language of long texts alone is learned too."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    chosen = _smallest(rows.select("lang", "doc_id", F.md5(F.col("doc_id").cast("string")).alias("pick")), sample_docs)
    if not chosen:
        return Trees({})
    spark = docs.sparkSession

    def whole(wanted: DataFrame) -> DataFrame:
        """The texts of chosen documents; of rows with one id the smallest."""
        return rows.join(F.broadcast(wanted), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"), F.first("take").alias("take"))

    def picked(take: dict[tuple[str, int], int]) -> DataFrame:  # a bounded number for each language
        return spark.createDataFrame([(*k, n) for k, n in take.items()], "lang string, doc_id long, take int")

    sizes = {(r.lang, r.doc_id): r.n for r in whole(picked({(lang, d): 0 for lang, _, d in chosen})).select("lang", "doc_id", F.octet_length("text").alias("n")).collect()}
    left: dict[str, int] = {}
    take: dict[tuple[str, int], int] = {}
    for lang, _, doc_id in chosen:
        n = min(sizes[lang, doc_id], left.setdefault(lang, sample_bytes))
        if n:
            take[lang, doc_id] = n
            left[lang] -= n
    texts = {(r.lang, r.doc_id): r.text for r in whole(picked(take)).select("lang", "doc_id", F.expr("substring(text, 1, take)").alias("text")).collect()} if take else {}
    samples: dict[str, list[bytes]] = {}
    for (lang, doc_id), n in take.items():
        samples.setdefault(lang, []).append(texts[lang, doc_id].encode()[:n])
    return Trees(samples)


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, bits (the code length in bits under the language predicted)."""
    langs = trees.langs
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in by_bytes(batches, most=1 << 20):
            raw, ends = bytes_of(texts_of(batch))
            cost = model.code_lengths(raw, ends)
            best = cost.argmin(axis=1)
            least = cost.min(axis=1)
            score = 1 / np.exp2((least[:, None] - cost) / UNITS).sum(axis=1)
            clear = batch.column("clear").to_numpy(zero_copy_only=False)
            names = [langs[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), clear.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(np.where(clear, score, 0.0)), pa.array(least / UNITS)],
                ["doc_id", "lang_pred", "score", "bits"],
            )

    clear = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), clear.alias("clear"))
    if not langs:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, trees: Trees, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, with all their columns and as ``lang`` the language predicted.

    A text has none if it is null or has no letter, or if every language's model needs more bits for it than the
    uniform code, eight for a byte, by ``EVIDENCE`` bits: then no model has anything to say of it."""
    langs = trees.langs
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    place = docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, most=1 << 20):
            raw, ends = bytes_of(texts_of(batch, text_col))
            cost = shared.value.code_lengths(raw, ends)
            found = pa.array([langs[i] for i in cost.argmin(axis=1).tolist()], batch.column(lang_col).type)
            known = cost.min(axis=1) <= UNITS * (UNIFORM * np.diff(ends) + EVIDENCE)
            yield batch.set_column(place, batch.schema.field(lang_col), found).filter(pa.array(known))

    if not langs:
        return docs.filter(F.lit(False))
    return docs.filter(F.col(text_col).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
