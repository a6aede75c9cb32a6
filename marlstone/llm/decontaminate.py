"""Operator 6: benchmark decontamination by pigeonhole edit matching.

A test item of n normalised characters may occur with up to k = n // `chars_per_edit`
edits. Cut into k + 1 pieces, an occurrence must hold one of them unchanged. An
Aho-Corasick automaton over all pieces finds the exact hits in one pass over each
whole text; around a hit, Myers' bit-parallel algorithm (the item in one long
machine number) finds the end and the distance of the best occurrence. Texts and
items are compared in lower case with every run of characters that are neither
letters nor digits as one space. An item of fewer than `min_chars` normalised
characters is a string that many words hold by chance: it counts only unchanged
and as whole words.

The items are the stated query set: they are read in blocks of at most
`block_bytes` of text, and each block is matched against every row, so neither the
driver's Python nor a task ever holds more than one block. There is no shuffle; each
further block is one more scan of the rows, and its items stay in a broadcast, which
Spark may keep on disk, until the query is done.

Cases: a null or empty text has no hit, nor has an item without letters or
digits; several items of one text each hit, and several texts under one id each for
themselves; a null item_id is an id like any other; equal rows of items count once;
occurrences of one item in one text are reported once each, by their place;
repeated rows give repeated hits; empty tables give none; other columns are left
out of the hits and kept by `drop_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import by_bytes, id_text, texts_of

NOT_WORD = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    return NOT_WORD.sub(" ", text.lower()).strip()


def best_end(masks: dict[str, int], size: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of a pattern in a text, if within ``most`` edits; the first such end.

    Myers: the pattern's column of differences is two numbers of ``size`` bits.
    """
    last, full = 1 << (size - 1), (1 << size) - 1
    plus, minus, score, found = full, 0, size, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score <= most and (found is None or score < found[0]):
            found = (score, i + 1)
    return found


class Item:
    def __init__(self, item_id: int, text: str, edits: int, words: bool = False):
        self.item_id, self.text, self.edits, self.words = item_id, text, edits, words
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece) of ``edits + 1`` pieces of even length."""
        n, parts = len(self.text), self.edits + 1
        cuts = [i * n // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int, min_chars: int):
        import ahocorasick

        self.items = [Item(i, t, len(t) // chars_per_edit if len(t) >= min_chars else 0, len(t) < min_chars) for i, t in ((i, normalise(t or "")) for i, t in items) if t]
        by_piece: dict[str, list[tuple[Item, int]]] = {}
        for item in self.items:
            for offset, piece in item.pieces():
                by_piece.setdefault(piece, []).append((item, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of each occurrence, in places of the normalised text; start is end less the item's length."""
        if not len(self.automaton):
            return []
        text = normalise(text)
        found, covered, tried = [], {}, {}  # by item: one id may have several
        for last, (size, uses) in self.automaton.iter(text):
            start = last + 1 - size
            for item, offset in uses:
                if start < covered.get(item, 0):
                    continue
                at, n, k = start - offset, len(item.text), item.edits
                if item.words:
                    whole = (not start or text[start - 1] == " ") and text[last + 1 : last + 2] in ("", " ")
                    best = (0, last + 1) if whole else None
                elif at >= 0 and text.startswith(item.text, at):
                    best = (0, at + n)
                elif tried.get(item) == at:
                    continue
                else:
                    tried[item] = at
                    low = max(0, at - k)
                    best = best_end(item.masks, n, text[low : at + n + k], k)
                    best = best and (best[0], low + best[1])
                if best:
                    covered[item] = best[1]
                    found.append((item.item_id, max(0, best[1] - n), best[1], best[0]))
        return found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, each collected alone; an item goes to its block by a hash of its id."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for b in range(n):
        yield sorted(((r.i, r.t) for r in (items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _matchers(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, chars_per_edit: int, min_chars: int, block_bytes: int):
    """One broadcast of items for each block; an executor builds the automaton of a block once."""
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        yield lambda shared=shared: Matcher(shared.value, chars_per_edit, min_chars)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    chars_per_edit: int = 16,
    min_chars: int = 24,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per occurrence: doc_id, item_id, start, end (in the normalised text), edits."""

    def scan(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = make()
            for batch in by_bytes(batches):
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch).to_pylist()) for hit in matcher.hits(t)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "start", "end", "edits"])

        return run

    rows = id_text(docs, id_col, text_col)
    found = [rows.mapInArrow(scan(m), "doc_id long, item_id long, start long, end long, edits long") for m in _matchers(docs, benchmark, item_id, item_text, chars_per_edit, min_chars, block_bytes)]
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_edit: int = 16, min_chars: int = 24, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in whose text no item occurs, with all their columns."""

    def scan(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = make()
            for batch in by_bytes(batches, text_col):
                clean = [not matcher.hits(t) for t in texts_of(batch, text_col).to_pylist()]
                yield batch.filter(pa.array(clean))

        return run

    for make in _matchers(docs, benchmark, item_id, item_text, chars_per_edit, min_chars, block_bytes):
        docs = docs.mapInArrow(scan(make), docs.schema)
    return docs
