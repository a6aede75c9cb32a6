"""Lexical channels: BM25 over postings, and the keyword-hit count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.ranking import DIGITS, ranked
from . import scope as scopes

# Saturation and length normalization.
K1, B = 1.2, 0.75
#: Terms of all queries up to which they go to the documents, and scores of a task's matrix at a time.
BLOCK_TERMS, SCORES = 200_000, 1 << 20
#: Rows and bytes of text that a task cuts into tokens at a time, beyond which a text goes alone.
BATCH_ROWS, PIECE_BYTES = 1 << 14, 2 << 20
#: Rows that wait to be among a task's best, and counts of a task by scope and term.
WAITING, COUNTS = 1 << 16, 1 << 22
#: Pairs of a document's term and a query that has it, which a task lays out at a time.
LAID = 1 << 17

#: Bytes as tokens have them: ASCII letters small, digits and the underscore, all else a space.
_TOKEN = np.full(256, 0x20, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _TOKEN[_c] = _TOKEN[ord(chr(_c).upper())] = _c
#: First bytes of characters among which are those that tokens treat in another way.
_RARE = np.zeros(256, bool)
_RARE[[0xC4, *range(0xE2, 0xF0)]] = True


#: A tokenizer: the array of a text's tokens.
Tokenizer = Callable[[Column], Column]


def tokenised(corpus: DataFrame, text_col: str = "text", tokenize: Tokenizer = tx.tokens) -> DataFrame:
    """The corpus with ``tokens`` in place of its text, and ``dl``, their number."""
    out = corpus.withColumn("tokens", tokenize(F.col(text_col))).drop(text_col)
    return out.withColumn("dl", F.size("tokens"))


def query_terms(queries: DataFrame, tokenize: Tokenizer = tx.tokens) -> DataFrame:
    """The queries with ``term``, one row for each distinct term."""
    return queries.select(*[c for c in queries.columns if c != "text"], F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def once(queries: DataFrame, scope: list[str]) -> DataFrame:
    """(query_id, text, columns of ``scope``), one row for each id that is not null: of several the one of the least text."""
    rows = queries.filter("query_id IS NOT NULL").select("query_id", F.coalesce("text", F.lit("")).alias("text"), *scopes.asked(scope))
    least = rows.groupBy("query_id").agg(F.min(F.struct("text", *scope)).alias("q"))
    return least.select("query_id", "q.*")


def _scope_id(scope: list[str]) -> Column:
    return F.to_json(F.struct(*scope)) if scope else F.lit("{}")


def bm25_scores(queries: DataFrame, corpus: DataFrame, scope: list[str] | None = None, tokenize: Tokenizer = tx.tokens) -> DataFrame:
    """(query_id, doc_id, score) of every document that has a term of a query.

    ``queries``: query_id, text and the columns of ``scope``; ``corpus``: doc_id, text and the same columns. A query
    sees the documents that have each value it asks for (null, empty or ``*`` asks for nothing), and statistics are
    those of these documents. Only terms that some query has become postings, so what is shuffled follows the
    queries' terms and not the corpus's words. A null text has no words and counts as a document; a row without an id is
    none, and a query without an id asks nothing.
    """
    scope = scope or []
    corpus = corpus.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *scope)
    asked = once(queries, scope).withColumn("scope_id", _scope_id(scope))
    known = asked.select("scope_id", *scope).distinct()
    seen = lambda rows: scopes.visible(rows, known, scope).drop(*scope)
    terms = query_terms(asked.select("query_id", "scope_id", "text"), tokenize)
    length = tx.token_count(F.col("text")) if tokenize is tx.tokens else F.size(tokenize(F.col("text")))
    stats = seen(corpus.select(*scope, length.alias("dl"))).groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    wanted = terms.select("term").distinct()
    postings = tokenised(corpus, tokenize=tokenize).select("doc_id", "dl", *scope, F.explode("tokens").alias("term")).join(wanted, "term", "left_semi")
    postings = seen(postings.groupBy("doc_id", "dl", *scope, "term").agg(F.count(F.lit(1)).alias("tf")))
    df = postings.groupBy("scope_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, ["scope_id", "term"]).join(stats, "scope_id").select("query_id", "scope_id", "term", "avgdl", idf.alias("idf"))
    ratio = F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * ratio))
    return weights.join(postings, ["scope_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25(queries: DataFrame, corpus: DataFrame, top: int = 10, scope: list[str] | None = None, block_terms: int = BLOCK_TERMS, tokenize: Tokenizer = tx.tokens) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of each query, ties by id.

    If the queries have no more than ``block_terms`` distinct terms in all, they go to the documents: one pass counts
    the documents of each term, a second scores whole batches and keeps each task's best, and all that is shuffled is
    counts and best rows. Beyond that postings and terms are joined. Both ways give the same rows. A tokenizer of one's
    own cuts the texts in Spark, and its tokens go where else texts go."""
    scope = scope or []
    block = _block(queries, scope, block_terms, tokenize)
    if block is None:
        return ranked(bm25_scores(queries, corpus, scope, tokenize), ["query_id"], top=top)
    rows = _texts(corpus.filter("doc_id IS NOT NULL"), ["doc_id"], scope, tokenize)
    counted = rows.mapInArrow(block.count, "scope int, term int, n long, dl long").groupBy("scope", "term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    block.weigh([(r.scope, r.term, r.n, r.dl) for r in counted.collect()])  # scopes and terms of the block, no more
    return ranked(rows.mapInArrow(lambda batches: block.score(batches, top), "query_id long, doc_id long, score double"), ["query_id"], top=top)


def pieces(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most ``rows`` rows and ``PIECE_BYTES`` of the strings (or lists of strings) of a column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(column)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        if pa.types.is_list(part.type):
            ends = np.frombuffer(part.values.buffers()[1], np.int32)[part.values.offset + ends] if len(part.values) else np.zeros_like(ends)
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, int(ends[at]) + PIECE_BYTES, side="right")) - 1
            stop = min(max(stop, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def summed(doc: np.ndarray, first: np.ndarray, each: np.ndarray, value: np.ndarray, query: np.ndarray, times: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
    """(documents, queries) of sums. An entry (sorted by ``doc``) gives its value, if need be ``times`` over, to each of the
    ``each`` queries from its place ``first`` in ``query`` on. ``LAID`` of these are laid out at a time, or those of one document."""
    out, cuts = np.zeros(shape), np.flatnonzero(np.diff(doc, prepend=-1, append=shape[0]))
    upto, at = np.concatenate([[0], np.cumsum(each)])[cuts], 0
    while at < len(cuts) - 1:
        stop = max(int(np.searchsorted(upto, upto[at] + LAID, side="right")) - 1, at + 1)
        own, low, high = slice(cuts[at], cuts[stop]), doc[cuts[at]], doc[cuts[stop] - 1] + 1
        n = each[own]
        place = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        weights = np.repeat(value[own], n)
        cell = np.repeat(doc[own] - low, n) * shape[1] + query[place]
        out[low:high] += np.bincount(cell, weights=weights if times is None else weights * times[place], minlength=(high - low) * shape[1]).reshape(-1, shape[1])
        at = stop
    return out


class Best:
    """The best rows of each query of all that a task has seen: by descending score, then id. What comes waits until it is
    as much as what is kept, so that little is sorted twice."""

    def __init__(self, queries: int, top: int):
        self.top, self.least = top, np.full(queries, -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.come: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[query]
        self.come.append((query[good], doc[good], score[good]))
        self.waiting += len(self.come[-1][0])
        if self.waiting > max(len(self.kept[0]), WAITING):
            self._merge()

    def _merge(self) -> None:
        query, doc, score = (np.concatenate(x) for x in zip(self.kept, *self.come))
        by = np.lexsort((doc, -score, query))
        query = query[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept, last = by[place < self.top], place == self.top - 1
        self.least[query[last]] = score[by][last]
        self.kept, self.come, self.waiting = (query[place < self.top], doc[kept], score[kept]), [], 0

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        self._merge()
        query, doc, score = self.kept
        return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])


def token_lengths(texts: pa.Array) -> np.ndarray:
    """The number of ``tx.tokens`` of each text, none of which is made where that is possible."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = ends - ends[:1] if len(texts) else np.zeros(1, np.int64)
    word = _TOKEN[raw] != 0x20
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    begin[heads] = word[heads]
    lengths = np.diff(np.concatenate([[0], np.cumsum(begin)])[ends])
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, np.flatnonzero(_RARE[raw]), side="right") - 1] = True
    some = np.flatnonzero(odd)
    odd[some] = pc.match_substring_regex(texts.take(pa.array(some)), f"[İK{tx.CJK}]").to_numpy(zero_copy_only=False)
    for d in np.flatnonzero(odd).tolist():
        lengths[d] = len(tx.split_tokens(texts[d].as_py()))
    return lengths


class Scopes:
    """The distinct scopes of a block of queries, and which rows of a batch each may see."""

    def __init__(self, asked: list[tuple[str | None, ...]], names: list[str]):
        self.names = names
        self.all = sorted(set(asked), key=repr)
        number = {s: i for i, s in enumerate(self.all)}
        self.of = np.array([number[s] for s in asked], np.int64)

    def seen(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
        """The number of each scope with its rows (none: all)."""
        columns = [batch.column(c).dictionary_encode() for c in self.names]
        places = [{v: i for i, v in enumerate(c.dictionary.to_pylist())} for c in columns]
        values = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns]
        for number, wanted in enumerate(self.all):
            match = None
            for want, at, codes in zip(wanted, places, values):
                if want is not None:
                    own = codes == at.get(want, -2)
                    match = own if match is None else match & own
            yield number, match


def _block(queries: DataFrame, scope: list[str], block_terms: int, tokenize: Tokenizer = tx.tokens) -> Block | None:
    """The queries as a block if they have no more than so many terms in all."""
    asked = once(queries, scope).select("query_id", *scope, F.array_compact(F.array_distinct(tokenize(F.col("text")))).alias("terms"))
    if (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) > block_terms:
        return None
    block = Block([(r.query_id, tuple(r[c] for c in scope), r.terms) for r in asked.collect()], scope)
    return None if block.counts > COUNTS else block


def _texts(corpus: DataFrame, columns: list[str], scope: list[str], tokenize: Tokenizer = tx.tokens) -> DataFrame:
    """What goes to a block: texts, or the tokens that a tokenizer of one's own makes of them."""
    text = F.coalesce("text", F.lit(""))
    return corpus.select(*columns, (text if tokenize is tx.tokens else tokenize(text)).alias("text"), *[F.col(c).cast("string").alias(c) for c in scope])


class Block:
    """A block of queries that is matched against batches of documents."""

    def __init__(self, asked: list[tuple[int, tuple, list[str]]], names: list[str]):
        self.queries = sorted(asked, key=lambda q: q[0])
        self.ids = np.array([q for q, _, _ in self.queries], np.int64)
        self.number: dict[str, int] = {}
        for _, _, terms in self.queries:
            for t in terms:
                self.number.setdefault(t, len(self.number))
        self.scopes = Scopes([s for _, s, _ in self.queries], names)
        self.weights: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @property
    def counts(self) -> int:
        return len(self.scopes.all) * len(self.number)

    def _entries(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, times) of the block's terms in texts (or lists of tokens), and the number of tokens of each."""
        if pa.types.is_list(texts.type):
            each = np.diff(texts.offsets.to_numpy()).astype(np.int64)
            return *self._found(np.repeat(np.arange(len(texts)), each), self._numbers(texts.flatten())), each
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[:1] if len(ends) else np.zeros(1, np.int32)
        # Texts with characters that are cut into bigrams, or that only a full lower-casing makes Latin, go one by one.
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(_RARE[raw]), side="right") - 1] = True
        some = np.flatnonzero(odd)
        odd[some] = pc.match_substring_regex(texts.take(pa.array(some)), f"[İK{tx.CJK}]").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(_TOKEN[raw])), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        full = np.concatenate([[0], np.cumsum(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))])
        lengths = np.diff(full[offsets])
        found = self._numbers(flat)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        doc, found = doc[found >= 0], found[found >= 0]
        if odd.any():
            more_doc, more = [], []
            for d in np.flatnonzero(odd).tolist():
                tokens = tx.split_tokens(texts[d].as_py())
                own = [self.number[t] for t in tokens if t in self.number]
                lengths[d] = len(tokens)
                more_doc += [d] * len(own)
                more += own
            kept = ~odd[doc]
            doc, found = np.concatenate([doc[kept], np.array(more_doc, np.int64)]), np.concatenate([found[kept], np.array(more, np.int64)])
        return *self._found(doc, found), lengths

    def _numbers(self, tokens: pa.Array) -> np.ndarray:
        """The number of each token among the block's terms, -1 for others."""
        terms = pa.array(list(self.number), pa.string())
        return pc.fill_null(pc.index_in(tokens, terms), -1).to_numpy(zero_copy_only=False) if len(terms) else np.full(len(tokens), -1)

    def _found(self, doc: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, found, many = doc[found >= 0], found[found >= 0], max(1, len(self.number))
        distinct, times = np.unique(doc.astype(np.int64) * many + found, return_counts=True)
        return distinct // many, distinct % many, times

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each term by scope; under term -1 all documents and their tokens."""
        df = np.zeros((len(self.scopes.all), len(self.number)), np.int64)
        n, dl = np.zeros(len(self.scopes.all), np.int64), np.zeros(len(self.scopes.all), np.int64)
        for batch in pieces(batches, "text", BATCH_ROWS):
            doc, term, _, lengths = self._entries(batch.column("text"))
            for scope, rows in self.scopes.seen(batch):
                df[scope] += np.bincount(term if rows is None else term[rows[doc]], minlength=len(self.number))
                n[scope] += len(lengths) if rows is None else int(rows.sum())
                dl[scope] += int((lengths if rows is None else lengths[rows]).sum())
        for scope in range(len(n)):
            some = np.flatnonzero(df[scope])
            term = np.concatenate([[-1], some]).astype(np.int32)
            lengths = np.zeros(len(term), np.int64)
            lengths[0] = dl[scope]
            columns = [np.full(len(term), scope, np.int32), term, np.concatenate([n[scope : scope + 1], df[scope][some]]), lengths]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["scope", "term", "n", "dl"])

    def weigh(self, counts: list[tuple[int, int, int, int]]) -> None:
        """From the counts of the whole corpus, for each scope: the mean length, the terms' weights, the queries, and those of each term."""
        count = np.zeros((len(self.scopes.all), 2), np.int64)
        df = np.zeros((len(self.scopes.all), len(self.number)))
        for scope, term, n, dl in counts:
            if term < 0:
                count[scope] += n, dl
            else:
                df[scope, term] += n
        for scope, (n, dl) in enumerate(count.tolist()):
            own = np.flatnonzero(self.scopes.of == scope)
            pairs = sorted((self.number[t], i) for i, q in enumerate(own.tolist()) for t in self.queries[q][2])
            term, query = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            firsts = np.searchsorted(term, np.arange(len(self.number) + 1))
            self.weights.append((dl / n if n else 0.0, np.log(1 + (n - df[scope] + 0.5) / (df[scope] + 0.5)), own, query, firsts))

    def score(self, batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
        """The task's best documents of each query."""
        best = Best(len(self.queries), top)
        for batch in pieces(batches, "text", max(1, SCORES // max(1, len(self.queries)))):
            doc, term, times, lengths = self._entries(batch.column("text"))
            docs = batch.column("doc_id").to_numpy()
            for scope, rows in self.scopes.seen(batch):
                avgdl, idf, own, query, firsts = self.weights[scope]
                d, t, tf = (doc, term, times) if rows is None else (x[rows[doc]] for x in (doc, term, times))
                ratio = lengths[d] / avgdl if avgdl else np.ones(len(d))
                value = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * ratio))
                scores = np.round(summed(d, firsts[t], firsts[t + 1] - firsts[t], value, query, None, (batch.num_rows, len(own))), DIGITS)
                r, q = best_of_batch(scores, docs, top, least=0)
                best.add(own[q], docs[r], scores[r, q])
        yield best.rows(self.ids)


def unmatched(queries: DataFrame, corpus: DataFrame, scope: list[str] | None = None, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(query_id, term): distinct query terms that no document has, of those that the query's ``scope`` lets it see.

    Up to ``block_terms`` distinct terms with their scopes go to the documents, which are read once and shuffle no word.
    Beyond that each task gives its distinct words, of which those that are asked for meet the terms."""
    scope = scope or []
    terms = query_terms(queries.select("query_id", "text", *scopes.asked(scope))).withColumn("scope_id", _scope_id(scope))
    known = _known_to_block(terms, corpus, scope, block_terms)
    if known is None:
        wanted = terms.select("term").distinct()
        words = tokenised(corpus.select("doc_id", "text", *scope)).select(*scope, F.explode(F.array_distinct("tokens")).alias("term"))
        # Distinct first: what is shuffled and sorted is a task's vocabulary and not its words.
        known = words.distinct().join(wanted, "term", "left_semi")
        if scope:
            known = scopes.visible(known, terms.select("scope_id", *scope).distinct(), scope).select("scope_id", "term").distinct()
        # Hashed by what is known, which is distinct: the queries' terms are as many as their words and would all be sorted.
        known = known.hint("shuffle_hash")
    return terms.join(known, known.columns, "left_anti").select("query_id", "term")


def _known_to_block(terms: DataFrame, corpus: DataFrame, scope: list[str], block_terms: int) -> DataFrame | None:
    """(scope_id, term) of what documents have, if there are no more than so many terms."""
    asked = terms.select("scope_id", *scope, "term").distinct().limit(block_terms + 1).collect()
    if len(asked) > block_terms:
        return None
    block = Block([(n, tuple(r[c] for c in scope), [r.term]) for n, r in enumerate(asked)], scope)
    if block.counts > COUNTS:
        return None
    names, ids = list(block.number), {tuple(r[c] for c in scope): r.scope_id for r in asked}
    counted = _texts(corpus.withColumn("text", F.coalesce("text", F.lit(""))), [], scope).mapInArrow(block.count, "scope int, term int, n long, dl long")
    held = counted.filter("term >= 0").select("scope", "term").distinct().collect()  # scopes and terms of the block, no more
    return corpus.sparkSession.createDataFrame([(ids[block.scopes.all[r.scope]], names[r.term]) for r in held], "scope_id string, term string")


def keyword_hits(queries: DataFrame, corpus: DataFrame, top: int = 10, block_bytes: int = 512 << 10, scope: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the number of a query's tokens, repeats counted, that a text contains anywhere.

    A token is one character or lies within one run of letters and digits, so only the distinct runs of a batch of texts
    meet the tokens of a block of queries, all tokens of a length at once; a run leads to its documents, a token to
    its queries, and each batch keeps its best documents of each query. Queries are read in blocks of bounded size. A
    query sees the documents of its ``scope``, by the rule of `scope`. Rows and queries without an id are left out.
    """
    found, names = None, scope or []
    rows = corpus.filter("doc_id IS NOT NULL").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), *[F.col(c).cast("string").alias(c) for c in names])
    for block in _blocks(once(queries, names).select("query_id", *names, tx.keyword_tokens(F.col("text")).alias("tokens")), names, block_bytes):
        part = rows.mapInArrow(lambda batches, block=block: Keywords(block, names).score(batches, top), "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    return ranked(found, ["query_id"], top=top)


def _blocks(queries: DataFrame, names: list[str], block_bytes: int) -> Iterator[list[tuple[int, tuple, list[str]]]]:
    size = queries.agg(F.sum(F.aggregate("tokens", F.lit(16), lambda s, t: s + 16 + F.octet_length(t)))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        yield sorted(((r.query_id, tuple(r[c] for c in names), r.tokens) for r in part.collect()), key=lambda q: q[0])


def best_of_batch(scores: np.ndarray, ids: np.ndarray, top: int, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best of each column of (rows, queries), by descending score, then id; above ``least``.

    A partition finds each column's last place, and only what is no worse is sorted, ties at the last place among it."""
    n = len(scores)
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    good = scores >= np.partition(scores, n - top, axis=0)[n - top] if n > top else np.ones(scores.shape, bool)
    if least is not None:
        good &= scores > least
    columns, rows = np.nonzero(good.T)
    order = np.lexsort((ids[rows], -scores[rows, columns], columns))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(columns)) - np.searchsorted(columns, columns)
    return rows[place < top], columns[place < top]


#: Bytes of distinct runs that are looked through at a time, scores of a task's matrix at a time, and its cells by text and token.
RUN_BYTES, KEYWORD_SCORES, HELD = 1 << 16, 1 << 19, 1 << 23
#: Bits of a table that tells most words of eight bytes from those that begin a token.
_MAYBE = 16


class Words:
    """Words of at most eight bytes, each a number, that are looked for at once in numbers of the same bytes."""

    def __init__(self, words: list[bytes]):
        self.words = np.unique(np.array([int.from_bytes(w, "little") for w in words], np.uint64))
        self.maybe = np.zeros(1 << _MAYBE, bool)
        self.maybe[self._slot(self.words)] = True

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        return (words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _MAYBE)

    def within(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of those that are among the words, and which these are."""
        some = np.flatnonzero(self.maybe[self._slot(words)])
        at = np.minimum(np.searchsorted(self.words, words[some]), len(self.words) - 1)
        same = self.words[at] == words[some]
        return some[same], at[same]


class Keywords:
    """The tokens of a block of queries, looked for in runs of letters and digits.

    The eight bytes from each place of a run are a number: what is no longer is found by its length's numbers alone, and
    only runs that have the first eight bytes of a longer token go through an automaton of these."""

    def __init__(self, block: list[tuple[int, tuple, list[str]]], names: list[str]):
        import ahocorasick

        self.number: dict[str, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for q, (_, _, tokens) in enumerate(block):
            for t in tokens:
                key = (self.number.setdefault(t, len(self.number)), q)
                pairs[key] = pairs.get(key, 0) + 1
        self.ids = np.array([q for q, _, _ in block], np.int64)
        self.scopes = Scopes([s for _, s, _ in block], names)
        token, query, times = np.array([(*k, n) for k, n in sorted(pairs.items())], np.int64).reshape(-1, 3).T
        self.query, self.times, self.first = query, times, np.searchsorted(token, np.arange(len(self.number) + 1))
        self.single = {t: i for t, i in self.number.items() if not t.isascii()}
        plain = {t.encode(): i for t, i in self.number.items() if t.isascii()}
        self.short: list[tuple[int, Words, np.ndarray]] = []
        for size in sorted({len(t) for t in plain if len(t) <= 8}):
            own = {int.from_bytes(t, "little"): i for t, i in plain.items() if len(t) == size}
            self.short.append((size, Words([t for t in plain if len(t) == size]), np.array([own[w] for w in sorted(own)], np.int64)))
        self.automaton = ahocorasick.Automaton()
        for t, i in plain.items():
            if len(t) > 8:
                self.automaton.add_word(t.decode(), i)
        self.automaton.make_automaton()
        self.long = Words([t[:8] for t in plain if len(t) > 8]) if len(self.automaton) else None

    def _within(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(run, token) of the ASCII tokens that runs contain, by run."""
        ends = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1]
        data = np.frombuffer(runs.buffers()[2], np.uint8) if runs.buffers()[2] is not None else np.zeros(0, np.uint8)
        found, at = [], 0
        while at < len(runs):
            stop = min(max(int(np.searchsorted(ends, int(ends[at]) + RUN_BYTES, side="right")) - 1, at + 1), len(runs))
            sizes = np.diff(ends[at : stop + 1])
            run = np.repeat(np.arange(at, stop), sizes)
            left = np.repeat(ends[at + 1 : stop + 1], sizes) - np.arange(ends[at], ends[stop])
            words = np.zeros(len(run) + 8, np.uint64)
            words[: len(run)] = data[ends[at] : ends[stop]]
            for n in (1, 2, 4):
                words[:-n] |= words[n:] << np.uint64(8 * n)
            words = words[: len(run)]
            for size, own, tokens in self.short:
                places, which = own.within(words & np.uint64((1 << 8 * size) - 1))
                whole = left[places] >= size
                found.append((run[places[whole]], tokens[which[whole]]))
            if self.long is not None:
                places, _ = self.long.within(words)
                some = np.unique(run[places[left[places] > 8]])
                more = [(r, i) for r, t in zip(some.tolist(), runs.take(pa.array(some)).to_pylist()) for _, i in self.automaton.iter(t)]
                found.append(tuple(np.array(more, np.int64).reshape(-1, 2).T))
            at = stop
        run, token = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        by = np.argsort(run)
        return run[by], token[by]

    def held(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(document, token) of what small-letter texts contain, each once."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        lists = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(_TOKEN[raw])), " ")
        coded = lists.values.dictionary_encode()
        run, tokens = self._within(coded.dictionary)
        each = np.bincount(run, minlength=len(coded.dictionary))
        first, runs = np.cumsum(each) - each, coded.indices.to_numpy(zero_copy_only=False)
        some = np.flatnonzero(each[runs])
        doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[some]
        n, many = each[runs[some]], max(1, len(self.number))
        there = np.zeros(len(texts) * many, bool)
        for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(n) // RUN_BYTES)) + 1):
            own = n[part]
            at = np.repeat(first[runs[some[part]]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            there[np.repeat(doc[part] * many, own) + tokens[at]] = True
        if self.single:
            for d, t in enumerate(texts.to_pylist()):
                if not t.isascii():
                    there[[d * many + self.single[c] for c in set(t) & self.single.keys()]] = True
        return np.divmod(np.flatnonzero(there), many)

    def score(self, batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.ids), top)
        for part in pieces(batches if len(self.ids) else iter(()), "text", max(1, min(KEYWORD_SCORES // max(1, len(self.ids)), HELD // max(1, len(self.number))))):
            doc, token = self.held(part.column("text"))
            first, each = self.first[token], self.first[token + 1] - self.first[token]
            scores = summed(doc, first, each, np.ones(len(doc), np.int64), self.query, self.times, (part.num_rows, len(self.ids)))
            for scope, seen in self.scopes.seen(part):
                if seen is not None:
                    scores[np.ix_(~seen, self.scopes.of == scope)] = 0
            ids = part.column("doc_id").to_numpy()
            rows, qs = best_of_batch(scores, ids, top, least=0)
            best.add(qs, ids[rows], scores[rows, qs])
        yield best.rows(self.ids)
