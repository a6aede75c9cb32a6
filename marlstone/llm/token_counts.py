"""Operator 5: token counts of a unigram tokenizer, without its tokens.

The vocabulary is that of a public model file: its pieces and their scores, read
as a unigram model with byte fallback over words that begin with the mark. An
Aho-Corasick automaton enumerates the pieces that end at each character of a
word; dynamic programming carries the best score and the number of pieces of
the best path, and no path is ever traced back.

Tie rules are the tokenizer's: scores are doubles, sums run from the left, a
later candidate replaces a former only if strictly greater, and at one end the
candidates come by ascending start (so the longest piece of equals wins); a
character without a piece of its own may be unknown, at the least score less
10, and counts one token for each of its bytes.

Words are independent, so each distinct word of a batch is counted once, in a
table of bounded size that a task keeps; counts are summed by position.

Cases: null counts as empty, which has 0 tokens; a text of spaces has the tokens
of its marks; whole texts of any length are taken; repeated rows give equal
rows; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import by_bytes, id_text, offsets_of, texts_of

MARK = "▁"
#: Cost of an unknown character beside the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Distinct words kept by a task; beyond it the table starts anew.
TABLE_WORDS = 400_000
_CUT = "\x01"
_loaded: dict[str, "Unigram"] = {}


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece model file and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not special(i)]


class Unigram:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        if any(MARK in piece[1:] and piece.strip(MARK) for piece, _ in pieces):
            raise ValueError("a piece crosses the start of a word: words are not independent")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces on the best path through one word."""
        n = len(word)
        best, pieces = [0.0] + [-np.inf] * n, [0] * (n + 1)
        at, alone = 0, False  # the end that is being decided, and whether its last character is a piece

        def settle(until: int) -> None:
            """Decide the ends up to ``until``: unknown characters are the last candidates of their ends."""
            nonlocal at, alone
            while at < until:
                if at and not alone:
                    score = best[at - 1] + self.unknown
                    if score > best[at]:
                        best[at], pieces[at] = score, pieces[at - 1] + len(word[at - 1].encode())
                at, alone = at + 1, False

        for end, (length, score) in self.automaton.iter(word):
            settle(end + 1)
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], pieces[end + 1] = total, pieces[end + 1 - length] + 1
            alone = alone or length == 1
        settle(n + 1)
        return pieces[n]

    def counts(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) + len(words) > TABLE_WORDS:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = self.count(word)
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: its spaces are marks, and a mark comes before the first character unless it is one."""
        marked = pc.replace_substring(texts, " ", MARK)
        lead = pc.or_(pc.equal(texts, ""), pc.starts_with(marked, MARK))
        whole = pc.if_else(lead, marked, pc.binary_join_element_wise(MARK, marked, ""))
        if pc.any(pc.match_substring(texts, _CUT)).as_py():
            lists = pa.array([re.findall(f"{MARK}[^{MARK}]*", x) for x in whole.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring(whole, MARK, _CUT + MARK), _CUT)
        flat, offsets = lists.flatten(), offsets_of(lists)
        coded = flat.dictionary_encode()
        each = self.counts(coded.dictionary.to_pylist())
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])]) if len(flat) else np.zeros(1, np.int64)
        offsets = offsets - offsets[0]
        return total[offsets[1:]] - total[offsets[:-1]]


def unigram(model_path: str) -> Unigram:
    if model_path not in _loaded:
        _loaded[model_path] = Unigram(vocabulary(model_path))
    return _loaded[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(model_path)
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.count_texts(texts_of(batch)))], ["doc_id", "n_tokens"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
