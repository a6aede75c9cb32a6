"""Table functions for SQL: a text's terms by a tokenizer that is named in the statement."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .text import split_tokens

TOKENIZERS: dict[str, Callable[[str], list[str]]] = {"bm25": split_tokens, "whitespace": lambda text: text.lower().split()}


def register(spark: SparkSession, name: str = "term_counts", **tokenizers: Callable[[str], list[str]]) -> None:
    """Make ``SELECT * FROM term_counts(TABLE(docs), 'bm25')`` known to the session, with further tokenizers by name.

    The table argument has ``doc_id`` and ``text``; a row comes back for each text and term: doc_id, term, tf (how often
    the text has it), dl (its number of tokens). A null text has no term; a tokenizer that is not known is an error.
    A text is one call, so a table may be dealt in any way (or by ``PARTITION BY`` where a tokenizer needs it)."""
    known = TOKENIZERS | tokenizers

    class TermCounts:
        def eval(self, row: Row, tokenizer: str) -> Iterator[tuple[int, str, int, int]]:
            if tokenizer not in known:
                raise ValueError(f"no tokenizer {tokenizer}: one of {', '.join(sorted(known))}")
            found = known[tokenizer](row["text"] or "")
            for term, times in Counter(found).items():
                yield row["doc_id"], term, times, len(found)

    spark.udtf.register(name, udtf(TermCounts, returnType="doc_id long, term string, tf int, dl int"))
