"""Text functions as column expressions: tokenizers, buckets, noise, size caps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The scripts that are cut into bigrams, and the size caps.
EVAL_CJK = r"一-鿿぀-ヿ가-힯"
CJK = r"㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
MAX_CHARS = 4000
MAX_POOL_CHARS = 1200


def tokens(text: Column, cjk: str = CJK) -> Column:
    """Lower-cased Latin runs whole, runs of ``cjk`` as overlapping bigrams, a lone character of these alone."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"([a-z0-9_]+|[{cjk}]+)"), F.lit(1))
    bigrams = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    cut = lambda r: F.when(r.rlike("^[a-z0-9_]") | (F.length(r) == 1), F.array(r)).otherwise(bigrams(r))
    # Without CJK text a run is a token: no function need be applied to each.
    return F.when(low.rlike(f"[{cjk}]"), F.flatten(F.transform(runs, cut))).otherwise(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)))


def token_count(text: Column) -> Column:
    """The number of ``tokens`` without making them where that is possible."""
    low = F.lower(text)
    return F.when(low.rlike(f"[{CJK}]"), F.size(tokens(text))).otherwise(F.regexp_count(low, F.lit("[a-z0-9_]+")))


_RUN = re.compile(f"[a-z0-9_]+|[{CJK}]+")
_PLAIN = re.compile("[a-z0-9_]+")
_CJK = re.compile(f"[{CJK}]")


def split_tokens(text: str) -> list[str]:
    """The same tokens in Python, for operators that work through whole batches."""
    low = text.lower()
    if not _CJK.search(low):
        return _PLAIN.findall(low)
    out: list[str] = []
    for run in _RUN.findall(low):
        if len(run) == 1 or _PLAIN.match(run):
            out.append(run)
        else:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def keyword_tokens(text: Column) -> Column:
    """Latin runs, and every CJK or full-width character alone; repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+|[一-鿿＀-￯])"), F.lit(1))


def clamped(text: Column, most: int = MAX_CHARS) -> Column:
    return F.when(F.char_length(text) > most, F.substr(text, F.lit(1), F.lit(most))).otherwise(text)


def overflow(text: Column, most: int = MAX_CHARS) -> Column:
    """(originalChars, truncatedAt) of a text over the cap, else null."""
    record = F.struct(F.char_length(text).cast("long").alias("originalChars"), F.lit(most).cast("long").alias("truncatedAt"))
    return F.when(F.char_length(text) > most, record)


# Fixed value: the characters that trimming takes off.
BLANK = r"[\x09-\x0D\x20\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trimmed(text: Column) -> Column:
    """Without any white space at its ends, not only spaces."""
    return F.regexp_replace(text, f"^{BLANK}+|(?<!{BLANK}){BLANK}+$", "")


def length_bucket(query: Column) -> Column:
    n = F.char_length(trimmed(query))
    return F.when(n == 0, "empty").when(n <= 8, "<=8").when(n <= 24, "9-24").otherwise(">24")


def query_shape(query: Column) -> Column:
    """What a retriever can take from a query: terse-cjk, mixed, cjk-only or latin."""
    q = trimmed(query)
    cjk, latin = F.regexp_count(q, F.lit(r"[一-鿿]")), F.regexp_count(q, F.lit("[a-zA-Z0-9]+"))
    return F.when((F.char_length(q) <= 12) & (latin <= 1), "terse-cjk").when((cjk > 0) & (latin > 0), "mixed").when(cjk > 0, "cjk-only").otherwise("latin")


def is_noise(query: Column, least: int = 8, most: int = 400) -> Column:
    """Strings that are no questions: pastes, paths, commands, payloads, logs, dispatch prompts."""
    q = trimmed(query)
    bare = trimmed(F.regexp_replace(q, "^['\"`]|['\"`]$", ""))
    # The patterns.
    return (
        ~F.char_length(q).between(least, most)
        | (bare.rlike(r"^(/|[A-Za-z]:\\|~/)") & ~bare.rlike(r"\s"))
        | bare.rlike(r"^(/|[A-Za-z]:\\|~/)\S*\.[A-Za-z0-9]{1,5}$")
        | q.rlike(r"waveterm_paste|/var/folders")
        | bare.rlike(r"^/\S+$")
        | q.rlike(r"^[\s\p{P}\p{S}]+$")
        | (bare.rlike(r"^[{\[]") & bare.rlike(r"[}\]]$"))
        | (bare.rlike(r"^\[") & bare.rlike(r"[~/]\.?\w+/"))
        | (q.rlike(r"(?i)\b(error|warning|traceback|stack trace|enclosing|at line \d+)\b") & q.rlike("[~/]"))
        | (q.rlike(r"^\s*\d+\.") & (F.regexp_count(q, F.lit(r"\d+\.")) >= 4))
        | bare.rlike(r"^Task:\s")
        | bare.rlike(r"(?i)^\s*You are (an?|the)\b.*(lane|agent|researcher)")
        | bare.rlike(r"(?i)^Reply with exactly\b")
    )


def text_hash(text: Column) -> Column:
    return F.sha1(text)


def scope_label(scope: Column) -> Column:
    """Sorted ``key=value`` joined by spaces, or ``unscoped``."""
    pairs = F.transform(F.array_sort(F.map_entries(scope)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.when(scope.isNull() | (F.size(scope) == 0), F.lit("unscoped")).otherwise(F.array_join(pairs, " "))


def clamped_utf16(text: Column) -> Column:
    """The cap in UTF-16 units, never inside a surrogate pair: for texts beyond the basic plane, where the built-in
    functions count characters. A half pair at the cut goes."""

    def cut(texts: pd.Series) -> pd.Series:
        within = lambda t: t is None or len(t) <= MAX_CHARS // 2
        return texts.map(lambda t: t if within(t) else t.encode("utf-16-le", "surrogatepass")[: 2 * MAX_CHARS].decode("utf-16-le", "ignore"))

    return F.pandas_udf(cut, T.StringType())(text)
