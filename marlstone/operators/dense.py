"""The dense channel: exact cosine search in blocks, and upkeep of stored vectors."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import DIGITS, ranked
from ..functions.vectors import norm, unit
from . import scope as scopes
from .lexical import Best, Scopes, best_of_batch

# Inputs and characters of an embedding batch, and batches of a call.
BATCH_INPUTS, BATCH_CHARS, BATCHES = 64, 16_000, 8
# Characters of an input, seconds after a failed batch, milliseconds without a service that fails.
INPUT_CHARS, WAIT, COOLDOWN_MS = 8000, 0.5, 60_000
VECTOR_COLUMNS = ("id", "model", "hash", "vec", "dims", "normalized")
#: Scores of a task's matrix at a time.
SCORES = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, straight from the column's buffer."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten()
    if column.null_count or flat.null_count or len(flat) % len(column):
        raise ValueError("vectors must be there, without nulls, and of one length")
    ends = column.offsets.to_numpy()
    if (np.diff(ends) != len(flat) // len(column)).any():
        raise ValueError("vectors must be of one length")
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_search(queries: DataFrame, vectors: DataFrame, top: int = 10, positive: bool = False, block_bytes: int = 16 << 20, scope: list[str] | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the nearest vectors of each query.

    ``queries``: query_id, vec; ``vectors``: doc_id, vec; both with the columns of ``scope``. Queries are read in blocks
    of bounded size; each batch of vectors is one matrix product with a block and keeps its best rows of each query, so
    no pair is ever a row. ``positive``: only scores above zero. A query sees the vectors of its scope alone, by the
    rule of `scope`, and one scan serves all scopes. Rows without an id or a vector are left out on both sides.
    """
    found, names = None, scope or []
    asked = queries.filter("query_id IS NOT NULL AND vec IS NOT NULL").select("query_id", "vec", *scopes.asked(names))
    rows = vectors.filter("doc_id IS NOT NULL AND vec IS NOT NULL").select("doc_id", "vec", *[F.col(c).cast("string").alias(c) for c in names])
    size = asked.agg(F.sum(F.size("vec") * 8 + 16)).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for b in range(n):
        part = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        hits = rows.mapInArrow(_scan(part.toPandas(), names, top, positive), "query_id long, doc_id long, score double")
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, ["query_id"], top=top)


def _scan(block: pd.DataFrame, names: list[str], top: int, positive: bool):
    ids, targets = block["query_id"].to_numpy(np.int64), [np.asarray(v, np.float64) for v in block["vec"]]
    wanted = [tuple(None if pd.isna(v) else v for v in row) for row in zip(*(block[c] for c in names))] if names else [()] * len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = _units(np.stack(targets)) if targets else np.zeros((0, 0))
        step = max(1, SCORES // max(1, len(ids)))
        own, best = Scopes(wanted, names), Best(len(ids), top)
        for part in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step) if len(ids)):
            docs = part.column("doc_id").to_numpy()
            scores = np.round(_units(_matrix(part.column("vec"))) @ against.T, DIGITS) + 0.0
            for number, seen in own.seen(part):
                if seen is not None:
                    scores[np.ix_(~seen, own.of == number)] = -np.inf
            rows, qs = best_of_batch(scores, docs, top, least=0 if positive else -np.inf)
            best.add(qs, docs[rows], scores[rows, qs])
        yield best.rows(ids)

    return run


def normalised(vectors: DataFrame) -> DataFrame:
    """Stored once as unit vectors, a search needs no norms."""
    return vectors.withColumns({"vec": unit(F.col("vec")), "normalized": F.lit(True)})


def norms(vectors: DataFrame) -> DataFrame:
    return vectors.select("doc_id", norm(F.col("vec")).alias("norm"))


def targets(corpus: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Live rows (id, memory, hash) without a vector of this model and this text."""
    known = vectors.filter(F.col("model") == model).select("id", F.col("hash").alias("known"))
    rows = corpus.select("id", "memory", F.sha1("memory").alias("hash")).join(known, "id", "left")
    return rows.filter(~F.col("hash").eqNullSafe(F.col("known"))).drop("known")


def pruned(vectors: DataFrame, corpus: DataFrame, model: str) -> DataFrame:
    """The vectors that stay: of this model, and with a live row."""
    return vectors.filter(F.col("model") == model).join(corpus.select("id"), "id", "left_semi")


def packed(rows: DataFrame, inputs: int = BATCH_INPUTS, chars: int = BATCH_CHARS, batches: int = BATCHES) -> DataFrame:
    """(id, batch) of a call's batches, filled greedily in order of id.

    A batch closes at ``inputs`` rows or when the next would pass ``chars`` characters. A call has a fixed number of
    batches, so it can use no more than batches * inputs rows: only these meet, in one small array.
    """
    first = rows.select("id", F.char_length("memory").alias("n")).orderBy("id").limit(inputs * batches)
    ordered = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("rows"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("count"), F.lit(0).alias("used"), F.array().cast("array<struct<id:bigint,batch:int>>").alias("out"))

    def put(s, r):
        new = (s["count"] == 0) | (s["count"] >= inputs) | (s["used"] + r["n"] > chars)
        batch = F.when(new & (s["count"] > 0), s["batch"] + 1).otherwise(s["batch"])
        placed = F.struct(r["id"].cast("long").alias("id"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), F.when(new, 1).otherwise(s["count"] + 1).alias("count"), F.when(new, r["n"]).otherwise(s["used"] + r["n"]).alias("used"), F.concat(s["out"], F.array(placed)).alias("out"))

    folded = ordered.select(F.explode(F.aggregate("rows", zero, put)["out"]).alias("r")).select("r.id", "r.batch")
    return folded.filter(F.col("batch") < batches)


EMBEDDED = "id long, model string, hash string, vec array<double>, dims int, normalized boolean, batch long, error string"


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, inputs: int = BATCH_INPUTS, chars: int = BATCH_CHARS, attempts: int = 1, wait: float = WAIT) -> DataFrame:
    """(id, model, hash, vec, dims, normalized, batch, error) of rows (id, memory), all of them in one pass.

    Each task packs its own rows into batches, closed by the rule of ``packed``, and holds one batch at a time. A batch
    fails if the service does, or if it answers with another number of vectors, with empty or with uneven ones; it is
    tried ``attempts`` times, ``wait`` seconds apart, and its rows then have the error and no vector. Rows without a
    text have no vector to get and are left out. Write the result before using it twice: every use asks the service."""

    def asked(texts: list[str]) -> tuple[np.ndarray | None, str | None]:
        error = None
        for n in range(attempts):
            if n:
                time.sleep(wait)
            try:
                vectors = embed([t[:INPUT_CHARS] for t in texts])
                if len(vectors) != len(texts) or len({len(v) for v in vectors}) != 1 or not len(vectors[0]):
                    raise ValueError("malformed response body")
                return _units(np.asarray(vectors, np.float64)), None
            except Exception as failure:  # the service is not ours: whatever it raises fails this batch alone
                error = str(failure) or type(failure).__name__
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32

        def done(ids: list, texts: list[str], number: int) -> pa.RecordBatch:
            vectors, error = asked(texts)
            n = len(ids)
            vec = [None] * n if vectors is None else list(vectors)
            columns = {
                "id": pa.array(ids, pa.int64()),
                "model": pa.array([model] * n, pa.string()),
                "hash": pa.array([hashlib.sha1(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string()),
                "vec": pa.array(vec, pa.list_(pa.float64())),
                "dims": pa.array([None if vectors is None else vectors.shape[1]] * n, pa.int32()),
                "normalized": pa.array([vectors is not None] * n, pa.bool_()),
                "batch": pa.array([first + number] * n, pa.int64()),
                "error": pa.array([error] * n, pa.string()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        ids, texts, used, number = [], [], 0, 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("memory").to_pylist()):
                if ids and (len(ids) >= inputs or used + len(text) > chars):
                    yield done(ids, texts, number)
                    ids, texts, used, number = [], [], 0, number + 1
                ids.append(i)
                texts.append(text)
                used += len(text)
        if ids:
            yield done(ids, texts, number)

    return rows.filter("memory IS NOT NULL").select(F.col("id").cast("long").alias("id"), "memory").mapInArrow(run, EMBEDDED)


def progress(fresh: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of a pass (``embedded``) over the targets of a corpus: embedded, batches, failed_batches, remaining,
    corpus, first_error (by batch), and the health that follows, for ``COOLDOWN_MS`` if it is ``persistent``.

    Health: ``none`` without a failed batch, ``persistent`` if all failed, else ``partial``."""
    failed = F.col("error").isNotNull()
    one = fresh.agg(
        F.count_if(~failed).alias("embedded"),
        F.count_distinct("batch").alias("batches"),
        F.count_distinct(F.when(failed, F.col("batch"))).alias("failed_batches"),
        F.count_if(failed).alias("remaining"),
        F.min_by(F.when(failed, F.col("error")), F.when(failed, F.col("batch"))).alias("first_error"),
    )
    health = F.when(F.col("failed_batches") == 0, "none").when(F.col("failed_batches") >= F.col("batches"), "persistent").otherwise("partial")
    return one.crossJoin(corpus.agg(F.count(F.lit(1)).alias("corpus"))).withColumn("health", health)


def upkeep(vectors: DataFrame, corpus: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, passes: int = 8, **limits) -> tuple[DataFrame, list[dict]]:
    """(vectors after upkeep, the progress of each pass): until no live row (id, memory) lacks a vector of this model
    and its text, or all batches of a pass fail, or ``passes`` are over.

    Vectors that were stored as they came become unit vectors; those of another model and of rows that are gone go. A
    pass embeds all that remains, spread over the tasks, and what it got is written before the next, so a failure
    costs its own batches only."""
    from ..sources.tables import written

    have, report = written(pruned(migrated(vectors), corpus, model).select(*VECTOR_COLUMNS), "vectors"), []
    for _ in range(passes):
        fresh = written(embedded(targets(corpus, have, model), embed, model, **limits), "embedded")
        report.append(progress(fresh, corpus).first().asDict())
        if report[-1]["embedded"]:
            have = written(maintained(have, fresh, corpus, model), "vectors")
        if report[-1]["health"] == "persistent" or not report[-1]["remaining"]:
            break
    return have, report


def migrated(vectors: DataFrame) -> DataFrame:
    """Vectors of unit length, also those that were stored before this was done on writing."""
    done = F.coalesce("normalized", F.lit(False))
    return vectors.withColumns({"vec": F.when(done, F.col("vec")).otherwise(unit(F.col("vec"))), "normalized": F.lit(True)})


def maintained(vectors: DataFrame, fresh: DataFrame, corpus: DataFrame, model: str) -> DataFrame:
    """Stored vectors after a call: pruned, another model's wiped, new ones in place of old; what failed changes nothing."""
    fresh = fresh.filter("vec IS NOT NULL")
    kept = pruned(vectors, corpus, model).join(fresh.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.select(*vectors.columns))


def coverage(vectors: DataFrame, corpus: DataFrame, model: str) -> DataFrame:
    own = vectors.filter(F.col("model") == model).agg(F.count(F.lit(1)).alias("vectors"))
    left = targets(corpus, vectors, model).agg(F.count(F.lit(1)).alias("remaining"))
    return corpus.agg(F.count(F.lit(1)).alias("corpus")).crossJoin(own).crossJoin(left)


def first_of_text(queries: DataFrame) -> DataFrame:
    """One row of each distinct query text, so that none is embedded twice."""
    order = Window.partitionBy("text").orderBy("query_id")
    return queries.withColumn("at", F.row_number().over(order)).filter("at = 1").drop("at")


def cache_key(text: Column) -> Column:
    """The key of a text in a cache of embeddings."""
    return F.substr(F.sha2(text, 256), F.lit(1), F.lit(16))


def from_cache(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(known, missing) of texts (text): with the vector of this model's cache (key, model, vec), and each distinct other."""
    keyed = texts.select("text").distinct().withColumn("key", cache_key(F.col("text")))
    own = cache.filter(F.col("model") == model).select("key", "vec")
    return keyed.join(own, "key"), keyed.join(own.select("key"), "key", "left_anti")


def cold_cost(texts: DataFrame, cache: DataFrame, model: str, price: float, chars_per_token: float = 3.5) -> DataFrame:
    """One row before a run: texts, mean_chars, unique_texts, uncached, tokens that these are about, and what a million
    of them cost at ``price``."""
    _, missing = from_cache(texts, cache, model)
    every = texts.agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg(F.char_length("text")), 1).alias("mean_chars"), F.count_distinct(cache_key(F.col("text"))).alias("unique_texts"))
    tokens = F.coalesce(F.sum(F.char_length("text")), F.lit(0)) / chars_per_token
    left = missing.agg(F.count(F.lit(1)).alias("uncached"), F.round(tokens, 3).alias("tokens"), F.round(tokens / 1e6 * price, 9).alias("cost"))
    return every.crossJoin(left)
