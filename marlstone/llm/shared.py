"""What the operators share: shared-folder tables, column selection and Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
#: Paths handed out within the scopes that are open, the innermost last.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting (as tests do); it then gets
    a temporary folder, since all its threads share one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _own_dir[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths that operators write to while the scope is open, for ``remove`` once nothing reads them."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete written tables; one that is gone already is no error."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there,
    and a lost executor costs no recomputation of what lies before."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ascii_squeezed(text: Column | str) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACES, " ")


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that memory follows neither
    the rows of a batch nor (a single row apart) the length of texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(offsets_of(batch.column(column)))
        groups = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Offsets of a string, binary or list array (as int64), its slice taken into account."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) or pa.types.is_large_list(array.type)
    kind = np.int64 if wide else np.int32
    buffer = array.buffers()[1]
    if buffer is None:
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(buffer, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts as a plain string array without nulls (null: empty)."""
    found = batch.column(column)
    if not pa.types.is_string(found.type):
        found = found.cast(pa.string())
    return found.fill_null("") if found.null_count else found


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its values in them."""
    offsets = offsets_of(array)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


SPACE_RE = re.compile(SPACES)


def released(result=None):
    """The result, after memory that is free was given back: a worker serves many stages, and an executor's memory is
    shared by all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it gives memory back by rules of its own
        pass
    return result
