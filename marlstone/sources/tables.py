"""Tables on any file system that Spark reads."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STORE_SCHEMA = "id string, memory string, created_at string, updated_at string, deleted boolean, source string, user_id string, agent_id string, app_id string, run_id string, overflow struct<originalChars:bigint,truncatedAt:bigint>"
VECTOR_SCHEMA = "id string, model string, hash string, vec array<double>, dims int, normalized boolean"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows from a folder that driver and executors share: computed once, however often they are read."""
    from ..streaming.runs import folder

    path = f"{folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def empty(spark: SparkSession, schema: str = STORE_SCHEMA) -> DataFrame:
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, folder: str, schema: str = STORE_SCHEMA, tolerant: bool = False) -> DataFrame:
    """The current version of a versioned table; an absent one is empty. ``tolerant``: files that can't be read count
    as absent (do not save what was loaded so: their rows would go for good)."""
    return _read(spark, folder, _version(spark, folder), schema, tolerant)


def save(df: DataFrame, folder: str) -> int:
    """A new version in place of all before, and its number; a failed write leaves the one before current, and its
    readers keep it."""
    data = _staged(df, folder)
    while not _committed(df.sparkSession, folder, data, version := _version(df.sparkSession, folder) + 1):
        pass
    return version


def save_merged(mine: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str = STORE_SCHEMA) -> int:
    """A new version that holds ``mine`` merged with the current one (``merge(mine, disk)``), and its number.

    Sessions may save at once: a version is committed only as the successor of the one it was merged with, else it
    is merged again with the one that came first, so no session's rows are lost and one of them always gets on."""
    spark = mine.sparkSession
    while True:
        base = _version(spark, folder)
        data = _staged(merge(mine, _read(spark, folder, base, schema)), folder)
        if _committed(spark, folder, data, base + 1):
            return base + 1
        _fs(spark, folder).delete(_path(spark, f"{folder}/{data}"), True)


#: Of the threads of this process one commits at a time; between processes the file system decides.
_commits = threading.Lock()


def _staged(df: DataFrame, folder: str) -> str:
    """The name of a folder of the rows that no version has yet."""
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{data}")
    return data


def _committed(spark: SparkSession, folder: str, data: str, version: int) -> bool:
    """Whether ``version`` became that folder: its marker is written whole and renamed, which fails if there is one
    (on HDFS in one step; a file system that only looks first can let two pass in the same instant)."""
    fs, marker, draft = _fs(spark, folder), _path(spark, f"{folder}/v{version}"), _path(spark, f"{folder}/_draft-{data}")
    out = fs.create(draft, False)
    out.writeBytes(data)
    out.close()
    with _commits:
        done = not fs.exists(marker) and fs.rename(draft, marker)
    if not done:
        fs.delete(draft, False)
    return done


def _version(spark: SparkSession, folder: str) -> int:
    """The newest version, 0 if there is none."""
    fs, path = _fs(spark, folder), _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()] if fs.exists(path) else []
    return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)


def _read(spark: SparkSession, folder: str, version: int, schema: str, tolerant: bool = False) -> DataFrame:
    if not version:
        return empty(spark, schema)
    marker = _fs(spark, folder).open(_path(spark, f"{folder}/v{version}"))
    data = marker.readLine()
    marker.close()
    return spark.read.schema(schema).option("ignoreCorruptFiles", tolerant).parquet(f"{folder}/{data}")


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, folder: str):
    return _path(spark, folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
