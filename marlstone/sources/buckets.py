"""A store in hash buckets: a save rewrites the buckets that it touches.

Rows go to buckets by a hash of their id. A version is one small file that names, for each bucket that has rows, the
folder that holds them. A save merges its rows with the buckets they fall into, writes these to a folder of its own, and
commits the next version: the current one with its buckets in place of the old. If another session came first, only
buckets that both wrote are merged again; else the version is made anew from theirs, and nothing is written twice.

What a version names is never changed, so readers keep what they began with. ``drop_old`` deletes what versions before
the last ``keep`` alone name.

Cases: a null id has a bucket like any other; saving no rows makes no version; an absent store is empty. The number of
buckets is fixed by the first save.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import STORE_SCHEMA, _commits, _fs, _path, empty

BUCKETS = 256


class Version:
    """Number, buckets in all, and the folder of each bucket that has rows."""

    def __init__(self, number: int, buckets: int, folders: dict[int, str]):
        self.number, self.buckets, self.folders = number, buckets, folders


def current(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Version:
    fs, path = _fs(spark, folder), _path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()] if fs.exists(path) else []
    number = max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)
    return _version(spark, folder, number) if number else Version(0, buckets, {})


def _version(spark: SparkSession, folder: str, number: int) -> Version:
    stream = _fs(spark, folder).open(_path(spark, f"{folder}/v{number}"))
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    found = json.loads(text)
    return Version(number, found["buckets"], {int(k): v for k, v in found["folders"].items()})


def load(spark: SparkSession, folder: str, schema: str = STORE_SCHEMA, only: set[int] | None = None, version: Version | None = None) -> DataFrame:
    """The rows of a version (default: the current one), or of some of its buckets."""
    at = version or current(spark, folder)
    paths = [f"{folder}/{data}/bucket={b}" for b, data in sorted(at.folders.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else empty(spark, schema)


def bucket_of(buckets: int, id_col: str = "id"):
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int")


def save(mine: DataFrame, folder: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str = STORE_SCHEMA, id_col: str = "id", buckets: int = BUCKETS) -> tuple[int, int]:
    """Merge the rows of a session (``merge(mine, disk)``, by id) into the store: the version that has them, and how many
    buckets were written for it."""
    spark, wrote = mine.sparkSession, 0
    base = current(spark, folder, buckets)
    own = mine.withColumn("bucket", bucket_of(base.buckets, id_col))
    left = touched = {r.bucket for r in own.select("bucket").distinct().collect()}  # no more than there are buckets
    if not touched:
        return base.number, 0
    folders: dict[int, str] = {}
    while True:
        data = f"data-{uuid.uuid4().hex}"
        part = own.filter(F.col("bucket").isin(sorted(left))).drop("bucket")
        rows = merge(part, load(spark, folder, schema, left, base)).withColumn("bucket", bucket_of(base.buckets, id_col))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{data}")
        wrote += len(left)
        folders |= {b: data for b in left if _fs(spark, folder).exists(_path(spark, f"{folder}/{data}/bucket={b}"))}
        while True:
            kept = {b: f for b, f in base.folders.items() if b not in touched}
            if _committed(spark, folder, Version(base.number + 1, base.buckets, kept | folders)):
                return base.number + 1, wrote
            theirs = current(spark, folder, base.buckets)
            left = {b for b in touched if theirs.folders.get(b) != base.folders.get(b)}
            base = theirs
            if left:  # both wrote these: merge them again, with what came first
                folders = {b: f for b, f in folders.items() if b not in left}
                break


def _committed(spark: SparkSession, folder: str, version: Version) -> bool:
    """Whether this became the version of its number: its file is written whole and renamed, which fails if there is one."""
    fs, marker, draft = _fs(spark, folder), _path(spark, f"{folder}/v{version.number}"), _path(spark, f"{folder}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.writeBytes(json.dumps({"buckets": version.buckets, "folders": version.folders}))
    out.close()
    with _commits:
        done = not fs.exists(marker) and fs.rename(draft, marker)
    if not done:
        fs.delete(draft, False)
    return done


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete versions before the last ``keep`` and the folders that none of these names; how many folders. Call it when no
    save is under way: the folder of a save that has not committed yet is named by nobody."""
    fs, last = _fs(spark, folder), current(spark, folder).number
    numbers = range(max(1, last - keep + 1), last + 1)
    named = {data for n in numbers for data in _version(spark, folder, n).folders.values()}
    gone = 0
    for status in fs.listStatus(_path(spark, folder)):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in named:
            gone += fs.delete(status.getPath(), True)
        elif name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in numbers:
            fs.delete(status.getPath(), False)
    return gone
