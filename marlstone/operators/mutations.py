"""Mutation logs: offline writes, the merge of two copies, the operation log and its replay.

Rows of a store: id, memory, created_at, updated_at, deleted, source, overflowed, and what else a caller carries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text

OPS_DONE_MOST = 500
RETIRE_AFTER = 3
BACKOFF_MS = 3_600_000


def op_key(kind: Column, memory_id: Column, query: Column, at: Column) -> Column:
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", none(kind), none(memory_id), none(query), none(at))


def instant(iso: Column) -> Column:
    """Milliseconds of an ISO time; one that can't be read is older than any."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(iso)), F.lit(-(2**63)))


def merged(mine: DataFrame, disk: DataFrame, wiped: bool = False) -> DataFrame:
    """Two copies of a store into one, by id. ``at``: milliseconds; ``deleted``, ``overflowed``: boolean.

    In order: only one side has it; mine was cut to size and theirs was not; my tombstone is no older than their
    live row; their tombstone stands against my live row, whatever its age; the newer; at a tie my tombstone, else
    theirs. After a wipe the disk's side is ignored."""
    if wiped:
        return mine
    m, d = mine.alias("m"), disk.alias("d")
    flag = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(False))
    take_mine = (
        F.when(F.col("d.id").isNull(), True)
        .when(F.col("m.id").isNull(), False)
        .when(flag("m", "overflowed") & ~flag("d", "overflowed"), True)
        .when(flag("m", "deleted") & ~flag("d", "deleted") & (F.col("m.at") >= F.col("d.at")), True)
        .when(flag("d", "deleted") & ~flag("m", "deleted"), False)
        .when(F.col("m.at") > F.col("d.at"), True)
        .when(F.col("m.at") < F.col("d.at"), False)
        .otherwise(flag("m", "deleted"))
    )
    both = m.join(d, F.col("m.id") == F.col("d.id"), "full_outer").withColumn("_mine", take_mine)
    return both.select(*[F.when(F.col("_mine"), F.col(f"m.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in mine.columns])


def counters(mine: DataFrame, disk: DataFrame) -> DataFrame:
    """(name, value): the larger of each counter."""
    return mine.unionByName(disk).groupBy("name").agg(F.max("value").alias("value"))


def merged_state(mine: DataFrame, disk: DataFrame, most: int = OPS_DONE_MOST) -> DataFrame:
    """Two copies of everything beside the rows of a store: (part, key, value long), a key of a part once in each copy.

    ``failures``, ``backoff_until``, ``last_attempt_at``, ``reads_blocked_until`` and whatever else: the larger value;
    ``stats``: the larger value of the counters that mine has; ``quarantined``: both, mine where they differ; ``done``:
    likewise, and of these the newest ``most``. A null value counts as absent."""
    sides = mine.select("part", "key", "value", F.lit(True).alias("own")).unionByName(disk.select("part", "key", "value", F.lit(False).alias("own")))
    both = sides.filter("value IS NOT NULL").groupBy("part", "key").agg(F.max("value").alias("largest"), F.max(F.when(F.col("own"), F.col("value"))).alias("mine"))
    unions = F.col("part").isin("quarantined", "done")
    kept = both.filter((F.col("part") != "stats") | F.col("mine").isNotNull())
    values = kept.select("part", "key", F.when(unions, F.coalesce("mine", "largest")).otherwise(F.col("largest")).alias("value"))
    done = newest_done(values.filter("part = 'done'").select("part", F.col("key").alias("op_key"), F.col("value").alias("done_at")), most)
    return values.filter("part <> 'done'").unionByName(done.select("part", F.col("op_key").alias("key"), F.col("done_at").alias("value")))


def loaded(store: DataFrame, now: str) -> DataFrame:
    """A store's rows as a session takes them up: a text over the cap is cut and recorded, and its row is as new as
    ``now``, so that it wins the merge against the copy that was not cut. Rows within the cap keep their record."""
    over = F.col("_cut").isNotNull()
    kind = store.schema["overflow"].dataType
    cut = store.withColumns({"_cut": text.overflow(F.col("memory")), "memory": text.clamped(F.col("memory"))})
    return cut.withColumns({"overflow": F.when(over, F.col("_cut").cast(kind)).otherwise(F.col("overflow")), "updated_at": F.when(over, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_cut")


def without_done(ops: DataFrame, done: DataFrame) -> DataFrame:
    """The operations of a file (with their ``op_key``) that no tombstone (op_key) says are done."""
    return ops.join(done.select("op_key"), "op_key", "left_anti").select(*ops.columns)


def open_ops(mine: DataFrame, disk: DataFrame, done: DataFrame) -> DataFrame:
    """Operations of either copy by ``op_key``, without those that are done."""
    return mine.unionByName(disk).dropDuplicates(["op_key"]).join(done.select("op_key"), "op_key", "left_anti").select(*mine.columns)


def newest_done(done: DataFrame, most: int = OPS_DONE_MOST) -> DataFrame:
    """The newest tombstones of done operations (ties by key): a top-k, no sort of all."""
    return done.orderBy(F.col("done_at").desc(), "op_key").limit(most)


def reconciled(ops: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Operations left once writes are confirmed (memory_id; null: all were deleted)."""
    everything = F.broadcast(confirmed.agg(F.coalesce(F.max(F.col("memory_id").isNull()), F.lit(False)).alias("all")))
    left = ops.crossJoin(everything).filter("NOT all").drop("all")
    return left.join(confirmed.select("memory_id"), "memory_id", "left_anti").select(*ops.columns)


def written(store: DataFrame, writes: DataFrame, compat: bool = False) -> DataFrame:
    """The store after offline writes (kind, memory_id, text, app_id, at), of which each id's last counts.

    An update of an unknown id makes a local row; a delete leaves a tombstone; a delete-all takes the rows of its
    scope (``compat``: every row) that are not written later."""
    per_id = Window.partitionBy("memory_id").orderBy(F.col("at").desc())
    single = writes.filter("kind <> 'delete-all'").withColumn("_n", F.row_number().over(per_id)).filter("_n = 1").select(F.col("memory_id").alias("id"), "kind", "text", F.col("at").alias("w_at"))
    rows = store.join(single, "id", "full_outer")
    known = F.col("created_at").isNotNull()
    update, delete = F.col("kind").isin("update", "add"), F.col("kind") == "delete"
    rows = rows.filter(known | update)
    rows = rows.withColumns(
        {
            "memory": F.when(update, F.substr("text", F.lit(1), F.lit(4000))).otherwise(F.col("memory")),
            "deleted": F.when(delete, True).when(update & ~known, False).otherwise(F.coalesce("deleted", F.lit(False))),
            "source": F.when(known, F.col("source")).otherwise("local"),
            "created_at": F.coalesce("created_at", "w_at"),
            "updated_at": F.when(update | delete, F.col("w_at")).otherwise(F.col("updated_at")),
        }
    )
    wipes = writes.filter("kind = 'delete-all'")
    wipes = wipes.groupBy() if compat else wipes.groupBy("app_id")
    wipes = wipes.agg(F.max("at").alias("wipe_at"))
    rows = rows.crossJoin(F.broadcast(wipes)) if compat else rows.join(wipes, "app_id", "left")
    gone = F.coalesce(F.col("wipe_at") >= F.coalesce("w_at", F.lit(-(2**63))), F.lit(False))
    rows = rows.withColumns({"deleted": F.col("deleted") | gone, "updated_at": F.when(gone, F.col("wipe_at")).otherwise(F.col("updated_at"))})
    return rows.select(*store.columns)


def echoed(store: DataFrame, writes: DataFrame) -> DataFrame:
    """The store after writes that the service confirmed (kind, memory_id, text, at), of which each id's last counts.

    An update sets text and time, and makes an observed row of an unknown id; deletes leave tombstones whose time
    stays; a delete-all takes every row that no later update revives."""
    per_id = Window.partitionBy("memory_id").orderBy(F.col("at").desc())
    single = writes.filter("kind <> 'delete-all'").withColumn("_n", F.row_number().over(per_id)).filter("_n = 1")
    single = single.select(F.col("memory_id").alias("id"), "kind", "text", F.col("at").alias("w_at"))
    wipe = F.broadcast(writes.filter("kind = 'delete-all'").agg(F.max("at").alias("wipe_at")))
    rows = store.join(single, "id", "full_outer").crossJoin(wipe)
    known, update = F.col("created_at").isNotNull(), F.coalesce(F.col("kind") == "update", F.lit(False))
    wiped = F.coalesce(F.col("wipe_at") >= F.coalesce("w_at", "wipe_at"), F.lit(False))
    gone = F.when(update, wiped).otherwise(wiped | F.coalesce(F.col("kind") == "delete", F.lit(False)))
    rows = rows.filter(known | update).withColumns(
        {
            "memory": F.when(update, F.col("text")).otherwise(F.col("memory")),
            "deleted": F.when(gone, True).when(update & ~known, False).otherwise(F.coalesce("deleted", F.lit(False))),
            "source": F.when(known, F.col("source")).otherwise("observed"),
            "created_at": F.coalesce("created_at", "w_at"),
            "updated_at": F.when(update, F.col("w_at")).otherwise(F.col("updated_at")),
        }
    )
    return rows.select(*store.columns)


def replayed(store: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """The store after a replay's confirmed items (kind, id, status).

    An add makes its row observed; an update of what is gone (404) and a delete drop the row; a delete-all drops every
    tombstone."""
    last = done.filter("kind <> 'delete-all'").groupBy("id").agg(F.max_by(F.struct("kind", "status"), F.when(F.col("kind") == "delete", 1).otherwise(0)).alias("_d"))
    wiped = F.broadcast(done.agg(F.coalesce(F.max(F.col("kind") == "delete-all"), F.lit(False)).alias("_wiped")))
    rows = store.join(last, "id", "left").crossJoin(wiped)
    kind, status = F.col("_d.kind"), F.col("_d.status")
    drop = F.coalesce((kind == "delete") | ((kind == "update") & (status == 404)), F.lit(False)) | (F.col("_wiped") & F.coalesce("deleted", F.lit(False)))
    added_ = F.coalesce(kind == "add", F.lit(False))
    rows = rows.filter(~drop).withColumns({"source": F.when(added_, "observed").otherwise(F.col("source")), "updated_at": F.when(added_, F.lit(now)).otherwise(F.col("updated_at"))})
    return rows.select(*store.columns)


def added(writes: DataFrame, new_id: Column) -> DataFrame:
    """Local rows of offline adds (messages, scope as a map, at): contents joined by line ends, or ``(empty)``."""
    text = F.array_join(F.filter(F.transform("messages", lambda m: m["content"]), lambda c: c.isNotNull()), "\n")
    payload = F.map_filter("scope", lambda _, v: v != "*")
    return writes.select(new_id.alias("id"), F.when(text == "", "(empty)").otherwise(text).alias("memory"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(False).alias("deleted"), F.lit("local").alias("source"), payload.alias("add_payload"))


def purged(store: DataFrame) -> DataFrame:
    """Without deletions that the service never knew of."""
    return store.filter(~(F.coalesce(F.col("source") == "local", F.lit(False)) & F.coalesce("deleted", F.lit(False))))


def pending_adds(store: DataFrame, quarantined: DataFrame) -> DataFrame:
    live = store.filter((F.col("source") == "local") & ~F.coalesce("deleted", F.lit(False)))
    return live.join(quarantined.select("id"), "id", "left_anti")


def replay_order(adds: DataFrame, ops: DataFrame) -> DataFrame:
    """(store, position, kind, id, at): each store's adds by creation and operations by time, one queue, adds before
    operations at a tie."""
    both = adds.select("store", F.lit("add").alias("kind"), "id", "at", "seq").unionByName(ops.select("store", F.lit("op").alias("kind"), "id", "at", "seq"))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("store").orderBy("at", "kind", "seq", "id"))).drop("seq")


def with_scope(adds: DataFrame, store: DataFrame) -> DataFrame:
    """Pending adds (add_payload: a map) without any entity key get those of the first row of the store (by ``seq``)
    that is not local and has one."""
    from .ingest import ENTITY_KEYS

    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ENTITY_KEYS)), F.array(*[F.col(k).cast("string") for k in ENTITY_KEYS])), lambda _, v: v.isNotNull() & (v != ""))
    first = store.filter("source <> 'local'").withColumn("_scope", own).filter(F.size("_scope") > 0).agg(F.min_by("_scope", "seq").alias("_scope"))
    has = F.exists(F.map_entries("add_payload"), lambda e: e["key"].isin(*ENTITY_KEYS) & e["value"].isNotNull() & (e["value"] != ""))
    repaired = F.when(~has & F.col("_scope").isNotNull(), F.map_concat(F.map_filter("add_payload", lambda k, _: ~k.isin(*ENTITY_KEYS)), F.col("_scope"))).otherwise(F.col("add_payload"))
    return adds.crossJoin(F.broadcast(first)).withColumn("add_payload", repaired).drop("_scope")


def permanent(status: Column) -> Column:
    """A client error that no repetition mends."""
    return status.between(400, 499) & ~status.isin(401, 403, 404, 408, 429)


def retired(failures: DataFrame, after: int = RETIRE_AFTER) -> DataFrame:
    """(id, at): when an id's permanent failures reach the limit. ``failures``: id, at, seq, status."""
    order = Window.partitionBy("id").orderBy("at", "seq")
    return failures.filter(permanent(F.col("status"))).withColumn("n", F.row_number().over(order)).filter(F.col("n") == after).select("id", "at")


def replay(queue: DataFrame, now_ms: int, after: int = RETIRE_AFTER) -> DataFrame:
    """One run of each store's queue: store, position, kind, id, status and the failures so far, in order.

    (store, position, id, outcome, backoff_until): the run stops at the first transient failure and backs off;
    a permanent failure counts and, at the limit, retires its item; what stands behind a stop waits. An operation
    on something that is already gone (404) has been applied. A store's queue is worked off in order, as a stream:
    its task holds a batch and the counts of ids that failed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, stopped, counts = None, False, {}
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if r.store != store:
                    store, stopped, counts = r.store, False, {}
                backoff = None
                if stopped:
                    outcome = "waiting"
                elif 200 <= r.status < 300 or (r.status == 404 and r.kind == "op"):
                    outcome = "applied"
                elif 400 <= r.status < 500 and r.status not in (401, 403, 404, 408, 429):
                    counts[r.id] = counts.get(r.id, int(r.failures)) + 1
                    outcome = "retired" if counts[r.id] >= after else "failed"
                else:
                    stopped, outcome, backoff = True, "backoff", now_ms + BACKOFF_MS
                out.append((r.store, r.position, r.id, outcome, backoff))
            yield pd.DataFrame(out, columns=["store", "position", "id", "outcome", "backoff_until"])

    ordered = queue.select("store", "position", "kind", "id", "status", "failures").repartition("store").sortWithinPartitions("store", "position")
    return ordered.mapInPandas(run, "store long, position long, id string, outcome string, backoff_until long")
