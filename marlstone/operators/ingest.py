"""Corpus ingest: response envelopes to rows, the size cap, upserts with provenance, the quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

ENTITY_KEYS = ("user_id", "agent_id", "app_id", "run_id")
ITEM = "struct<id:string,memory:string,created_at:string,updated_at:string,user_id:string,agent_id:string,app_id:string,run_id:string>"


def string_field(item: Column, key: str) -> Column:
    """A field only if it is a JSON string; any other type counts as missing."""
    path = f"$.{key}"
    return F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", F.try_variant_get(item, path, "string"))


def harvest(responses: DataFrame, body: str = "body", at: str = "at") -> DataFrame:
    """Rows of response bodies: a JSON array or ``{"results": [...]}``; items need a string id and a string memory.

    One row for each id: of several items the one of the latest ``at``, and of these the last of its answer."""
    parsed = F.try_parse_json(body)
    array = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed).otherwise(F.try_variant_get(parsed, "$.results", "variant"))
    items = responses.select(F.col(at), F.posexplode(F.try_variant_get(array, "$", "array<variant>")).alias("_place", "item"))
    rows = items.select(F.col(at), "_place", *[string_field(F.col("item"), k).alias(k) for k in ("id", "memory", "created_at", "updated_at", *ENTITY_KEYS)])
    rows = rows.filter(F.col("id").isNotNull() & F.col("memory").isNotNull())
    columns = [c for c in rows.columns if c not in ("id", "_place")]
    rows = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(at, "_place")).alias("_last")).select("id", "_last.*")
    now = F.col(at)
    return rows.withColumns({k: F.coalesce(k, now) for k in ("created_at", "updated_at")}).drop(at)


def clamp(rows: DataFrame, text_col: str = "memory", most: int = tx.MAX_CHARS) -> DataFrame:
    """The size cap on a text column, with a record of what was cut."""
    return rows.withColumns({"overflow": tx.overflow(F.col(text_col), most), text_col: tx.clamped(F.col(text_col), most)})


def quarantine(rows: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "memory", most: int = tx.MAX_CHARS) -> DataFrame:
    """New quarantine lines: one for each id whose text is over the cap and that has none yet."""
    over = rows.filter(F.char_length(text_col) > most).dropDuplicates([id_col])
    return over.select(id_col, F.char_length(text_col).cast("long").alias("chars"), text_col).join(known.select(id_col), id_col, "left_anti")


def upsert(store: DataFrame, incoming: DataFrame, id_col: str = "id") -> DataFrame:
    """Incoming rows replace stored ones but for those of local origin; what comes in is observed and live."""
    local = store.filter("source = 'local'").select(id_col)
    fresh = incoming.join(local, id_col, "left_anti").withColumns({"source": F.lit("observed"), "deleted": F.lit(False)})
    return store.join(fresh.select(id_col), id_col, "left_anti").unionByName(fresh.select(*store.columns))


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.coalesce("deleted", F.lit(False)))


def public(rows: DataFrame) -> DataFrame:
    """Without the columns that are the store's own."""
    return rows.drop("deleted", "source")


def prefix_complete(pages: DataFrame, page_size: int, page: str = "page", fetched: str = "fetched", total: str = "total") -> DataFrame:
    """The pages that a paginated pull reads: it stops after a short page or once it has the total."""
    from pyspark.sql import Window

    before = Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((F.col(fetched) < page_size).cast("int")).over(before), F.lit(0)) == 1
    full = F.coalesce(F.sum(fetched).over(before), F.lit(0)) >= F.col(total)
    return pages.withColumns({"_stop": stopped | (full & (F.col(page) > 1))}).filter("NOT _stop").drop("_stop")
