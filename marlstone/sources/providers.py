"""Embedding and reranking services: which one is asked, and what its answers hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Provider:
    name: str
    model: str
    endpoint: str
    key: str = ""


def choose(presets: list[Provider], keys: dict[str, str], named: str | None = None, model: str | None = None, endpoint: str | None = None, fallback: tuple[str, str] | None = None, off: bool = False) -> Provider | None:
    """The provider to ask: the ``named`` one if it has a key, else (without a name) the first preset that has one, else
    the ``fallback`` (a preset's name and its key); none if the layer is off or nobody has a key. ``model`` and
    ``endpoint`` replace a preset's own."""
    if off:
        return None
    known = {p.name: p for p in presets}
    tried = [(name, keys.get(name)) for name in ([named] if named else known) if name in known]
    for name, key in [*tried, *([fallback] if fallback else [])]:
        if key:
            return Provider(name, model or known[name].model, endpoint or known[name].endpoint, key)
    return None


def vectors_of(body: Column) -> Column:
    """The vectors of an answer by their index (one without an index counts as 0; equal ones keep their order).

    Null if the answer is no JSON, holds no vector, or any of its vectors is missing, empty or has a null in it."""
    data = F.from_json(body, "data array<struct<embedding:array<double>,index:int>>")["data"]
    ordered = F.array_sort(F.transform(data, lambda d, i: F.struct(F.coalesce(d["index"], F.lit(0)).alias("index"), i.alias("place"), d["embedding"].alias("vec"))))
    found = F.transform(ordered, lambda d: d["vec"])
    whole = F.forall(found, lambda v: v.isNotNull() & (F.size(v) > 0) & (F.size(F.array_compact(v)) == F.size(v)))
    return F.when((F.size(found) > 0) & whole, found)


def error_of(label: str, status: Column, body: Column, chars: int = 200) -> Column:
    """What went wrong with an answer, null if nothing did: the service's own words, cut to ``chars``."""
    said = F.substr(body, F.lit(1), F.lit(chars))
    failed = F.concat(F.lit(f"{label} "), status.cast("string"), F.lit(": "), F.when(F.coalesce(said, F.lit("")) == "", "no body").otherwise(said))
    return F.when(~status.between(200, 299), failed).when(vectors_of(body).isNull(), F.lit(f"{label}: malformed response body"))
