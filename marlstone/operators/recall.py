"""Search: channels by strategy, fusion, reranking, materialised hits; many queries in one plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..plans import strategy as st
from . import dense, fusion, lexical, scope as scopes

Reranker = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: A channel of one's own: from queries, corpus, the columns of the scope and a number of hits for each query to
#: (query_id, doc_id, score, rank).
Channel = Callable[[DataFrame, DataFrame, list[str] | None, int], DataFrame]


@dataclass
class Found:
    """(query_id, doc_id, score, rank), the strategy that served it, for each channel whether it did (or why not), and
    the reason for the strategy and for what was left out of it."""

    rankings: DataFrame
    served: str
    status: dict[str, str]
    reason: str


def recall(
    queries: DataFrame,
    corpus: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    requested: str = "auto",
    reranker: Reranker | None = None,
    weight: float = st.LEXICAL_WEIGHT,
    pool: int = fusion.POOL,
    top: int = fusion.TOP,
    scope: list[str] | None = None,
    reference_compat: bool = False,
    also: dict[str, tuple[Channel, float]] | None = None,
    tokenize: lexical.Tokenizer = tx.tokens,
    tolerant: bool = True,
) -> Found:
    """Rank ``corpus`` (doc_id, text, scope columns) for ``queries`` (query_id, text, scope columns).

    Every channel sees only documents in the query's scope, by the rule of `scope`: a null, empty or ``*`` value asks
    for nothing. With ``reference_compat`` the dense channel and the legacy scorer rank all documents, keep ``top`` of
    them and only then apply the scope, so they may return fewer. ``also``: further channels by name, with their weights,
    that are fused with the strategy's own; ``tokenize``: another tokenizer of the lexical channel.

    A channel of which a job fails fails the search. One that cannot be planned does so too unless ``tolerant``: then the
    others are ranked without it, with a warning, and ``served``, ``status`` and ``reason`` tell. Who reads ``rankings``
    alone can't tell these from the whole result, and wants ``tolerant=False``.
    """
    no_dense = None if vectors is not None and query_vectors is not None else "no embedder"
    plan = st.resolve(requested, dense=no_dense, rerank=None if reranker else "no reranker")
    strategy = plan.strategy
    if strategy.name == "legacy":
        late = reference_compat and scope
        hits = lexical.keyword_hits(queries, corpus, top, scope=None if late else scope)
        return Found(_scoped_late(hits, queries, corpus, scope) if late else hits, "legacy", {}, plan.reason)
    channels: dict[str, tuple[DataFrame, float]] = {}
    status: dict[str, str] = {}
    further = also or {}
    for name in (*strategy.channels, *further):
        try:
            if name in further:
                channels[name] = (further[name][0](queries, corpus, scope, pool), further[name][1])
            elif name == "lexical":
                channels[name] = (lexical.bm25(queries, corpus, pool, scope, tokenize=tokenize), weight)
            else:
                channels[name] = (_dense(queries, corpus, vectors, query_vectors, scope, pool, top, reference_compat), 1.0)
            status[name] = "ok"
        except AnalysisException as error:  # it cannot be planned; what a job raises is no reason to go on without its channel
            if not tolerant:
                raise
            status[name] = str(error)
            warnings.warn(f"the search goes on without its channel {name}: {error}", RuntimeWarning, stacklevel=2)
    reason = "; ".join([plan.reason, *[f"{name}: {why}" for name, why in status.items() if why != "ok"]])
    if not channels:
        return Found(queries.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int"), "none", status, reason)
    fused = fusion.fuse(channels, pool) if len(channels) > 1 else next(iter(channels.values()))[0]
    if strategy.rerank:
        ranked = fusion.apply_rerank(fused, reranker(fused, queries, corpus), top)
    else:
        ranked = fused.filter(F.col("rank") <= top)
    ranked = ranked.select("query_id", "doc_id", "score", "rank")
    return Found(ranked, st.served(strategy, set(channels) - set(further), strategy.rerank), status, reason)


def near(queries: DataFrame, corpus: DataFrame, vectors: DataFrame, query_vectors: DataFrame, scope: list[str] | None = None, pool: int = fusion.POOL) -> DataFrame:
    """(query_id, doc_id, score, rank): the dense channel alone."""
    return _dense(queries, corpus, vectors, query_vectors, scope, pool, fusion.TOP, False)


def _dense(queries, corpus, vectors, query_vectors, scope, pool, top, reference_compat) -> DataFrame:
    asked = query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
    known = vectors.join(corpus.select("doc_id"), "doc_id", "left_semi")
    if not scope:
        return dense.cosine_search(asked, known, pool)
    if reference_compat:
        return _scoped_late(dense.cosine_search(asked, known, top, positive=True), queries, corpus, scope)
    asked = asked.join(queries.select("query_id", *scope), "query_id")
    return dense.cosine_search(asked, known.join(corpus.select("doc_id", *scope), "doc_id"), pool, scope=scope)


def _scoped_late(hits: DataFrame, queries: DataFrame, corpus: DataFrame, scope: list[str]) -> DataFrame:
    """Of hits that are ranked already those in their query's scope."""
    asked = queries.select("query_id", *[F.col(c).alias(f"asked_{c}") for c in scope])
    both = hits.join(corpus.select("doc_id", *scope), "doc_id").join(asked, "query_id")
    rule = scopes.matches_columns({c: F.col(c) for c in scope}, {c: F.col(f"asked_{c}") for c in scope})
    return both.filter(rule).select(*hits.columns)


def materialised(rankings: DataFrame, rows: DataFrame, top: int = fusion.TOP) -> DataFrame:
    """The rows of ranked ids that are still live, ranked anew without the gaps of those that are gone."""
    from pyspark.sql import Window

    from .ingest import live

    order = Window.partitionBy("query_id").orderBy("rank")
    both = rankings.select("query_id", "doc_id", "rank").join(live(rows), "doc_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("deleted", "source")
