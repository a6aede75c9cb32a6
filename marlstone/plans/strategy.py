"""Which channels serve a search: a registry of strategies and a resolver by capability.

This is plan-time work on the driver; data never takes part in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Strategy:
    name: str
    channels: tuple[str, ...]
    rerank: bool = False

    @property
    def needs_dense(self) -> bool:
        return "dense" in self.channels


@dataclass(frozen=True)
class Resolution:
    requested: str
    strategy: Strategy
    skipped: tuple[tuple[str, str], ...] = field(default=())

    @property
    def reason(self) -> str:
        return "; ".join(f"{name}: {why}" for name, why in self.skipped) or f"{self.strategy.name} as requested"


STRATEGIES = {
    s.name: s
    for s in (
        Strategy("dense+rerank", ("dense",), True),
        Strategy("dense", ("dense",)),
        Strategy("fusion+rerank", ("lexical", "dense"), True),
        Strategy("fusion", ("lexical", "dense")),
        Strategy("bm25", ("lexical",)),
        Strategy("legacy", ()),
    )
}
# What is tried for each request, in order.
LADDERS = {
    "auto": ("dense+rerank", "dense", "bm25"),
    "dense+rerank": ("dense+rerank", "dense", "bm25"),
    "dense": ("dense", "bm25"),
    "fusion+rerank": ("fusion+rerank", "dense", "bm25"),
    "fusion": ("fusion", "dense", "bm25"),
    "bm25": ("bm25",),
    "legacy": ("legacy",),
}
LEXICAL_WEIGHT = 0.4


def parse(value: object) -> str | None:
    """A known request name, exactly as it is written, else none."""
    return value if isinstance(value, str) and value in LADDERS else None


def lexical_weight(value: object) -> float:
    """A number of zero or more, else the default."""
    try:
        weight = float(str(value).strip())
    except ValueError:
        return LEXICAL_WEIGHT
    return weight if 0 <= weight < float("inf") else LEXICAL_WEIGHT


def resolve(requested: str, dense: str | None = None, rerank: str | None = None) -> Resolution:
    """The first strategy of the ladder that can be served. ``dense``, ``rerank``: why one can't be, or none if it can."""
    skipped = []
    for name in LADDERS[requested]:
        strategy = STRATEGIES[name]
        missing = (strategy.needs_dense and dense) or (strategy.rerank and rerank)
        if not missing:
            return Resolution(requested, strategy, tuple(skipped))
        skipped.append((name, missing))
    raise AssertionError(f"the ladder of {requested} does not end in a strategy that needs nothing")


def served(strategy: Strategy, alive: set[str], reranked: bool) -> str:
    """The name of what was served once failed channels are gone."""
    left = [c for c in strategy.channels if c in alive]
    base = "fusion" if len(left) > 1 else {"dense": "dense", "lexical": "bm25"}.get(left[0], "none") if left else "none"
    return f"{base}+rerank" if reranked and base in ("fusion", "dense") else base
