"""The gate as a stateful stream: one state per tenant, fed by micro-batches of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gates import INTERVAL_MS, TTL_MS, Gate, step


class GateProcessor(StatefulProcessor):
    """Holds a tenant's last read, its breaker and the saving times of its cache."""

    def __init__(self, ttl: int = TTL_MS, interval: int = INTERVAL_MS):
        self.ttl, self.interval = ttl, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getValueState("numbers", "last_read long, blocked_until long")
        self.saved = handle.getMapState("saved", "key string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.numbers.get() if self.numbers.exists() else (None, 0)
        before = {k[0]: v[0] for k, v in self.saved.iterator()}
        gate = Gate(known[0], known[1] or 0, dict(before))
        pdf = pd.concat(list(rows)).sort_values(["at", "seq"])
        outcomes = []
        for r in pdf.itertuples():
            retry = None if r.retry_after is None or r.retry_after != r.retry_after else float(r.retry_after)
            outcomes.append(step(gate, int(r.at), r.kind, r.key, int(r.status), retry, bool(r.local), self.ttl, self.interval))
        self.numbers.update((gate.last_read, gate.blocked_until))
        for k in before.keys() - gate.saved.keys():
            self.saved.removeKey((k,))
        for k, at in gate.saved.items():
            if before.get(k) != at:
                self.saved.updateValue((k,), (at,))
        yield pd.DataFrame({"tenant": pdf["tenant"], "seq": pdf["seq"], "outcome": outcomes})

    def close(self) -> None:
        pass


def gated(requests: DataFrame, ttl: int = TTL_MS, interval: int = INTERVAL_MS) -> DataFrame:
    """(tenant, seq, outcome) of a stream of requests with the columns of ``operators.gates.folded``."""
    return requests.groupBy("tenant").transformWithStateInPandas(GateProcessor(ttl, interval), "tenant long, seq long, outcome string", "Append", "None")
