"""Node and pipeline metrics gathered while data passes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from .resilience import retry


class Metrics:
    """Counts rows in and out of nodes without extra passes; durations of the driver's actions."""

    def __init__(self):
        self.seen: dict[tuple[str, str], Observation] = {}
        self.durations: dict[str, float] = {}
        self.retries: dict[str, int] = {}

    def _watch(self, df: DataFrame, node: str, what: str) -> DataFrame:
        o = self.seen[node, what] = Observation(f"{node}.{what}")
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def node(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """The step with its processed and emitted rows counted; read report() after an action."""
        return lambda df: self._watch(f(self._watch(df, name, "processed")), name, "emitted")

    def timed(self, name: str, work: Callable[[], object]):
        began = time.monotonic()
        try:
            return work()
        finally:
            self.durations[name] = time.monotonic() - began

    def retried(self, name: str, work: Callable[[], object], retries: int = 3, **how):
        """resilience.retry() with the node's retries counted."""
        self.retries.setdefault(name, 0)

        def again(error: Exception) -> bool:
            self.retries[name] += 1
            return True

        return self.timed(name, lambda: retry(work, retries, on_retry=again, **how))

    def totals(self) -> dict[str, float]:
        """The pipeline's: rows processed and emitted by all nodes, retries, and the time of the driver's actions."""
        nodes = self.report().values()
        return {"processed": sum(n.get("processed", 0) for n in nodes), "emitted": sum(n.get("emitted", 0) for n in nodes), "retries": sum(self.retries.values()), "seconds": sum(self.durations.values())}

    def report(self) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = {}
        for (node, what), o in self.seen.items():
            out.setdefault(node, {})[what] = o.get["rows"]
        for name, node in out.items():
            node["retries"] = self.retries.get(name, 0)
            if own := self.durations.get(name):  # its own action, if it was timed under its name
                node["seconds"], node["rows_per_second"] = own, node.get("processed", 0) / own
                node["seconds_per_row"] = own / max(1, node.get("processed", 0))
        return out


class StreamMetrics(StreamingQueryListener):
    """Collects the progress of streaming queries."""

    def __init__(self):
        self.rows, self.batches, self.errors = 0, 0, []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.batches += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.errors.append(event.exception)
