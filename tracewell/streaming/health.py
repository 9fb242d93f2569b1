"""Health by observation: metrics that streams collect as they run, and a listener that adds them up."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..fields import EVENT_TYPES

#: Name of the metrics of a stream of events.
METRICS = "tracewell_events"


def observed(events: DataFrame, name: str = METRICS) -> DataFrame:
    """``events`` with metrics that Spark gathers while it reads them, for a batch by ``Observation`` or a listener: how many
    there are of each type, how many have no process, and the span of their times."""
    by_type = [F.count_if(F.col("type") == t).alias(t) for t in EVENT_TYPES]
    return events.observe(name, F.count(F.lit(1)).alias("events"), F.count_if(F.col("proc").isNull()).alias("unattributed"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"), *by_type)


class StreamHealth(StreamingQueryListener):
    """Counters of all streams of a session that run while it listens: batches, events, unattributed and failed queries, the
    longest batch, and rows in state."""

    def __init__(self, name: str = METRICS):
        self.name, self.by_type = name, Counter()
        self.counters = {"events": 0, "batches": 0, "unattributed": 0, "failed": 0, "longest_ms": 0, "state_rows": 0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, c = event.progress, self.counters
        found = p.observedMetrics.get(self.name)
        if found is not None:
            got = found.asDict()
            c["events"] += got["events"]
            c["unattributed"] += got["unattributed"]
            self.by_type.update({t: got[t] for t in EVENT_TYPES if got[t]})
        c["batches"] += p.numInputRows > 0
        c["longest_ms"] = max(c["longest_ms"], p.batchDuration)
        c["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.counters["failed"] += event.exception is not None

    def line(self) -> str:
        """``key=value ...``; what may be alarming only where it is above zero."""
        quiet = ("unattributed", "failed", "state_rows")
        return " ".join(f"{k}={v}" for k, v in self.counters.items() if v or k not in quiet)
