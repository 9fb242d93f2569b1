"""Process events from a stream of kernel records, with keyed state, event-time timers and a seed.

A host's processes are the state of one key, by PID. A fork is held back until an exec within the grace period describes the
process, or until the watermark passes the end of that period: then a timer announces it as a copy of its parent.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import fold_fork_exec  # noqa: F401  the same over a whole table

RECORDS = "host string, kind string, pid long, ppid long, start long, at long, ts timestamp, name string, exe string, cmdline string, user string"
EVENTS = "host string, type string, pid long, ppid long, start long, at long, name string, exe string, cmdline string, user string, inferred boolean"
_TRACKED = "ppid long, start long, name string, exe string, cmdline string, user string, forked long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ProcessTracker(StatefulProcessor):
    """State of a host: PID to (ppid, start, name, exe, cmdline, user, forked); forked is the time of a fork that is held back."""

    def __init__(self, grace_us: int):
        self.grace_us = grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getMapState("held", "pid long", _TRACKED)

    def _event(self, host: str, kind: str, pid: int, at: int, inferred: bool = False) -> Row:
        ppid, start, name, exe, cmdline, user, _ = self.held.getValue((pid,))
        return Row(host=host, type=kind, pid=pid, ppid=ppid, start=start, at=at, name=name, exe=exe, cmdline=cmdline, user=user, inferred=inferred)

    def _announce(self, host: str, pid: int) -> Iterator[Row]:
        """The start of a process whose fork was held back."""
        x = self.held.getValue((pid,))
        if x[6] is not None:
            yield self._event(host, "PROCESS_START", pid, x[6])
            self.held.updateValue((pid,), (*x[:6], None))

    def _end(self, host: str, pid: int, at: int, inferred: bool) -> Iterator[Row]:
        yield from self._announce(host, pid)
        yield self._event(host, "PROCESS_EXIT", pid, at, inferred)
        self.held.removeKey((pid,))

    def _settle(self, host: str, now: int) -> Iterator[Row]:
        late = sorted((x[6], pid) for (pid,), x in list(self.held.iterator()) if x[6] is not None and x[6] + self.grace_us < now)
        for _, pid in late:
            yield from self._announce(host, pid)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (host,) = key
        for r in sorted(rows, key=lambda r: (r["at"], ("fork", "exec", "exit").index(r["kind"]))):
            pid, at = r["pid"], r["at"]
            x = self.held.getValue((pid,)) if self.held.containsKey((pid,)) else None
            if x is not None and x[1] != r["start"] and r["kind"] != "exit":  # another process has the PID now
                yield from self._end(host, pid, at, True)
                x = None
            if r["kind"] == "fork" and x is None:
                above = self.held.getValue((r["ppid"],)) if self.held.containsKey((r["ppid"],)) else None
                if above is not None:  # announced before its child, which runs its program
                    yield from self._announce(host, r["ppid"])
                image = above[2:5] if above is not None else (r["name"], r["exe"], r["cmdline"])
                user = r["user"] or (above[5] if above is not None else r["user"])
                self.held.updateValue((pid,), (r["ppid"], r["start"], *image, user, at))
                self.handle.registerTimer((at + self.grace_us) // 1000 + 1)
            elif r["kind"] == "exec":
                told = (r["name"], r["exe"], r["cmdline"])
                if x is not None and x[6] is not None and at - x[6] > self.grace_us:
                    yield from self._announce(host, pid)
                    x = self.held.getValue((pid,))
                image = told if any(told) else x[2:5] if x is not None else told
                kind = "PROCESS_START" if x is None or x[6] is not None else "PROCESS_EXEC"
                self.held.updateValue((pid,), (x[0] if x is not None else r["ppid"], r["start"], *image, r["user"] or (x[5] if x is not None else r["user"]), None))
                yield self._event(host, kind, pid, at)
            elif r["kind"] == "exit" and x is not None and x[1] == r["start"]:
                yield from self._end(host, pid, at, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A seeded process is announced already."""
        for r in initialState if not isinstance(initialState, Row) else [initialState]:
            self.held.updateValue((r["pid"],), (r["ppid"], r["start"], r["name"], r["exe"], r["cmdline"], r["user"], None))

    def close(self) -> None:
        pass


def track(records: DataFrame, seed: DataFrame | None = None, grace_us: int = 50_000, delay: str = "2 seconds") -> DataFrame:
    """Process events (EVENTS) of a stream of records (RECORDS; ``at`` in microseconds and ``ts`` are the same time).

    ``seed``: processes that run already (host, pid, ppid, start, name, exe, cmdline, user). Records may be late by ``delay``.
    A PID that comes with another start ends its holder, inferred. An exec or exit of a process that isn't held starts it, or is
    passed over. State of a process goes with its exit. The session needs RocksDB as its state store, see PROVIDER.
    """
    stream = records.withWatermark("ts", delay).groupBy("host")
    return stream.transformWithState(ProcessTracker(grace_us), EVENTS, "append", "eventTime", seed.groupBy("host") if seed is not None else None)
