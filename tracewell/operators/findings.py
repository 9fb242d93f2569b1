"""What happens to a match: keys, suppression, exclusions, rate limits, and the texts of findings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import offset_text, severity_rank


def dedup_key(rule: Column, processes: list[Column]) -> Column:
    """The rule and its processes, whatever their roles."""
    return F.concat_ws("|", rule, F.array_join(F.array_sort(F.array(*(p.cast("string") for p in processes))), ","))


#: Windows that one segment of a group's times spans: of a segment's times, those of one window go through the group's task.
SEGMENT_WINDOWS = 64


def _grouped(batches: Iterable[pa.RecordBatch], by: list[str], held: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(group, columns) of rows that come in the order of their groups; the columns ``held`` of one group at a time."""
    now, parts = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at]:
                continue
            if parts and keys[at] != now:
                yield now, {c: np.concatenate([p[c] for p in parts]) for c in held}
                parts = []
            now = keys[at]
            parts.append({c: batch.column(c).slice(at, i - at).to_numpy(zero_copy_only=False) for c in held})
            at = i
    if parts:
        yield now, {c: np.concatenate([p[c] for p in parts]) for c in held}


def _openings(t: np.ndarray, window_us: int) -> np.ndarray:
    """For each of a segment's sorted times the next one that opens a window if it does; the length where there is none."""
    return np.searchsorted(t, t + window_us)


def _windows(times: DataFrame, group: str, time: str, window_us: int) -> DataFrame:
    """(group, time, window, opens) of distinct times: a window opens at a group's first time, and at the first one
    ``window_us`` or more after the last opening.

    Where a window opens depends on all times before, but only through the last opening. So each segment of SEGMENT_WINDOWS
    windows is mapped by itself, in parallel, from the time at which a window first opens in it to the last such time and their number:
    only times in the segment's first window, and the first after them, can be that. One pass over these few rows finds
    where each segment of a group is entered, and the segments are then numbered, again in parallel.
    """
    kind, span = times.schema[group], SEGMENT_WINDOWS * window_us
    held = times.select(group, F.col(time).cast("long").alias(time)).withColumn("_segment", F.floor(F.col(time) / span).cast("long"))
    entry = T.StructType([kind, *(T.StructField(c, T.LongType()) for c in ("_segment", "_entry", "_last", "_count"))])

    def entries(batches):
        for (g, segment), c in _grouped(batches, [group, "_segment"], [time]):
            t = c[time]
            nxt, n = _openings(t, window_us), len(t)
            last, count = np.arange(n), np.ones(n, np.int64)
            jump = np.append(nxt, n)
            last, count = np.append(last, -1), np.append(count, 0)
            while (jump[:-1] < n).any():  # twice as far each time
                last, count = np.where(jump < n, last[jump], last), count + count[jump]
                jump = jump[jump]
            m = min(n, int(np.searchsorted(t, segment * span + window_us)) + 1)
            yield pa.RecordBatch.from_pydict({group: [g] * m, "_segment": [segment] * m, "_entry": t[:m], "_last": t[last[:m]], "_count": count[:m]}, schema=to_arrow_schema(entry))

    def chain(batches):
        now, state, number = object(), None, 0
        for (g, segment), c in _grouped(batches, [group, "_segment"], ["_entry", "_last", "_count"]):
            if g != now:
                now, state, number = g, None, 0
            at = 0 if state is None else int(np.searchsorted(c["_entry"], state + window_us))
            found = at < len(c["_entry"])
            yield pa.RecordBatch.from_pydict({group: [g], "_segment": [segment], "_entry": [int(c["_entry"][at]) if found else None], "_last": [None], "_count": [number]}, schema=to_arrow_schema(entry))
            if found:
                state, number = int(c["_last"][at]), number + int(c["_count"][at])

    out = T.StructType([kind, T.StructField(time, T.LongType()), T.StructField("window", T.LongType()), T.StructField("opens", T.BooleanType())])

    def number(batches):
        for (g, _), c in _grouped(batches, [group, "_segment"], [time, "_entry", "_count"]):
            t, opens = c[time], np.zeros(len(c[time]), bool)
            nxt = _openings(t, window_us)
            at = len(t) if c["_entry"][0] is None or c["_entry"][0] != c["_entry"][0] else int(np.searchsorted(t, int(c["_entry"][0])))
            while at < len(t):  # as often as a window opens
                opens[at] = True
                at = int(nxt[at])
            yield pa.RecordBatch.from_pydict({group: [g] * len(t), time: t, "window": c["_count"].astype(np.int64) + np.cumsum(opens), "opens": opens}, schema=to_arrow_schema(out))

    mapped = held.repartition(group, "_segment").sortWithinPartitions(group, "_segment", time).mapInArrow(entries, entry)
    entered = mapped.repartition(group).sortWithinPartitions(group, "_segment", "_entry").mapInArrow(chain, entry)
    joined = held.join(entered.select(F.col(group).alias("_group"), F.col("_segment").alias("_s"), "_entry", "_count"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_segment") == F.col("_s")))
    return joined.select(group, "_segment", time, "_entry", "_count").repartition(group, "_segment").sortWithinPartitions(group, "_segment", time).mapInArrow(number, out)


def lasting(held: DataFrame, window_us: int) -> DataFrame:
    """(key, us, bound) of the reports of matches that hold during [s, e) with the binding ``bound``: a key is reported when a
    match begins, and again when a window has passed since its last report while it lasts, or at the next beginning after that.

    Of the bindings that hold at a report the smallest is named. ``held`` may have ``last``, a key's last report before. A
    key's intervals are read in order, and only those of one uninterrupted match are held.
    """
    source = held if "last" in held.columns else held.withColumn("last", F.lit(None).cast("long"))
    out = T.StructType([held.schema["key"], T.StructField("us", T.LongType()), held.schema["bound"]])

    def run(batches):
        key, last, open_, until, rows = object(), None, [], None, []

        def close():
            nonlocal last
            if not open_:
                return
            at = open_[0][0] if last is None else max(open_[0][0], last + window_us)
            while at < until:
                rows.append((key, at, min((b for s, e, b in open_ if s <= at < e), key=lambda b: tuple(b.values()))))
                last, at = at, at + window_us

        for batch in batches:
            rows.clear()
            for k, s, e, bound, before in zip(*(batch.column(c).to_pylist() for c in ("key", "s", "e", "bound", "last")), strict=True):
                if k != key or s > until:
                    close()
                    if k != key:
                        key, last = k, before
                    open_, until = [], e
                open_.append((s, e, bound))
                until = max(until, e)
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "us", "bound"), map(list, zip(*rows, strict=True)), strict=True)), schema=to_arrow_schema(out))
        rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("key", "us", "bound"), map(list, zip(*rows, strict=True)), strict=True)), schema=to_arrow_schema(out))

    return source.select("key", "s", "e", "bound", "last").repartition("key").sortWithinPartitions("key", "s", "e").mapInArrow(run, out)


def suppress(matches: DataFrame, window_us: int, key: str = "key", time: str = "us") -> DataFrame:
    """(key, us) of the matches that are reported: the first of a key, and then each that is a window or more later."""
    return _windows(matches.select(key, time).distinct(), key, time, window_us).filter("opens").select(key, time)


def rate_limit(findings: DataFrame, window_us: int, most: Column | int | str = 20, rule: str = "rule", time: str = "us", order: str = "key") -> DataFrame:
    """The findings with kept (among the first ``most`` of the rule in its window) and window (number, from 1).

    A window opens at the first finding after the last window; where, is found segment by segment. Ranks within a window come
    from an ordinary window function.
    """
    opened = _windows(findings.select(rule, time).distinct(), rule, time, window_us).select(F.col(rule).alias("_rule"), F.col(time).alias("_us"), "window")
    joined = findings.join(opened, F.col(rule).eqNullSafe(F.col("_rule")) & (F.col(time) == F.col("_us"))).drop("_rule", "_us")
    w = Window.partitionBy(rule, "window").orderBy(time, order)
    limit = F.lit(most) if isinstance(most, int) else F.col(most) if isinstance(most, str) else most
    return joined.withColumn("kept", F.row_number().over(w) <= limit)


def rate_summaries(limited: DataFrame, window_us: int, rule: str = "rule", time: str = "us") -> DataFrame:
    """One INFO finding per window that held findings back, at its roll-over."""
    held = limited.groupBy(rule, "window").agg(F.count_if(~F.col("kept")).alias("n"), (F.min(time) + window_us).alias(time)).filter("n > 0")
    title = F.format_string("rule %s: %d additional findings suppressed", F.col(rule), F.col("n"))
    return held.select(rule, time, F.lit("INFO").alias("severity"), title.alias("title"), "n")


def excluded_counts(findings: DataFrame, rule: str = "rule") -> DataFrame:
    return findings.filter("excluded").groupBy(rule).agg(F.count(F.lit(1)).alias("n_excluded"))


def roles_text(roles: Column) -> Column:
    """``a=name(pid), b=?(pid)``: a map of role to struct(name, pid), by role name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.format_string("%s=%s(%s)", e["key"], F.coalesce(F.when(e["value"]["name"] != "", e["value"]["name"]), F.lit("?")), e["value"]["pid"].cast("string"))), " ")


def console_line(severity: Column, rule: Column, title: Column, description: Column, roles: Column, n_events: Column) -> Column:
    return F.format_string("severity=%s rule=%s title=%s description=%s roles=[%s] events=%d", severity, rule, title, description, roles_text(roles), n_events)


def list_line(rule: Column, title: Column, description: Column, roles: Column) -> Column:
    return F.format_string("[%s] %s — %s  (%s)", rule, title, description, roles_text(roles))


def findings_view(findings: DataFrame, severity: str | None = None, status: str | None = None, rule: str | None = None, newest_first: bool = True) -> DataFrame:
    """Filtered and in time order; equal times keep arrival order either way."""
    for name, want in (("severity", severity), ("status", status), ("rule", rule)):
        if want is not None:
            findings = findings.filter(F.col(name) == want)
    return findings.orderBy(F.desc("ts") if newest_first else F.asc("ts"), "arrival")


def severest_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.desc("ts"), "arrival")


def with_latest_status(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """The last status by sequence number of an append-only log; ``new`` without one."""
    last = changes.groupBy(F.col("finding_id").alias("_id")).agg(F.max_by("status", "seq").alias("_status"))
    return findings.join(last, F.col("finding_id") == F.col("_id"), "left").withColumn("status", F.coalesce("_status", "status", F.lit("new"))).drop("_id", "_status")


def event_summary(events: DataFrame) -> Column:
    """What an event is about, in a few words."""
    e = {c: F.col(c) if c in events.columns else F.lit(None).cast("string") for c in ("type", "protocol", "remote_addr", "remote_port", "domain", "query_type", "path", "old_path", "cmdline", "exe", "name")}
    some = lambda c: F.when(e[c] != "", e[c])
    network = F.format_string("%s %s:%s", F.coalesce(e["protocol"], F.lit("tcp")), e["remote_addr"], e["remote_port"].cast("string"))
    dns = F.format_string("%s (%s)", e["domain"], F.coalesce(e["query_type"], F.lit("A")))
    file = F.when(F.coalesce(e["old_path"], F.lit("")) != "", F.concat_ws(" -> ", e["old_path"], e["path"])).otherwise(e["path"])
    return F.when(F.startswith(e["type"], F.lit("NETWORK_")), network).when(e["type"] == "DNS_QUERY", dns).when(F.startswith(e["type"], F.lit("FILE_")), file).otherwise(F.coalesce(some("cmdline"), some("exe"), some("name")))


def save_rows(findings: DataFrame) -> DataFrame:
    """Findings as rows of the log: tab, line, header and evidence as JSON, finding_id, status. ``roles`` and ``events`` are evidence."""
    header = [c for c in ("finding_id", "ts", "rule", "severity", "title", "description") if c in findings.columns]
    evidence = [c for c in ("roles", "events") if c in findings.columns]
    return findings.select("ts", F.lit("Findings").alias("tab"), "line", F.to_json(F.struct(*header)).alias("finding"), F.to_json(F.struct(*evidence)).alias("evidence"), "finding_id", F.lit("new").alias("status"))


def finding_json(findings: DataFrame, *columns: str) -> Column:
    """The export of one finding, its status included, under the names of its columns."""
    return F.to_json(F.struct(*columns, F.coalesce("status", F.lit("new")).alias("status")))


def headless_line(severity: Column, rule: Column, title: Column, description: Column, roles: Column, n_events: Column) -> Column:
    """The log line of a finding; roles and events only where there are roles."""
    text = roles_text(roles)
    head = F.format_string("severity=%s rule=%s  %s — %s", severity, rule, title, description)
    return F.when(text != "", F.concat(head, F.format_string("  roles=[%s] events=%d", text, n_events))).otherwise(head)


def finding_counts(findings: DataFrame) -> DataFrame:
    """One row: total, and how many are new."""
    return findings.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "new").alias("unhandled"))


def rules_with_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.coalesce(F.col("rule"), F.lit("")) != "").select("rule").distinct().orderBy("rule")


def role_of(roles: Column, identity: Column, pid: Column) -> Column:
    """The first role, by name, that a process fills; ``pid N`` if it fills none. ``roles``: a map of role to identity."""
    held = F.filter(F.array_sort(F.map_entries(roles)), lambda e: e["value"] == identity)
    return F.coalesce(F.get(held, F.lit(0))["key"], F.concat(F.lit("pid "), pid.cast("string")))


def timeline(events: DataFrame, finding: str = "finding_id", time: str = "us", order: str = "position") -> DataFrame:
    """The events of each finding with their place in time (equal times keep their order) and the offset from the first."""
    w = Window.partitionBy(finding).orderBy(time, order)
    return events.withColumns({"place": F.row_number().over(w), "offset": offset_text(F.col(time) - F.min(time).over(w.rowsBetween(Window.unboundedPreceding, 0)))})


def with_ids(findings: DataFrame, time: str = "us", order: str = "key") -> DataFrame:
    """``findings`` with finding_id, from the time in nanoseconds; of those of one microsecond each has its own."""
    place = F.row_number().over(Window.partitionBy(time).orderBy(order)) - 1
    return findings.withColumn("finding_id", F.concat(F.lit("finding-"), F.col(time).cast("string"), F.lpad(place.cast("string"), F.greatest(F.lit(3), F.length(place.cast("string"))), F.lit("0"))))


def derived_captures(evidence: Column, steps: list[tuple[str, str]]) -> Column:
    """What a stored finding captured, from its evidence (an array of struct(event_id, type)) and the (type, capture) of the
    steps that its rule has now: the first events are those of the steps, if their types are; else nothing is known."""
    wanted = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(c).alias("name")) for t, c in steps))
    first = F.slice(evidence, 1, len(steps))
    fits = (F.size(first) == len(steps)) & F.forall(F.zip_with(first, wanted, lambda e, w: F.coalesce(e["type"] == w["type"], F.lit(False))), lambda x: x)
    pairs = F.zip_with(first, wanted, lambda e, w: F.struct(w["name"].alias("name"), e["event_id"].alias("event_id")))
    return F.when(fits, F.filter(pairs, lambda p: p["name"] != "")).otherwise(F.slice(pairs, 1, 0))


def recent_findings(rows: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` stored findings, oldest first: an unknown status is new; a row without an id is named after its
    number and titled by its line."""
    own = F.coalesce(F.col("finding_id"), F.lit("")) != ""
    status = F.when(F.col("status").isin("new", "acknowledged", "dismissed"), F.col("status")).otherwise("new")
    named = rows.withColumns({"key": F.when(own, F.col("finding_id")).otherwise(F.concat(F.lit("row-"), F.col("id").cast("string"))), "title": F.when(own, F.col("title")).otherwise(F.col("line")), "status": status})
    return named.orderBy(F.desc("id")).limit(max(n, 0)).orderBy("id")


def evidence(sequence: Column, firsts: Column, latest: Column, most: int = 50) -> Column:
    """Event ids that explain a finding: those of the sequence, an example of each requirement, the latest of each threshold;
    each once, ``most`` in all."""
    return F.slice(F.array_distinct(F.filter(F.concat(sequence, firsts, latest), lambda x: x.isNotNull())), F.lit(1), F.lit(most))


def health_line(fields: dict[str, Column]) -> Column:
    """``key=value key=value`` in the order given."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in fields.items()))


def summary_line(backend: Column, patterns: Column, problems: Column, unhandled: Column, total: Column) -> Column:
    return F.format_string("collector: %s   patterns: %d   pattern errors: %d   findings: %d new / %d", backend, patterns, problems, unhandled, total)


def telemetry_lines(events: DataFrame) -> DataFrame:
    """(event_id, tab, line) of the events that a tab shows: processes, connections, DNS queries and files. Missing texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    pid, kind = F.coalesce(F.col("pid"), F.lit(0)), F.col("type")
    owner = F.when(text("name") != "", F.format_string("PID=%-6d %s", pid, text("name"))).when(pid != 0, F.format_string("PID=%-6d", pid)).otherwise("<unknown>")
    lines = {
        "Process": (("PROCESS_START", "PROCESS_EXIT", "PROCESS_EXEC"), F.format_string("%s  PID=%-6d  %-20s  %s", kind, pid, text("name"), text("exe"))),
        "Network": (("NETWORK_CONNECT", "NETWORK_CLOSE"), F.format_string("%s  PID=%-6d  %-5s  %s:%d  %s", kind, pid, text("protocol"), text("remote_addr"), F.coalesce(F.col("remote_port"), F.lit(0)), text("state"))),
        "DNS": (("DNS_QUERY",), F.format_string("%-40s  %-6s  resolver=%-16s  %s", text("domain"), text("query_type"), text("resolver"), owner)),
        "File": (("FILE_CREATE", "FILE_MODIFY", "FILE_DELETE", "FILE_RENAME"), F.format_string("%s  PID=%-6d  %s", kind, pid, text("path"))),
    }
    tab = line = None
    for name, (types, made) in lines.items():
        tab, line = (F.when(kind.isin(*types), x) if old is None else old.when(kind.isin(*types), x) for old, x in ((tab, F.lit(name)), (line, made)))
    return events.select("event_id", tab.alias("tab"), line.alias("line")).filter("tab is not null")
