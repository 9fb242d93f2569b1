"""Patterns to findings, exactly, over a whole history: joins and interval sweeps that Catalyst plans.

For one binding of processes to roles every ingredient holds during intervals: a role while its process has an image that fits,
a requirement for a window after each of its events, a threshold for a window after each instant that meets it, a sequence from
its last event to a window after its first, a process from its start to a window after its exit. The binding matches while all
hold at once. It is reported when a match begins, if the last report of its key is a window ago or more, and again a
window after its last report while it lasts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import PROCESS, fields_of
from ..functions.predicates import block, without_references
from ..operators import findings as out
from ..operators.graph import descendants, parent_edges
from ..operators.lifecycle import FOREVER, images
from ..operators.store import settled
from ..operators.thresholds import all_hold, count_met, distinct_met, islands, micros, truncated
from .dsl import Exclusion, Pattern, Requirement, Role

WINDOW_US = 300_000_000
TOLERANCE_US = 3_000_000
#: Where processes and connections both come from kernel events, which carry the time at which things happen.
EVENT_DRIVEN_TOLERANCE_US = 250_000


def default_tolerance(processes: str, network: str) -> int:
    """The tolerance of sequences that have none, by where processes and connections come from: a kernel source or ``poll``."""
    return TOLERANCE_US if "poll" in (processes, network) else EVENT_DRIVEN_TOLERANCE_US


def role_filter(pattern: Pattern, role: Role) -> Column:
    """Match block and conditions, without the role's exclusions."""
    keep = block(role.match, PROCESS)
    for kind, value in role.conditions:
        keep = keep & (F.coalesce(F.col("name" if kind == "PROCESS_NAME" else "user"), F.lit("")) == value)
    return reduce(lambda a, m: a & ~block(m[1], PROCESS), [m for m in pattern.exclude if m[0] == role.id], keep)


def requirement_events(events: DataFrame, need: Requirement) -> DataFrame:
    return events.filter((F.col("type") == need.type) & block(need.where, fields_of(need.type)))


def requirement_intervals(events: DataFrame, need: Requirement, window_us: int, fits: DataFrame | None = None) -> DataFrame:
    """(proc, s, e): when the requirement holds for a process. A threshold counts the events at whose time the process has an
    image that fits the role: during the intervals ``fits`` (proc, s, e), always if there are none."""
    found = requirement_events(events, need)
    us = micros(F.col("ts"))
    if need.count:
        if fits is not None:
            then = fits.select(F.col("proc").alias("_p"), F.col("s").alias("_s"), F.col("e").alias("_e"))
            found = found.join(then, (F.col("proc") == F.col("_p")) & (us >= F.col("_s")) & (us < F.col("_e"))).drop("_p", "_s", "_e")
        within = need.within_us or window_us
        found = distinct_met(found, ["proc"], need.distinct, need.count, within) if need.distinct else count_met(found, ["proc"], need.count, within)
    return islands(found.select("proc", us.alias("s"), (us + window_us).alias("e")), ["proc"])


def role_intervals(pattern: Pattern, processes: DataFrame, events: DataFrame) -> dict[str, DataFrame | None]:
    """By role (proc, s, e) while a process has an image that fits it; None for a role that any image fits."""
    asks = {r.id for r in pattern.roles if r.match or r.conditions or any(m[0] == r.id for m in pattern.exclude)}
    held = images(processes, events) if asks else None
    return {r.id: islands(held.filter(role_filter(pattern, r)).select("proc", "s", "e"), ["proc"]) if r.id in asks else None for r in pattern.roles}


def bindings(pattern: Pattern, processes: DataFrame, events: DataFrame, edges: DataFrame, window_us: int, fits: dict[str, DataFrame | None] | None = None) -> DataFrame:
    """One row per assignment of distinct processes to all roles that satisfies every relationship, and time in which all are
    visible and fit: r_<role> columns and [vis_s, vis_e). Roles are pruned by their requirements first, then joined along
    relationships."""
    sides = {}
    fits = role_intervals(pattern, processes, events) if fits is None else fits
    alive = processes.select("proc", F.coalesce(micros(F.col("start")), F.lit(0)).alias("_s"), F.coalesce(micros(F.col("exited_at")) + window_us, F.lit(FOREVER)).alias("_e"))
    for role in pattern.roles:
        own = alive
        if fits[role.id] is not None:
            own = own.join(fits[role.id], "proc").select("proc", F.greatest("_s", "s").alias("_s"), F.least("_e", "e").alias("_e"))
        types = [(n.type, n.where) for n in role.events] + [(s.type, without_references(s.where)) for s in (pattern.sequence.steps if pattern.sequence else []) if s.role == role.id]
        for kind, where in types:
            own = own.join(events.filter((F.col("type") == kind) & block(where, fields_of(kind))).select("proc"), "proc", "left_semi")
        sides[role.id] = own.select(F.col("proc").alias(f"r_{role.id}"), F.col("_s").alias(f"s_{role.id}"), F.col("_e").alias(f"e_{role.id}"))
    bound, left = [pattern.roles[0].id], list(pattern.edges)
    rows = sides[bound[0]]
    while left:
        edge = next((e for e in left if e.parent in bound or e.child in bound), None)
        if edge is None:
            raise ValueError("the roles are not all connected")
        left.remove(edge)
        depth = edge.max_depth if edge.type == "DESCENDANT" else 1
        # processes in between must be visible, too
        link = descendants(edges, depth, alive.select("proc", F.col("_e").alias("e"))).select(F.col("ancestor").alias(f"r_{edge.parent}"), F.col("descendant").alias(f"r_{edge.child}"), F.col("until").alias("_until"))
        on = [f"r_{r}" for r in (edge.parent, edge.child) if r in bound]
        rows = rows.join(link, on).withColumn(f"e_{bound[0]}", F.least(f"e_{bound[0]}", "_until")).drop("_until")
        for r in (edge.parent, edge.child):
            if r not in bound:
                rows = rows.join(sides[r], f"r_{r}")
                for other in bound:
                    rows = rows.filter(F.col(f"r_{r}") != F.col(f"r_{other}"))
                bound.append(r)
    starts, ends = [F.col(f"s_{r}") for r in bound], [F.col(f"e_{r}") for r in bound]
    low, high = (F.greatest(*starts), F.least(*ends)) if len(bound) > 1 else (starts[0], ends[0])
    return rows.select(*(f"r_{r.id}" for r in pattern.roles), low.alias("vis_s"), high.alias("vis_e")).filter("vis_s < vis_e")


def sequence_assignments(pattern: Pattern, rows: DataFrame, events: DataFrame, window_us: int, tolerance_us: int) -> DataFrame:
    """One row per binding and assignment of distinct events to the steps: t0.., id0.. beside the roles.

    Step k comes no earlier than the latest of the steps before it less the tolerance, all within the span of the first;
    captured values of earlier steps are columns that later steps compare with.
    """
    seq = pattern.sequence
    within = seq.within_us if seq.within_us is not None else window_us
    tol = seq.tolerance_us if seq.tolerance_us is not None else tolerance_us
    captures: dict[str, tuple[Column, str]] = {}
    for k, step in enumerate(seq.steps):
        kinds = fields_of(step.type)
        needed = [f for f in kinds if f in events.columns]
        side = events.filter((F.col("type") == step.type) & block(without_references(step.where), kinds)).select(F.col("proc").alias(f"r_{step.role}"), micros(F.col("ts")).alias(f"t{k}"), F.col("event_id").alias(f"id{k}"), *(F.col(f).alias(f"f{k}_{f}") for f in needed))
        rows = rows.join(side, f"r_{step.role}")
        rest = {f: s for f, s in step.where.items() if f not in without_references(step.where)}
        keep = block(rest, kinds, {f: F.col(f"f{k}_{f}") for f in needed}, captures)
        if k:
            before = [F.col(f"t{j}") for j in range(k)]
            latest = F.greatest(*before) if k > 1 else before[0]
            span = F.abs(F.col(f"t{k}") - F.col("t0")) <= within if k == len(seq.steps) - 1 else F.col(f"t{k}") - F.col("t0") <= within + tol
            keep = keep & (F.col(f"t{k}") >= latest - tol) & span
            for j in range(k):
                keep = keep & (F.col(f"id{k}") != F.col(f"id{j}"))
        rows = rows.filter(keep)
        if step.capture:
            captures |= {f"{step.capture}.{f}": (F.col(f"f{k}_{f}"), kinds[f]) for f in needed}
    return rows


def earliest(pattern: Pattern, assignments: DataFrame) -> DataFrame:
    """Of each binding's assignments the first in the order of the steps' times and event ids: the roles, t0.., id0.., and the
    captures as an array of (name, event_id)."""
    names, steps = [f"r_{r.id}" for r in pattern.roles], pattern.sequence.steps
    chosen = assignments.groupBy(*names).agg(F.min(F.struct(*(c for k in range(len(steps)) for c in (f"t{k}", f"id{k}")))).alias("x"))
    named = [F.struct(F.lit(s.capture).alias("name"), F.col(f"x.id{k}").alias("event_id")) for k, s in enumerate(steps) if s.capture]
    return chosen.select(*names, "x.*", (F.array(*named) if named else F.array().cast("array<struct<name:string,event_id:bigint>>")).alias("captures"))


def requirement_evidence(pattern: Pattern, found: DataFrame, events: DataFrame, window_us: int = WINDOW_US, examples: int = 10) -> DataFrame:
    """(key, us, evidence): event ids that explain each finding's requirements at its time: the first example in the window
    of a requirement, and the latest ``examples`` of a threshold's span, in the order of the requirements."""
    parts = []
    for role in pattern.roles:
        for number, need in enumerate(role.events):
            span = (need.within_us or window_us) if need.count else window_us
            side = requirement_events(events, need).select(F.col("proc").alias("_p"), micros(F.col("ts")).alias("_t"), F.col("event_id").alias("_id"))
            near = found.select("key", "us", F.col(f"r_{role.id}").alias("_p")).join(side, "_p").filter((F.col("_t") <= F.col("us")) & (F.col("_t") > F.col("us") - span))
            order = [F.desc("_t"), F.desc("_id")] if need.count else [F.asc("_t"), F.asc("_id")]
            ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("key", "us").orderBy(*order))).filter(F.col("_n") <= (examples if need.count else 1))
            parts.append(ranked.select("key", "us", F.lit(1 if need.count else 0).alias("_kind"), F.lit(f"{role.id} {number:04d}").alias("_of"), "_t", "_id"))
    if not parts:
        return found.select("key", "us", F.array().cast("array<bigint>").alias("evidence"))
    gathered = reduce(DataFrame.unionByName, parts).groupBy("key", "us").agg(F.array_sort(F.collect_list(F.struct("_kind", "_of", "_t", "_id"))).alias("x"))
    none = F.array().cast("array<bigint>")
    ids = lambda kind: F.transform(F.filter("x", lambda e: e["_kind"] == kind), lambda e: e["_id"].cast("bigint"))
    return found.select("key", "us").join(gathered, ["key", "us"], "left").select("key", "us", F.coalesce(out.evidence(none, ids(0), ids(1)), none).alias("evidence"))


def match_intervals(pattern: Pattern, processes: DataFrame, events: DataFrame, edges: DataFrame | None = None, window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """(r_<role>.., s, e) in microseconds: when each binding matches.

    The requirements of all roles meet the bindings in one join; a role by itself needs none.
    """
    if not pattern.roles:
        return processes.sparkSession.createDataFrame([], "s long, e long")
    edges = parent_edges(processes) if edges is None and pattern.edges else edges
    names = [f"r_{r.id}" for r in pattern.roles]
    fits = role_intervals(pattern, processes, events)
    rows = bindings(pattern, processes, events, edges, window_us, fits)
    parts = [rows.select(*names, F.col("vis_s").alias("s"), F.col("vis_e").alias("e"))]
    needs = [(role.id, need) for role in pattern.roles for need in role.events]
    held = [requirement_intervals(events, need, window_us, fits[role]).select(F.lit(k).alias("need"), "proc", "s", "e") for k, (role, need) in enumerate(needs)]
    if held and len(names) == 1:
        parts += [x.select(F.col("proc").alias(names[0]), "s", "e") for x in held]
    elif held:
        asked = rows.select(*names).distinct().select(*names, F.explode(F.array(*(F.struct(F.lit(k).alias("need"), F.col(f"r_{role}").alias("proc")) for k, (role, _) in enumerate(needs)))).alias("_ask"))
        every = reduce(DataFrame.unionByName, held)
        parts.append(asked.select(*names, "_ask.*").join(every, ["need", "proc"]).select(*names, "s", "e"))
    if pattern.sequence:
        n = len(pattern.sequence.steps)
        found = sequence_assignments(pattern, rows.select(*names).distinct(), events, window_us, tolerance_us)
        times = [F.col(f"t{k}") for k in range(n)]
        low, high = (F.least(*times), F.greatest(*times)) if n > 1 else (times[0], times[0])
        parts.append(islands(found.select(*names, high.alias("s"), (low + window_us).alias("e")), names))
    if len(parts) == 1:
        return parts[0]
    return all_hold(reduce(DataFrame.unionByName, parts), names, 1 + len(needs) + bool(pattern.sequence))


def possibly_truncated(pattern: Pattern, processes: DataFrame, events: DataFrame, edges: DataFrame | None = None, window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US, keep: int = 64) -> DataFrame:
    """Bindings (r_<role>.., dropped) whose sequence is not found, and may be missing only because a store of the newest ``keep``
    events of a process and type would have dropped some: how many, over all bound processes. The matcher here keeps them all."""
    names = [f"r_{r.id}" for r in pattern.roles]
    edges = parent_edges(processes) if edges is None and pattern.edges else edges
    bound = bindings(pattern, processes, events, edges, window_us).select(*names).distinct()
    found = sequence_assignments(pattern, bound, events, window_us, tolerance_us).select(*names).distinct()
    used = {s.type for s in pattern.sequence.steps}
    lost = truncated(events.filter(F.col("type").isin(*sorted(used))), ["proc", "type"], keep).groupBy("proc").agg(F.sum("dropped").alias("dropped"))
    left = bound.join(found, names, "left_anti").select(*names, F.explode(F.array(*(F.col(n) for n in names))).alias("proc"))
    return left.join(lost, "proc").groupBy(*names).agg(F.sum("dropped").alias("dropped"))


def inspect(proc, processes: DataFrame, events: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What is known of one process: its events in order of time, and its relationships (parent, child)."""
    edges = parent_edges(processes) if edges is None else edges
    return events.filter(F.col("proc") == proc).orderBy("ts", "event_id"), edges.filter((F.col("parent") == proc) | (F.col("child") == proc))


def last_instant(processes: DataFrame, events: DataFrame) -> DataFrame:
    """One row, until: the time that the tables reach, of the last event or start."""
    times = events.select(micros(F.col("ts")).alias("us")).unionByName(processes.select(micros(F.col("start")).alias("us")))
    return times.agg(F.max("us").alias("until"))


def find(pattern: Pattern, processes: DataFrame, events: DataFrame, edges: DataFrame | None = None, exclusions: list[Exclusion] = (), window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US, since_us: int | None = None, until_us: int | None = None, last: DataFrame | None = None) -> DataFrame:
    """Findings before rate limiting: rule, severity, title, us, key, r_<role>.., excluded.

    Reports are made up to ``until_us``, the last event or start where that isn't given. A stream asks for those after
    ``since_us`` only, and tells the ``last`` report (key, last) of the keys that were reported before. Of bindings of one
    process set at one time the smallest by role order is reported. Suppression counts findings that an exclusion then drops;
    an exclusion looks at the images that the processes have at the time of the report.
    """
    names = [f"r_{r.id}" for r in pattern.roles]
    held = match_intervals(pattern, processes, events, edges, window_us, tolerance_us)
    if not names:
        return held.selectExpr("'' as rule", "'' as severity", "'' as title", "s as us", "'' as key", "false as excluded").limit(0)
    keyed = held.select(out.dedup_key(F.lit(pattern.name), [F.col(n) for n in names]).alias("key"), "s", "e", F.struct(*names).alias("bound"))
    if until_us is None:
        keyed = keyed.join(F.broadcast(last_instant(processes, events)))  # one row
    else:
        keyed = keyed.withColumn("until", F.lit(until_us).cast("long"))
    keyed = keyed.withColumn("e", F.least("e", F.col("until") + 1)).drop("until")
    if since_us is not None:
        keyed = keyed.withColumn("s", F.greatest("s", F.lit(since_us + 1)))
    keyed = keyed.filter("s < e")
    if last is not None:
        keyed = keyed.join(last.select("key", F.col("last").cast("long").alias("last")), "key", "left")
    kept = out.lasting(keyed, window_us)
    rows = kept.select(F.lit(pattern.name).alias("rule"), F.lit(pattern.severity).alias("severity"), F.lit(pattern.title).alias("title"), "us", "key", *(F.col(f"bound.{n}").alias(n) for n in names))
    mine = [x.match for x in exclusions if "*" in x.rules or pattern.name in x.rules]
    if not mine:
        return rows.withColumn("excluded", F.lit(False))
    bad = images(processes, events).filter(reduce(lambda a, m: a | block(m, PROCESS), mine, F.lit(False))).select(F.col("proc").alias("_bad"), "s", "e")
    then = (F.col("_proc") == F.col("_bad")) & (F.col("us") >= F.col("s")) & (F.col("us") < F.col("e"))
    hit = rows.select("key", "us", F.explode(F.array(*(F.col(n) for n in names))).alias("_proc")).join(bad, then, "left_semi").select(F.col("key").alias("_key"), F.col("us").alias("_us")).distinct()
    return rows.join(hit, (F.col("key") == F.col("_key")) & (F.col("us") == F.col("_us")), "left").withColumn("excluded", F.col("_key").isNotNull()).drop("_key", "_us")


_CAPTURES = "array<struct<name:string,event_id:bigint>>"


def sequence_evidence(pattern: Pattern, found: DataFrame, events: DataFrame, window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """(key, us, steps, captures): of each finding's assignments that are in the window at its time the first in the order of
    the steps' times and event ids, as event ids, and what it captured."""
    n, names = len(pattern.sequence.steps), [f"r_{r.id}" for r in pattern.roles]
    made = sequence_assignments(pattern, found.select("key", "us", *names), events, window_us, tolerance_us)
    for k in range(n):
        made = made.filter((F.col(f"t{k}") <= F.col("us")) & (F.col(f"t{k}") > F.col("us") - window_us))
    chosen = made.groupBy("key", "us").agg(F.min(F.struct(*(c for k in range(n) for c in (f"t{k}", f"id{k}")))).alias("x"))
    named = [F.struct(F.lit(s.capture).alias("name"), F.col(f"x.id{k}").cast("bigint").alias("event_id")) for k, s in enumerate(pattern.sequence.steps) if s.capture]
    return chosen.select("key", "us", F.array(*(F.col(f"x.id{k}").cast("bigint") for k in range(n))).alias("steps"), (F.array(*named) if named else F.array()).cast(_CAPTURES).alias("captures"))


def with_evidence(pattern: Pattern, found: DataFrame, processes: DataFrame, events: DataFrame, window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US, previous: int = 4) -> DataFrame:
    """``found`` with roles (role to process), evidence (event ids: the sequence's, an example of each requirement, the latest of
    each threshold; fifty at most), captures, and previous_images (role to the last images that its process had before)."""
    names = [f"r_{r.id}" for r in pattern.roles]
    why = requirement_evidence(pattern, found, events, window_us).select(F.col("key").alias("_k"), F.col("us").alias("_u"), F.col("evidence").alias("_own"))
    rows = found.join(why, (F.col("key") == F.col("_k")) & (F.col("us") == F.col("_u")), "left").drop("_k", "_u")
    none = F.array().cast("array<bigint>")
    if pattern.sequence:
        rows = rows.join(sequence_evidence(pattern, found, events, window_us, tolerance_us), ["key", "us"], "left")
    else:
        rows = rows.withColumns({"steps": none, "captures": F.array().cast(_CAPTURES)})
    was = images(processes, events).filter(F.col("e") < FOREVER).select("proc", "name", "exe", "cmdline", F.col("e").alias("replaced_at"))
    asked = found.select("key", "us", F.explode(F.array(*(F.struct(F.lit(r.id).alias("role"), F.col(f"r_{r.id}").alias("proc")) for r in pattern.roles))).alias("_r")).select("key", "us", "_r.*")
    newest = Window.partitionBy("key", "us", "role").orderBy(F.desc("replaced_at"))
    held = asked.join(was, "proc").filter("replaced_at <= us").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= previous)
    image = F.array_sort(F.collect_list(F.struct("replaced_at", "name", "exe", "cmdline"))).alias("images")
    by_role = held.groupBy("key", "us", "role").agg(image).groupBy("key", "us").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "images")))).alias("previous_images"))
    rows = rows.join(by_role, ["key", "us"], "left")
    roles = F.create_map(*(x for r in pattern.roles for x in (F.lit(r.id), F.col(f"r_{r.id}").cast("string"))))
    return rows.withColumns({"roles": roles, "evidence": out.evidence(F.coalesce("steps", none), F.coalesce("_own", none), none), "captures": F.coalesce("captures", F.array().cast(_CAPTURES))}).drop("steps", "_own", *names)


def detect(patterns: list[Pattern], processes: DataFrame, events: DataFrame, edges: DataFrame | None = None, exclusions: list[Exclusion] = (), window_us: int = WINDOW_US, tolerance_us: int = TOLERANCE_US) -> DataFrame:
    """All findings of all patterns after exclusions and rate limits: finding_id, rule, severity, title, us, key, and what
    ``with_evidence`` adds, which is looked up for the findings that are left only, once these have been written."""
    parts = []
    if edges is None and any(p.edges for p in patterns):
        edges = settled(parent_edges(processes))
    for p in patterns:
        rows = find(p, processes, events, edges, exclusions, window_us, tolerance_us).filter(~F.col("excluded")).drop("excluded")
        if not p.roles:
            continue
        kept = settled(out.rate_limit(rows, window_us, p.max_findings).filter("kept").drop("kept", "window"))
        parts.append(with_evidence(p, kept, processes, events, window_us, tolerance_us))
    return out.with_ids(reduce(DataFrame.unionByName, parts))
