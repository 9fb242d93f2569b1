"""Process ancestry: as-of parents under PID reuse, and bounded descent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 16
#: Later than any time in microseconds.
FOREVER = (1 << 62) - 1


def with_derived_exit(processes: DataFrame) -> DataFrame:
    """A later holder of a PID ends the earlier one."""
    following = F.lead("start").over(Window.partitionBy("pid").orderBy("start", "proc"))
    return processes.withColumn("exited_at", F.least("exited_at", following))


def parent_edges(processes: DataFrame) -> DataFrame:
    """(parent, child): each process's parent is the latest holder of its ppid that started no later and hadn't exited.

    Exits are derived first, so of all holders before a start only the latest can be alive, or the one before it where that
    is the process itself or both meet in one instant. Holders and children of a PID are therefore read once in the order of
    start; no child meets all holders. Processes of unknown start, which fit any time, are joined instead.
    """
    held = with_derived_exit(processes)
    one = lambda: F.struct(F.col("start").alias("start"), F.col("proc").alias("proc"), F.col("exited_at").alias("exited_at"))
    order = Window.partitionBy("pid").orderBy("start", "proc")
    known = held.filter("start is not null")
    holders = known.withColumns({"_own": one(), "_before": F.lag(one()).over(order)}).select(F.col("pid").alias("_pid"), "start", F.lit(0).alias("_side"), "proc", "_own", "_before")
    children = known.select(F.col("ppid").alias("_pid"), "start", F.lit(1).alias("_side"), "proc", *(F.lit(None).cast(holders.schema[c].dataType).alias(c) for c in ("_own", "_before"))).filter("_pid is not null")
    upto = Window.partitionBy("_pid").orderBy("start", "_side", "proc").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(F.when(F.col("_side") == 0, F.struct("_own", "_before")), ignorenulls=True).over(upto)[c]
    met = holders.unionByName(children).withColumns({"_first": last("_own"), "_second": last("_before")}).filter("_side = 1")
    alive = lambda c: F.when((F.col(f"{c}.proc") != F.col("proc")) & (F.col(f"{c}.exited_at").isNull() | (F.col(f"{c}.exited_at") >= F.col("start"))), F.col(c))
    asof = met.withColumn("_at", F.coalesce(alive("_first"), alive("_second"))).filter("_at is not null").select(F.col("proc").alias("child"), F.col("_at.proc").alias("parent"), F.col("_at.start").alias("start"))
    child = held.select(F.col("proc").alias("child"), F.col("ppid").alias("_ppid"), F.col("start").alias("_started"))
    other = held.select(F.col("proc").alias("parent"), "pid", "start", "exited_at")
    unknown = (F.col("start").isNull() | F.col("_started").isNull()) & (F.col("exited_at").isNull() | F.coalesce(F.col("exited_at") >= F.col("_started"), F.lit(False)))
    on = (F.col("_ppid") == F.col("pid")) & (F.col("parent") != F.col("child")) & unknown
    loose = child.filter("_started is null").join(other, on).unionByName(child.filter("_started is not null").join(other.filter("start is null"), on)).select("child", "parent", "start")
    return asof.unionByName(loose).groupBy("child").agg(F.max_by("parent", F.struct("start", "parent")).alias("parent")).select("parent", "child")


def descendants(edges: DataFrame, max_depth: int, ends: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant, depth) up to ``max_depth`` generations, and until, the time up to which all in between are known,
    where ``ends`` (proc, e) tells that of each.

    A process has one parent, so the rows of one pass carry the ancestors found so far, and each generation is one join with
    the edges: ``max_depth`` - 1 joins in all, of as many rows as there are edges.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"max_depth must be between 1 and {MAX_DEPTH}")
    up = edges.select(F.col("parent").alias("_up"), F.col("child").alias("_down"))
    if ends is not None and max_depth > 1:
        up = up.join(ends.select(F.col("proc").alias("_down"), F.col("e").alias("_end")), "_down")
    else:
        up = up.withColumn("_end", F.lit(FOREVER))
    one = lambda p, e: F.struct(p.alias("proc"), e.alias("until"))
    rows = edges.select(F.col("child").alias("descendant"), F.col("parent").alias("_top"), F.lit(FOREVER).alias("_least"), F.array(one(F.col("parent"), F.lit(FOREVER))).alias("_above"))
    for _ in range(2, max_depth + 1):
        met = rows.join(up, F.col("_top") == F.col("_down"), "left").withColumn("_least", F.least("_least", "_end"))
        above = F.when(F.col("_up").isNotNull(), F.array_append("_above", one(F.col("_up"), F.col("_least")))).otherwise(F.col("_above"))
        rows = met.select("descendant", F.col("_up").alias("_top"), "_least", above.alias("_above"))
    found = rows.select("descendant", F.posexplode("_above").alias("_n", "_x"))
    kept = ("until",) if ends is not None else ()
    return found.select(F.col("_x.proc").alias("ancestor"), "descendant", (F.col("_n") + 1).alias("depth"), *(F.col(f"_x.{c}").alias(c) for c in kept))


def snapshot_tree(snapshot: DataFrame) -> DataFrame:
    """Each process of a snapshot with its children's PIDs."""
    kids = snapshot.groupBy(F.col("ppid").alias("_of")).agg(F.array_sort(F.collect_list("pid")).alias("children"))
    return snapshot.join(kids, F.col("pid") == F.col("_of"), "left").drop("_of").withColumn("children", F.coalesce("children", F.array().cast("array<long>")))


def canonical(events: DataFrame, processes: DataFrame) -> DataFrame:
    """Events (pid, ts, proc, proc_start) whose process has an unknown start get the live holder of the PID then, if there is one."""
    order = Window.partitionBy("_pid").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    held = with_derived_exit(processes).filter("start is not null").select(F.col("pid").alias("_pid"), F.col("start").alias("_at"), F.lit(0).alias("_side"), F.struct("proc", "exited_at").alias("_holder"))
    asked = events.select(F.col("pid").alias("_pid"), F.col("ts").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(held.schema["_holder"].dataType).alias("_holder"), F.struct(*events.columns).alias("_row"))
    both = held.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    met = both.withColumn("_holder", F.last("_holder", ignorenulls=True).over(order)).filter("_side = 1").select("_row.*", "_holder")
    alive = F.col("_holder.exited_at").isNull() | (F.col("_holder.exited_at") > F.col("ts"))
    unknown = F.col("proc_start").isNull() | (F.col("proc_start") <= F.lit("1970-01-01").cast("timestamp"))
    return met.withColumn("proc", F.when(unknown & F.col("_holder").isNotNull() & alive, F.col("_holder.proc")).otherwise(F.col("proc"))).drop("_holder")


def describe(known: DataFrame, tracked: DataFrame, listed: DataFrame) -> DataFrame:
    """(pid, start, exe, via): what is tracked under the same identity and has an executable, else what a listing shows of the PID."""
    own = tracked.filter(F.coalesce(F.col("exe"), F.lit("")) != "").select("pid", "start", F.col("exe").alias("_tracked"))
    now = listed.select("pid", F.col("exe").alias("_listed")).dropDuplicates(["pid"])
    via = F.when(F.col("_tracked").isNotNull(), "tracked").when(F.col("_listed").isNotNull(), "listed").otherwise("none")
    return known.join(own, ["pid", "start"], "left").join(now, "pid", "left").select("pid", "start", F.coalesce("_tracked", "_listed").alias("exe"), via.alias("via"))
