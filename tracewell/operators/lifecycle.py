"""Events from snapshots and kernel records: differences, folding of fork and exec, usage rates, image history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import FOREVER
from .thresholds import micros


def snapshot_diff(snapshots: DataFrame, key: list[str], number: str = "snap", started: str = "START", ended: str = "EXIT") -> DataFrame:
    """(snap, key.., event) of what appears in a snapshot, or is gone from it, against the one before. The first is the
    baseline. Snapshots are numbered without gaps; one window over each key finds both kinds."""
    first = snapshots.agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    w = Window.partitionBy(*key).orderBy(number)
    seen = snapshots.select(number, *key).distinct().withColumns({"_before": F.lag(number).over(w), "_after": F.lead(number).over(w)}).join(F.broadcast(first))
    new = seen.filter((F.col(number) > F.col("lo")) & (F.col("_before").isNull() | (F.col("_before") < F.col(number) - 1))).select(number, *key, F.lit(started).alias("event"))
    gone = seen.filter((F.col(number) < F.col("hi")) & (F.col("_after").isNull() | (F.col("_after") > F.col(number) + 1))).select((F.col(number) + 1).alias(number), *key, F.lit(ended).alias("event"))
    return new.unionByName(gone)


def fold_fork_exec(records: DataFrame, grace_us: int = 50_000) -> DataFrame:
    """(pid, start, at, event, exe) from kernel records (kind, pid, start, at in microseconds, exe).

    An exec at most ``grace_us`` after its fork is the start; a later one follows a start at the fork. A process whose PID
    comes with another start ended unseen.
    """
    w = Window.partitionBy("pid", "start").orderBy("at")
    following = records.withColumns({"_kind": F.lead("kind").over(w), "_at": F.lead("at").over(w), "_exe": F.lead("exe").over(w), "_before": F.lag("kind").over(w), "_began": F.lag("at").over(w)})
    fused = (F.col("kind") == "fork") & (F.col("_kind") == "exec") & (F.col("_at") - F.col("at") <= grace_us)
    follower = (F.col("kind") == "exec") & (F.col("_before") == "fork") & (F.col("at") - F.col("_began") <= grace_us)
    event = F.when(F.col("kind") == "fork", "PROCESS_START").when((F.col("kind") == "exec") & F.col("_before").isNull(), "PROCESS_START").when(F.col("kind") == "exec", "PROCESS_EXEC").otherwise("PROCESS_EXIT")
    rows = following.filter(~F.coalesce(follower, F.lit(False))).select("pid", "start", F.when(fused, F.col("_at")).otherwise(F.col("at")).alias("at"), event.alias("event"), F.when(fused, F.col("_exe")).otherwise(F.col("exe")).alias("exe"), F.lit(False).alias("inferred"))
    lives = records.groupBy("pid", "start").agg(F.max(F.col("kind") == "exit").alias("ended"))
    after = F.lead("start").over(Window.partitionBy("pid").orderBy("start"))
    lost = lives.withColumn("at", after).filter("not ended and at is not null").select("pid", "start", "at", F.lit("PROCESS_EXIT").alias("event"), F.lit(None).cast("string").alias("exe"), F.lit(True).alias("inferred"))
    return rows.unionByName(lost)


def usage_rates(usage: DataFrame, key: list[str], number: str = "snap", counter: str = "cpu_seconds", time: str = "seconds") -> DataFrame:
    """cpu_percent against the snapshot directly before; null if there is none or the counter fell."""
    w = Window.partitionBy(*key).orderBy(number)
    before, at, n = F.lag(counter).over(w), F.lag(time).over(w), F.lag(number).over(w)
    ok = (n == F.col(number) - 1) & (F.col(counter) >= before) & (F.col(time) > at)
    return usage.withColumn("cpu_percent", F.when(ok, (F.col(counter) - before) / (F.col(time) - at) * 100))


def image_history(execs: DataFrame, keep: int = 4) -> DataFrame:
    """(proc, image, valid_from, valid_to, previous): the images of a process over time and the last ``keep`` replaced
    ones. Events are (proc, at, image); unchanged and empty images are ignored."""
    w = Window.partitionBy("proc").orderBy("at")
    real = execs.filter(F.coalesce(F.col("image"), F.lit("")) != "").withColumn("_old", F.lag("image").over(w)).filter("_old is null or _old != image")
    before = F.collect_list("image").over(w.rowsBetween(-keep, -1))
    return real.select("proc", "image", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"), before.alias("previous"))


def images(processes: DataFrame, events: DataFrame) -> DataFrame:
    """(proc, name, exe, cmdline, user, s, e): the image of each process over time, in microseconds, from the one it started
    with on. A PROCESS_EXEC event replaces it, unless it says nothing or nothing new; a user that it doesn't tell stays."""
    fields = ("name", "exe", "cmdline")
    text = lambda df, c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    first = processes.select("proc", *(text(processes, c).alias(c) for c in (*fields, "user")), F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("_n"))
    execs = events.filter(F.col("type") == "PROCESS_EXEC").select("proc", *(text(events, c).alias(c) for c in (*fields, "user")), micros(F.col("ts")).alias("s"), F.col("event_id").cast("long").alias("_n"))
    order = Window.partitionBy("proc").orderBy(F.col("_n") >= 0, "s", "_n")
    said = first.unionByName(execs.filter("name != '' or exe != '' or cmdline != ''")).withColumn("_image", F.struct(*fields)).withColumns({"_old": F.lag("_image").over(order), "_known": F.first("_n").over(order) < 0})
    kept = said.filter("_known and (_old is null or _old != _image)")
    user = F.coalesce(F.last(F.when(F.col("user") != "", F.col("user")), ignorenulls=True).over(order), F.lit(""))
    return kept.withColumns({"user": user, "e": F.coalesce(F.lead("s").over(order), F.lit(FOREVER))}).select("proc", *fields, "user", "s", "e").filter("s < e")


def arrived(processes: DataFrame, events: DataFrame) -> DataFrame:
    """``processes`` with those that ``events`` start and end: proc, pid, ppid, start, exited_at, name, exe, cmdline, user.

    A process is as its first PROCESS_START describes it, unless it was known before; its earliest exit counts. Events that
    don't have a start of their own start their process at their time; an exit of an unknown process is passed over.
    """
    columns = ["proc", "pid", "ppid", "start", "exited_at", "name", "exe", "cmdline", "user"]
    have = lambda c: F.col(c) if c in events.columns else F.lit(None)
    kinds = {f.name: f.dataType for f in processes.schema}
    began = events.filter(F.col("type") == "PROCESS_START")
    told = {"start": F.coalesce(have("start").cast(kinds["start"]), F.col("ts").cast(kinds["start"])), "exited_at": F.lit(None)}
    new = began.select(*(told.get(c, have(c)).cast(kinds[c]).alias(c) for c in columns), micros(F.col("ts")).alias("_at"), F.col("event_id").alias("_n"))
    known = processes.select(*columns, F.lit(0).cast("long").alias("_at"), F.lit(-1).cast("long").alias("_n"))
    gone = events.filter(F.col("type") == "PROCESS_EXIT").select("proc", F.col("ts").cast(kinds["exited_at"]).alias("_exit"))
    both = known.unionByName(new).groupBy("proc").agg(F.min_by(F.struct(*columns[1:]), F.struct(F.col("_n") >= 0, "_at", "_n")).alias("x"))
    ended = both.join(gone.groupBy("proc").agg(F.min("_exit").alias("_exit")), "proc", "left").select("proc", "x.*", "_exit")
    return ended.withColumn("exited_at", F.least("exited_at", "_exit")).select(*columns)


def reconcile(tracked: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Tracked but not listed: an inferred exit; listed but not tracked: a reconciled start."""
    gone = tracked.join(listed, key, "left_anti").select(*key, F.lit("PROCESS_EXIT").alias("event"))
    return gone.unionByName(listed.join(tracked, key, "left_anti").select(*key, F.lit("PROCESS_START").alias("event")))


def reconcile_listing(tracked: DataFrame, listed: DataFrame, taken_us: int | Column, margin_us: int = 2_000_000) -> DataFrame:
    """(pid, start, at, event, inferred, reconciled) that repair what lost events left wrong, against a listing of processes
    (pid, start, in microseconds) taken at ``taken_us``.

    What was first seen (``seen``) or started within ``margin_us`` of the listing is left alone, as its events may not have been
    read yet, and so is a fork that is still held back (``pending``) and what has the PID of a process that stays tracked. An
    exit is as of the listing, a start as of its own time; an unknown start is passed over.
    """
    settled = (taken_us if isinstance(taken_us, Column) else F.lit(taken_us)) - margin_us
    same = listed.select(F.col("pid").alias("_pid"), F.col("start").alias("_start"))
    known = (F.coalesce("start", F.lit(0)) > 0) & (F.coalesce("_start", F.lit(0)) > 0)
    alive = (F.col("pid") == F.col("_pid")) & (~known | (F.col("start") == F.col("_start")))
    old = ~F.col("pending") & (F.col("seen") < settled)
    gone = tracked.filter(old).join(same, alive, "left_anti")
    stays = tracked.join(gone.select("pid"), "pid", "left_anti").select("pid")
    found = listed.filter((F.col("start") > 0) & (F.col("start") < settled)).join(stays, "pid", "left_anti")
    ended = gone.select("pid", "start", (settled + margin_us).alias("at"), F.lit("PROCESS_EXIT").alias("event"), F.lit(True).alias("inferred"), F.lit(False).alias("reconciled"))
    return ended.unionByName(found.select("pid", "start", F.col("start").alias("at"), F.lit("PROCESS_START").alias("event"), F.lit(False).alias("inferred"), F.lit(True).alias("reconciled")))


def inherit(starts: DataFrame, images: DataFrame) -> DataFrame:
    """Forked processes (proc, parent, at, and their own name, exe, cmdline, user) with the image that their parent had then.

    ``images``: (proc, at, name, exe, cmdline, user), whenever one changed. A fork runs its parent's program; its own record
    counts only where the parent is unknown, and for the user if it has one.
    """
    fields = ("name", "exe", "cmdline", "user")
    known = images.select(F.col("proc").alias("_key"), F.col("at").alias("_at"), F.lit(0).alias("_side"), F.struct(*fields).alias("_image"))
    asked = starts.select(F.col("parent").alias("_key"), F.col("at").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_image"].dataType).alias("_image"), F.struct(*starts.columns).alias("_row"))
    both = known.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked)
    upto = Window.partitionBy("_key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_image", F.last("_image", ignorenulls=True).over(upto)).filter("_side = 1")
    rows = met.select("_row.*", "_image")
    own = {f: F.when(F.col("_image").isNotNull(), F.col(f"_image.{f}")).otherwise(F.col(f)) for f in fields}
    own["user"] = F.when(F.coalesce(F.col("user"), F.lit("")) != "", F.col("user")).otherwise(F.col("_image.user"))
    return rows.withColumns(own).withColumn("partial", F.col("_image").isNull() & (F.coalesce(F.col("exe"), F.lit("")) == "")).drop("_image")
