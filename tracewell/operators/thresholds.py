"""Event requirements: presence, counts and distinct counts in sliding windows, as range frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of the wall-clock time, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _span(by: list[str], within_us: int) -> Window:
    """Strictly less than ``within_us`` between the first and the last event."""
    return Window.partitionBy(*by).orderBy("us").rangeBetween(-(within_us - 1), 0)


def count_met(events: DataFrame, by: list[str], count: int, within_us: int) -> DataFrame:
    """The events at which ``count`` events of a group lie within less than ``within_us``; column n: how many do."""
    return events.withColumn("us", micros(F.col("ts"))).withColumn("n", F.count(F.lit(1)).over(_span(by, within_us))).filter(F.col("n") >= count).drop("us")


def distinct_met(events: DataFrame, by: list[str], value: str, count: int, within_us: int) -> DataFrame:
    """As ``count_met`` for distinct values; missing ones don't count.

    A sighting counts until the span is over or the value is seen again, so the count is a running sum of plus and minus ones,
    and no set of values is held.
    """
    seen = events.filter(F.coalesce(F.col(value).cast("string"), F.lit("")) != "").withColumn("us", micros(F.col("ts")))
    again = F.lead("us").over(Window.partitionBy(*by, value).orderBy("us"))
    here = seen.withColumn("_until", F.least(F.col("us") + within_us, again)).withColumn("_step", F.explode(F.array(F.lit(1), F.lit(-1))))
    steps = here.withColumn("us", F.when(F.col("_step") > 0, F.col("us")).otherwise(F.col("_until")))
    open_now = F.sum("_step").over(Window.partitionBy(*by).orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("n", open_now).filter((F.col("_step") > 0) & (F.col("n") >= count)).drop("us", "_until", "_step")


def newest(events: DataFrame, by: list[str], keep: int = 64) -> DataFrame:
    """The newest ``keep`` events of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= keep).drop("_rank")


def truncated(events: DataFrame, by: list[str], keep: int = 64) -> DataFrame:
    """How many events of each group a cap of ``keep`` would drop, where it drops any."""
    counts = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > keep).withColumn("dropped", F.col("n") - keep).drop("n")


def still_met(met: DataFrame, asked: DataFrame, by: list[str], window_us: int) -> DataFrame:
    """Times (by.., us) that are asked about, with whether a threshold, met at the times of ``met``, holds: its span's end is
    less than a window ago."""
    both = met.select(*by, "us", F.lit(True).alias("_met")).unionByName(asked.select(*by, "us", F.lit(False).alias("_met")))
    last = F.max(F.when(F.col("_met"), F.col("us"))).over(Window.partitionBy(*by).orderBy("us").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("holds", F.coalesce(last > F.col("us") - window_us, F.lit(False))).filter("not _met").drop("_met")


def islands(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Merged [s, e) intervals of each group; ones that touch join."""
    w = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = intervals.withColumn("_new", (before.isNull() | (F.col("s") > before)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def all_hold(intervals: DataFrame, by: list[str], needed: int) -> DataFrame:
    """[s, e) in which all of ``needed`` kinds of merged intervals (column kind) hold: a counting sweep."""
    edges = intervals.select(*by, F.col("s").alias("t"), F.lit(1).alias("d")).unionByName(intervals.select(*by, F.col("e").alias("t"), F.lit(-1).alias("d")))
    steps = edges.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("t")
    swept = steps.withColumn("open", F.sum("d").over(w)).withColumn("until", F.lead("t").over(w)).filter(F.col("open") == needed)
    return islands(swept.select(*by, F.col("t").alias("s"), F.col("until").alias("e")), by)
