"""The event log: queries, retention, and metrics over it."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEFAULT_LIMIT, DEFAULT_RETENTION_DAYS, TAB_LINES = 200, 7, 500
TIME_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that what is planned over it several times does not repeat what it
    takes; as it is where the session has none."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df


def append(rows: DataFrame, path: str, load: str | None = None) -> None:
    """Add to a log partitioned by tab, day and load; rows of one partition are gathered, so that an append adds few files.
    A load that is repeated under its name replaces itself."""
    named = rows.withColumns({"day": F.to_date("ts"), "load": F.lit(load or uuid.uuid4().hex)})
    named.hint("rebalance", "tab", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tab", "day", "load").parquet(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, name: str = "stream", every: str = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """A stream of rows to the log, a load a batch. Nothing is dropped when writing is slow: batches grow. A batch that is repeated
    after a failure replaces itself; each stream into one log has its own ``name``."""
    writer = rows.writeStream.foreachBatch(lambda batch, n: append(batch, path, f"{name}-{n}")).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def open_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that ``append`` wrote, with its partition columns; ``schema`` is that of the rows, without tab."""
    return spark.read.schema(f"{schema}, tab string, day date, load string").parquet(path)


def log_query(log: DataFrame, tab: str | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None, limit: int = 0) -> DataFrame:
    """The first rows by id of a tab and a time span, both ends included. Of a log with days only the tab's days are read."""
    if tab is not None:
        log = log.filter(F.col("tab") == tab)
    for bound, keep in ((since, "__ge__"), (until, "__le__")):
        if bound is not None:
            log = log.filter(getattr(F.col("ts"), keep)(F.lit(bound)))
            if "day" in log.columns:
                log = log.filter(getattr(F.col("day"), keep)(F.lit(bound.date())))
    return log.orderBy("id").limit(limit if limit > 0 else DEFAULT_LIMIT)


def drop_expired(spark: SparkSession, path: str, now: dt.datetime, days: int = DEFAULT_RETENTION_DAYS) -> list[str]:
    """Delete the days of a log that are wholly past, without reading a row, and tell which; rows of the day of the cutoff stay
    until it is past, and ``retention`` passes over them. A setting that isn't positive means the default."""
    cutoff = (now - dt.timedelta(days=days if days > 0 else DEFAULT_RETENTION_DAYS)).date().isoformat()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for found in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/tab=*/day=*")) or []:
        at = found.getPath()
        if at.getName().removeprefix("day=") < cutoff:
            fs.delete(at, True)
            gone.append(f"{at.getParent().getName()}/{at.getName()}")
    return sorted(gone)


def recent(log: DataFrame, n: int = TAB_LINES) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return log.orderBy(F.desc("id")).limit(n).orderBy("id")


def recent_per_tab(log: DataFrame, n: int = TAB_LINES) -> DataFrame:
    w = Window.partitionBy("tab").orderBy(F.desc("id"))
    return log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def retention(log: DataFrame, now: Column, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    days = days if days > 0 else DEFAULT_RETENTION_DAYS
    return log.filter(F.col("ts") >= now - F.expr(f"interval {days} days"))


def parse_time(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_LAYOUTS))


def latency_quantile(samples: DataFrame, value: str, q: float, by: list[str]) -> DataFrame:
    """The quantile from quarter-octave buckets: the ceiling of the bucket of rank floor(q (n - 1)) + 1, at most the maximum."""
    bucket = F.greatest(F.ceil(F.log2(F.col(value)) * 4), F.lit(0)).cast("int")
    counts = samples.withColumn("_b", bucket).groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_max"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_b")), "_all": F.sum("_n").over(group), "_top": F.max("_max").over(group)})
    rank = F.floor((F.col("_all") - 1) * q) + 1
    hit = ranked.filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank))
    return hit.select(*by, F.least(F.pow(F.lit(2.0), F.col("_b") / 4), F.col("_top")).alias("latency"))


def order_usage(usage: DataFrame, by: str) -> DataFrame:
    """Largest first, unreadable last, then by PID."""
    return usage.orderBy(F.col(by).desc_nulls_last(), "pid")
