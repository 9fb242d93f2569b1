"""Live detection: Structured Streaming micro-batches through the batch plans.

Processes arrive as events, beside those that are seeded. What a batch needs of the batches before lies in the shared folder:
the events of the last two windows, by batch and by a bucket of time, and one state a batch: the processes that are
alive or visible, the program changes that tell their images, and the reports of the last window, from which suppression and
rate windows go on. Each batch reads the state of the one before and writes its own, with a marker at last, so a batch that is
repeated after a failure replaces itself; states and events that are past are deleted.

A report is made in the batch that reaches its time, from the same intervals as in a batch over the whole history, so both
report the same findings if events come in order. Late ones, up to two windows, count from then on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import rate_limit
from ..operators.graph import parent_edges
from ..operators.lifecycle import arrived
from ..operators.thresholds import micros, newest
from ..plans import dsl, matcher

_REPORTS = "rule string, severity string, title string, us long, key string, excluded boolean, most int, kept boolean, opened long, epoch int"
#: Program changes of a process that are kept, as many as a finding shows and the one that tells its image.
KEPT_IMAGES = 5


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A folder of event files as a stream. ``max_files`` a batch is the back-pressure: what is more waits in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


class LiveDetector:
    """``found``: the patterns and exclusions; a ``reloader`` is asked for others before each batch, and the last good ones stay.
    ``processes``: those that run before the first event."""

    def __init__(self, spark: SparkSession, found: dsl.PatternSet, processes: DataFrame, folder: str, window_us: int = matcher.WINDOW_US, tolerance_us: int = matcher.TOLERANCE_US, reloader: dsl.Reloader | None = None):
        self.spark, self.found, self.seed, self.folder, self.window_us, self.tolerance_us, self.reloader = spark, found, processes, folder.rstrip("/"), window_us, tolerance_us, reloader
        self.epoch = max((int(n.removeprefix("epoch-")) for n in self._names("") if n.startswith("epoch-")), default=0)

    def set_patterns(self, found: dsl.PatternSet) -> None:
        """Start anew with other patterns: nothing is suppressed or held back by what was reported before."""
        self.found, self.epoch = found, self.epoch + 1
        fs, at = self._files(f"{self.folder}/epoch-{self.epoch}")
        fs.create(at).close()

    def reload(self, found: dsl.PatternSet) -> None:
        """Go on with changed patterns: what was reported is still suppressed, and rate windows stay open."""
        self.found = found

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._files(f"{self.folder}/{path}")
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._files(f"{self.folder}/{path}")
        fs.delete(at, True)

    def _before(self, batch_id: int) -> tuple[str, int] | None:
        """(folder, time reached) of the last finished state before this batch."""
        numbers = sorted((int(n.removeprefix("batch=")) for n in self._names("state")), reverse=True)
        for n in numbers:
            if n < batch_id:
                for name in self._names(f"state/batch={n}"):
                    if name.startswith("reached-"):
                        return f"{self.folder}/state/batch={n}", int(name.removeprefix("reached-"))
        return None

    def _events(self, schema, batch_id: int, since_us: int) -> DataFrame:
        """Events of the batches before, from the bucket of ``since_us`` on."""
        if not self._names("events"):
            return self.spark.createDataFrame([], schema)
        columns = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
        stored = self.spark.read.schema(f"{columns}, batch long, bucket long").parquet(f"{self.folder}/events")
        return stored.filter((F.col("batch") < batch_id) & (F.col("bucket") >= since_us // self.window_us)).drop("batch", "bucket")

    def _expire(self, before_us: int, batch_id: int) -> None:
        """Delete the events of batches all of whose buckets are past, and the states before the last."""
        for batch in self._names("events"):
            buckets = [n for n in self._names(f"events/{batch}") if n.startswith("bucket=")]
            if buckets and all(int(b.removeprefix("bucket=")) < before_us // self.window_us for b in buckets):
                self._delete(f"events/{batch}")
        for name in self._names("state"):
            if int(name.removeprefix("batch=")) < batch_id - 1:
                self._delete(f"state/{name}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        if self.reloader is not None and self.reloader.poll():
            self.reload(self.reloader.current)
        batch = batch.persist()
        us = micros(F.col("ts"))
        before = self._before(batch_id)
        reached = before[1] if before else None
        top = batch.agg(F.max(us)).first()[0]
        if top is None:
            batch.unpersist()
            return
        top = max(top, reached if reached is not None else top)
        since = reached - 2 * self.window_us if reached is not None else -(1 << 62)
        own = batch.filter(us > since)
        state = (lambda name: self.spark.read.parquet(f"{before[0]}/{name}")) if before else None
        at = f"state/batch={batch_id}"
        self._delete(at)
        # what the plans of all patterns read is written first, so that none of them derives it anew
        bucket = F.floor(us / self.window_us).cast("long")
        own.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/events/batch={batch_id}")
        known = arrived(state("processes") if before else self.seed, own)
        known = self._write(known, f"{at}/known")
        execs = own.filter("type = 'PROCESS_EXEC'")
        execs = newest(state("execs").unionByName(execs) if before else execs, ["proc"], KEPT_IMAGES).unionByName(execs).dropDuplicates(["event_id"])
        execs = self._write(execs.join(known.select("proc"), "proc", "left_semi").select(*own.columns), f"{at}/execs")
        seen = self._events(batch.schema, batch_id + 1, since).filter((us > since) & (F.col("type") != "PROCESS_EXEC")).unionByName(execs)
        old = state("reports").filter(F.col("epoch") == self.epoch) if before else self.spark.createDataFrame([], _REPORTS)
        last = old.groupBy("key").agg(F.max("us").alias("last"))
        edges = self._write(parent_edges(known), f"{at}/edges") if any(p.edges for p in self.found.patterns) else None
        parts = [matcher.find(p, known, seen, edges, self.found.exclusions, self.window_us, self.tolerance_us, reached, top, last).select("rule", "severity", "title", "us", "key", "excluded", F.lit(p.max_findings).alias("most")) for p in self.found.patterns if p.roles]
        new = self._write(reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _REPORTS).select("rule", "severity", "title", "us", "key", "excluded", "most"), f"{at}/new")
        # the rate windows of a rule go on from the last one that opened
        opened = old.filter("not excluded").groupBy(F.col("rule").alias("_rule")).agg(F.max("opened").alias("_opened"))
        counted = old.filter("not excluded").join(opened, F.col("rule") == F.col("_rule")).filter(F.col("us") >= F.col("_opened")).select(*new.columns, F.lit(False).alias("new"))
        limited = rate_limit(counted.unionByName(new.filter("not excluded").withColumn("new", F.lit(True))), self.window_us, "most")
        limited = limited.withColumn("opened", F.min("us").over(Window.partitionBy("rule", "window"))).filter("new").drop("new", "window")
        excluded = new.filter("excluded").withColumns({"kept": F.lit(False), "opened": F.lit(None).cast("long")})
        said = self._write(limited.unionByName(excluded).withColumn("epoch", F.lit(self.epoch)), f"findings/batch={batch_id}")
        self._write(old.unionByName(said).filter(F.col("us") > top - self.window_us), f"{at}/reports")
        self._write(known.filter(F.col("exited_at").isNull() | (micros(F.col("exited_at")) > top - self.window_us)), f"{at}/processes")
        fs, marker = self._files(f"{self.folder}/{at}/reached-{top}")
        fs.create(marker).close()
        self._expire(top - 2 * self.window_us, batch_id)
        batch.unpersist()

    def _write(self, rows: DataFrame, path: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{path}")

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def findings(self) -> DataFrame:
        """What was reported: rule, severity, title, us, key."""
        return self.spark.read.schema(f"{_REPORTS}, batch long").parquet(f"{self.folder}/findings").filter("kept").select("rule", "severity", "title", "us", "key")
