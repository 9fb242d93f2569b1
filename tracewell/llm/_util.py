"""Shared storage and Arrow helpers of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy working set holds; a longer text is a set of its own.
CHUNK_BYTES = 2 << 20
#: Bits that tell which keys have a partner: at most 1 << (SIFT - 6) words go to every executor, at any size of the input.
SIFT = 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one of the session where local mode
    leaves it unset (a running session can't set it)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tracewell.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    spark.conf.set("tracewell.shared.dir", path)
    return path


def stash(df: DataFrame, name: str, tiny: bool = False, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and survives a lost executor.

    The shuffle files that led to it can go, unless they are likely ``tiny`` and not worth the wait; such a table, or one
    said to need ``few`` files, gets files of the advisory size instead of one for each task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if tiny or few else df).write.parquet(path)
    if not tiny:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote, when nothing that is still to run reads it."""
    for df in stashed:
        jvm, path = df.sparkSession.sparkContext._jvm, df.stashed_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, which it does when the driver's garbage is collected.

    The JVM learns of Python's dead objects a moment later, so a single collection would find them still in use.
    """
    for pause in (0.2, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one data folder; Arrow batches are kept small, as one text may be very long."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in whatever case."""
    held = {c.lower() for c in df.columns}
    return [name for k in range(n + len(held)) if (name := f"helper{k}") not in held][:n]


def sift(rows: DataFrame, key: str, wanted: DataFrame, other: str) -> DataFrame:
    """The ``rows`` whose key has the bit of one of ``wanted``: all that have a partner there, and few others, so that a
    join that follows need not move the rest."""
    at, word, bits = unused(rows, 3)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIFT))
    bit = wanted.select(place(other).alias(at)).select(F.expr(f"{at} div 64").alias(word), F.expr(f"shiftleft(1L, cast({at} % 64 as int))").alias(bits))
    words = F.broadcast(bit.groupBy(word).agg(F.bit_or(bits).alias(bits)))
    held = rows.withColumn(at, place(key)).withColumn(word, F.expr(f"{at} div 64")).join(words, word)
    return held.filter(F.expr(f"(shiftrightunsigned({bits}, cast({at} % 64 as int)) & 1) = 1")).select(*rows.columns)


def tidy() -> None:
    """Give what Arrow keeps for reuse back to the system at the end of a task: the worker serves other operators, too."""
    pa.default_memory_pool().release_unused()


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts together hold about ``limit`` bytes; always whole rows."""
    for batch in batches:
        ends = flat(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1
            to = min(batch.num_rows, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def many(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``rows`` rows together, and never of none."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= rows:
            yield held
            held = []
    if any(x.num_rows for x in held):
        yield held


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying each text; a null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
