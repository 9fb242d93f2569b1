"""Schemas of raw records, and their projections to telemetry. Capture itself is left to whatever writes these records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import connect_result, connection_ms, dns_type, file_event_type, image_name, join_argv

#: Kernel process records, snapshots of processes and of resource use, and captured packets.
PROCESS_RECORDS = "kind string, pid int, ppid int, start long, at long, comm string, exe string, cmdline string, argv0 string, user string"
PROCESS_SNAPSHOTS = "snap long, pid int, ppid int, start timestamp, name string, exe string, cmdline string, user string"
RESOURCE_SAMPLES = "snap long, pid int, cpu_seconds double, cpu_valid boolean, rss_bytes long, rss_valid boolean"
PACKETS = "ts timestamp, protocol string, src_port int, dst_port int, dst_ip string, response boolean, questions array<struct<name:string,type:int>>"
PROC_FILES = "pid int, stat string, status string, cmdline string, exe string"
# States of snapshot connections and of kernel records, file actions by number.
LISTEN, ESTABLISHED, CLOSED = "LISTEN", "ESTABLISHED", "CLOSE"
DNS_PORT = 53
WINDOWS_ACTIONS = {1: "CREATE", 2: "DELETE", 3: "MODIFY", 4: "RENAME", 5: "RENAME"}
ES_ACTIONS = {"create": "CREATE", "write": "MODIFY", "unlink": "DELETE", "rename": "RENAME"}


def snapshot_processes(snapshots: DataFrame) -> DataFrame:
    """(snap, proc, pid, ppid, start, name, exe, cmdline, user) of PROCESS_SNAPSHOTS: proc names a process by its PID and start in
    microseconds, never by the PID alone; a start that isn't after 1970 is unknown, and missing texts are empty."""
    us = F.when(F.unix_micros(F.col("start")) > 0, F.unix_micros(F.col("start")))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "exe", "cmdline", "user")]
    proc = F.concat_ws("@", F.col("pid").cast("string"), F.coalesce(us, F.lit(0)).cast("string"))
    return snapshots.select("snap", proc.alias("proc"), "pid", "ppid", F.when(us.isNotNull(), F.col("start")).alias("start"), *text)


def process_records(records: DataFrame, host: Column | None = None) -> DataFrame:
    """PROCESS_RECORDS as the stream of kernel records that ``streaming.tracker`` takes: with host, ts and the image's name."""
    return records.select(
        (F.lit("") if host is None else host).alias("host"), "kind", F.col("pid").cast("long").alias("pid"), F.col("ppid").cast("long").alias("ppid"), "start", "at",
        F.timestamp_micros("at").alias("ts"), image_name(F.col("comm"), F.col("argv0"), F.col("exe")).alias("name"), "exe", "cmdline", "user",
    )


def resource_samples(samples: DataFrame) -> DataFrame:
    """(snap, pid, cpu_seconds, rss_bytes) of RESOURCE_SAMPLES: what could not be read is null, never 0."""
    read = lambda value, valid: F.when(F.coalesce(F.col(valid), F.lit(False)), F.col(value)).alias(value)
    return samples.select("snap", "pid", read("cpu_seconds", "cpu_valid"), read("rss_bytes", "rss_valid"))


def proc_files(files: DataFrame, hz: int = 100, boot_ms: int = 0) -> DataFrame:
    """(pid, ppid, start_ms, name, exe, cmdline, user) of the texts under /proc; the user is the real uid, as text.

    The name stands in parentheses and may hold any character, a closing parenthesis, too: fields count from the last one.
    """
    rest = F.split(F.trim(F.regexp_extract("stat", r"(?s)^.*\)(.*)$", 1)), " ")
    name = F.regexp_extract("stat", r"(?s)^[^(]*\((.*)\)", 1)
    ticks = F.get(rest, F.lit(19)).cast("long")
    return files.select(
        "pid", F.get(rest, F.lit(1)).cast("int").alias("ppid"), (F.floor(ticks * 1000 / hz) + boot_ms).alias("start_ms"), name.alias("name"),
        F.coalesce("exe", F.lit("")).alias("exe"), join_argv(F.coalesce("cmdline", F.lit(""))).alias("cmdline"), F.regexp_extract("status", r"(?m)^Uid:\s*([0-9]+)", 1).alias("user"),
    )


def snapshot_connections(sockets: DataFrame) -> DataFrame:
    """Columns direction and result of a snapshot's sockets (column state): only a listener's direction is known, and only
    of an open connection that it succeeded."""
    state = F.col("state")
    return sockets.withColumns({"direction": F.when(state == LISTEN, "inbound").otherwise(""), "result": F.when(state == ESTABLISHED, "ok").otherwise("")})


def kernel_connections(records: DataFrame) -> DataFrame:
    """Events of kernel network records (kind, direction, errno, opened_ns, at_ns, bytes_sent, bytes_received ..): type, at_ns,
    protocol, state, direction, result, duration_ms; transfer counts only on closes. Other kinds are dropped."""
    kind = F.col("kind")
    ok = F.col("errno") == 0
    closing = kind == "close"
    return records.filter(kind.isin("connect", "close", "listen", "unlisten", "udp")).select(
        *(c for c in records.columns if c not in ("direction", "errno", "opened_ns", "at_ns", "bytes_sent", "bytes_received")),
        F.when(kind.isin("close", "unlisten"), "NETWORK_CLOSE").otherwise("NETWORK_CONNECT").alias("type"),
        F.when((kind == "connect") & (F.col("opened_ns") != 0), F.col("opened_ns")).otherwise(F.col("at_ns")).alias("at_ns"),
        F.when(kind == "udp", "udp").otherwise("tcp").alias("protocol"),
        F.when(kind.isin("listen", "unlisten"), LISTEN).when(kind == "udp", "NONE").when(closing | ~ok, CLOSED).otherwise(ESTABLISHED).alias("state"),
        F.when(F.col("direction") == "in", "inbound").otherwise("outbound").alias("direction"),
        F.when(kind == "connect", connect_result(F.col("errno"))).when(closing | (kind == "udp"), "ok").otherwise("").alias("result"),
        *(F.when(closing, F.col(c)).alias(c) for c in ("bytes_sent", "bytes_received")),
        F.when(closing, connection_ms(F.col("opened_ns"), F.col("at_ns"))).alias("duration_ms"),
    )


def dns_queries(packets: DataFrame) -> DataFrame:
    """(ts, domain, query_type, resolver, src_port) of the packets on the DNS port that ask: their first question, sent to the resolver."""
    on_port = (F.col("src_port") == DNS_PORT) | (F.col("dst_port") == DNS_PORT)
    asks = packets.filter(on_port & ~F.col("response") & (F.size("questions") > 0))
    first = F.get("questions", F.lit(0))
    return asks.select("ts", first["name"].alias("domain"), dns_type(first["type"]).alias("query_type"), F.coalesce("dst_ip", F.lit("")).alias("resolver"), "src_port")


def _mapped(column: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), column)


def file_actions(records: DataFrame, action: str, table: dict) -> DataFrame:
    """Column type of file records by their action; unknown ones are dropped. Either name of a renamed file is a rename."""
    return records.withColumn("type", file_event_type(_mapped(F.col(action), table))).filter("type is not null")
