"""Telemetry views over the generic test tables, in the SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_K = {"spark": "cast(get_json_object(props, '$.k') as bigint)", "duckdb": "cast(json_extract_string(props, '$.k') as bigint)"}
_DIV = {"spark": "cast(floor(user_id / 3) as bigint)", "duckdb": "cast(floor(user_id / 3) as bigint)"}


def tele_sql(dialect: str) -> str:
    """Events as telemetry: a user is a process."""
    return f"""
    SELECT event_id, ts, user_id AS proc, k,
        CASE event_type WHEN 'purchase' THEN 'NETWORK_CONNECT' WHEN 'error' THEN 'DNS_QUERY' WHEN 'view' THEN 'FILE_CREATE' WHEN 'signup' THEN 'PROCESS_START' ELSE 'NETWORK_CLOSE' END AS type,
        CASE WHEN event_type IN ('purchase', 'click') THEN CASE event_id % 6 WHEN 0 THEN concat('10.', k, '.', event_id % 256, '.1') WHEN 1 THEN concat('203.0.113.', event_id % 256) WHEN 2 THEN concat('2001:db8::', k % 10) WHEN 3 THEN concat('::ffff:10.0.0.', k) WHEN 4 THEN '' ELSE concat('172.', 10 + k % 30, '.0.5') END END AS remote_addr,
        CASE WHEN event_type IN ('purchase', 'click') THEN k * 100 END AS remote_port,
        CASE WHEN event_type = 'error' THEN CASE WHEN k % 7 = 0 THEN '' ELSE concat('h', k, '.Example') END END AS domain,
        CASE WHEN event_type = 'view' THEN CASE WHEN k % 3 = 0 THEN concat('/tmp/', k) WHEN k % 3 = 1 THEN concat('/var/log/a/', k, '.log') ELSE concat('/tmp//x/../', k) END END AS path,
        CASE WHEN event_type = 'signup' THEN concat('/tmp/', k) END AS exe,
        CASE WHEN event_type = 'signup' THEN concat('run ', k) END AS cmdline
    FROM (SELECT event_id, ts, user_id, event_type, {_K[dialect]} AS k FROM events) AS raw"""


def proc_sql(dialect: str) -> str:
    """A process per user; PIDs are reused."""
    return f"""
    SELECT user_id AS proc, user_id % 50 AS pid, {_DIV[dialect]} % 50 AS ppid, min(ts) AS start, max(ts) AS exited_at,
        CASE user_id % 5 WHEN 0 THEN 'nginx' WHEN 1 THEN 'sh' WHEN 2 THEN 'python3.12' WHEN 3 THEN 'node' ELSE 'curl' END AS name,
        concat('/usr/bin/', CASE user_id % 5 WHEN 0 THEN 'nginx' WHEN 1 THEN 'sh' WHEN 2 THEN 'python3.12' WHEN 3 THEN 'node' ELSE 'curl' END) AS exe,
        concat('cmd --id=', user_id) AS cmdline, CASE user_id % 4 WHEN 0 THEN 'root' WHEN 1 THEN 'www' WHEN 2 THEN '' ELSE 'Admin' END AS "user"
    FROM events GROUP BY user_id""".replace('"user"', "`user`" if dialect == "spark" else '"user"')


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(tele_sql("spark").replace("FROM events", "FROM {events}"), events=raw(spark, sf_dir))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(proc_sql("spark").replace("FROM events", "FROM {events}"), events=raw(spark, sf_dir))
