"""One query per operator over the generic tables, each with its DuckDB equivalent."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fields import PROCESS, fields_of
from .functions import scalars as S
from .functions.predicates import block
from .operators import attribution, findings, graph, lifecycle, store, thresholds
from .plans import dsl, matcher
from .sources.driver_tables import proc_sql, processes, tele, tele_sql

HOUR = 3_600_000_000
DAY = 24 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_VIEWS = f"tele AS ({tele_sql('duckdb')}), proc AS ({proc_sql('duckdb')}), edges AS (SELECT child, parent FROM (SELECT c.proc AS child, p.proc AS parent, row_number() OVER (PARTITION BY c.proc ORDER BY p.start DESC, p.proc DESC) AS n FROM proc c JOIN (SELECT * REPLACE (least(exited_at, coalesce(lead(start) OVER (PARTITION BY pid ORDER BY start, proc), exited_at)) AS exited_at) FROM proc) p ON c.ppid = p.pid AND c.proc <> p.proc AND p.start <= c.start AND p.exited_at >= c.start) AS q WHERE n = 1)"


def query(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name; ``sql`` may use the views tele, proc and edges."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{_VIEWS} {sql}" if any(v in sql for v in ("tele", "proc", "edges")) else sql
        return f

    return add


def shipped() -> dsl.PatternSet:
    with open(os.path.join(os.path.dirname(__file__), "plans", "shipped.yaml"), encoding="utf-8") as f:
        return dsl.load(f.read())


# Predicates: (name, event type, match block, the same in SQL).
_PREDICATES = [
    ("pred_eq", "NETWORK_CONNECT", {"remote_addr": "172.15.0.5"}, "remote_addr = '172.15.0.5'"),
    ("pred_eq_missing", "NETWORK_CONNECT", {"remote_addr": {"eq": ""}}, "coalesce(remote_addr, '') = ''"),
    ("pred_in", "DNS_QUERY", {"domain": ["h1.Example", "h2.Example", ""]}, "domain IN ('h1.Example', 'h2.Example')"),
    ("pred_contains_nocase", "DNS_QUERY", {"domain": {"contains": "1.EXAM", "nocase": True}}, "contains(lower(domain), '1.exam')"),
    ("pred_prefix", "FILE_CREATE", {"path": {"prefix": "/tmp/"}}, "starts_with(path, '/tmp/')"),
    ("pred_suffix", "FILE_CREATE", {"path": {"suffix": "7.log"}}, "suffix(path, '7.log')"),
    ("pred_suffix_nocase", "DNS_QUERY", {"domain": {"suffix": "5.eXample", "nocase": True}}, "suffix(lower(domain), '5.example')"),
    ("pred_glob", "FILE_CREATE", {"path": {"glob": "/var/**/[1-4]?.log"}}, r"regexp_matches(path, '^/var/(.*/)?[1-4][^/]\.log$')"),
    ("pred_glob_any_depth", "FILE_CREATE", {"path": {"glob": "/tmp/**"}}, "regexp_matches(path, '^/tmp/.*$')"),
    ("pred_regex", "DNS_QUERY", {"domain": {"regex": r"^h[0-9]*[13]\.Ex.*e$"}}, r"regexp_matches(domain, '^h[0-9]*[13]\.Ex.*e$')"),
    ("pred_regex_nocase", "DNS_QUERY", {"domain": {"regex": "2.EXAMPLE$", "nocase": True}}, "regexp_matches(domain, '(?i)2.EXAMPLE$')"),
    ("pred_cidr", "NETWORK_CONNECT", {"remote_addr": {"cidr": ["10.0.0.0/9", "172.16.0.0/12", "203.0.113.7"]}}, "remote_addr <> '' AND (starts_with(remote_addr, '10.') OR starts_with(remote_addr, '::ffff:10.') OR remote_addr = '203.0.113.7' OR (starts_with(remote_addr, '172.') AND CAST(split_part(remote_addr, '.', 2) AS int) BETWEEN 16 AND 31))"),
    ("pred_cidr_v6", "NETWORK_CONNECT", {"remote_addr": {"cidr": ["2001:db8::/126"]}}, "remote_addr IN ('2001:db8::0', '2001:db8::1', '2001:db8::2', '2001:db8::3')"),
    ("pred_numeric_range", "NETWORK_CLOSE", {"remote_port": {"gt": 500, "lte": 5000, "not": {"in": [800, 900]}}}, "remote_port > 500 AND remote_port <= 5000 AND remote_port NOT IN (800, 900)"),
    ("pred_numeric_in", "NETWORK_CONNECT", {"remote_port": {"in": [0, 100, "4200"], "gte": 100}}, "remote_port IN (100, 4200)"),
    ("pred_not_missing", "DNS_QUERY", {"domain": {"not": {"eq": "h8.Example"}}}, "coalesce(domain, '') <> 'h8.Example'"),
    ("pred_any_of", "NETWORK_CONNECT", {"any_of": [{"remote_port": {"lt": 300}}, {"remote_addr": {"prefix": "203."}, "remote_port": {"gte": 9000}}]}, "(remote_port < 300 OR (starts_with(remote_addr, '203.') AND remote_port >= 9000))"),
    ("pred_empty_block", "PROCESS_START", {}, "true"),
]


def _predicate_query(name: str, kind: str, where: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tele(spark, sf_dir).filter((F.col("type") == kind) & block(where, fields_of(kind))).select("event_id", "proc")

    run.__name__ = name
    query(f"SELECT event_id, proc FROM tele WHERE type = '{kind}' AND ({sql})")(run)


for _p in _PREDICATES:
    _predicate_query(*_p)


@query("SELECT proc, pid FROM proc WHERE name = 'nginx' AND \"user\" = '' OR name = 'sh' AND lower(\"user\") = 'admin'")
def role_match(spark, sf_dir):
    return processes(spark, sf_dir).filter(block({"any_of": [{"name": "nginx", "user": {"eq": ""}}, {"name": "sh", "user": {"eq": "ADMIN", "nocase": True}}]}, PROCESS)).select("proc", "pid")


@query("SELECT proc FROM proc WHERE name = 'nginx' AND \"user\" = 'root'")
def legacy_conditions(spark, sf_dir):
    role = dsl.Role("a", conditions=[("PROCESS_NAME", "nginx"), ("PROCESS_USER", "root")])
    return processes(spark, sf_dir).filter(matcher.role_filter(dsl.Pattern("p", roles=[role]), role)).select("proc")


@query("SELECT proc FROM proc WHERE proc IN (SELECT proc FROM tele WHERE type = 'NETWORK_CONNECT' AND remote_port > 8000) AND proc IN (SELECT proc FROM tele WHERE type = 'DNS_QUERY')")
def req_exists(spark, sf_dir):
    t = tele(spark, sf_dir)
    role = dsl.Role("a", events=[dsl.Requirement("NETWORK_CONNECT", {"remote_port": {"gt": 8000}}), dsl.Requirement("DNS_QUERY")])
    p = processes(spark, sf_dir)
    return matcher.bindings(dsl.Pattern("p", roles=[role]), p, t, graph.parent_edges(p), 400 * DAY).select(F.col("r_a").alias("proc"))


@query(f"SELECT event_id, proc, n FROM (SELECT *, count(*) OVER (PARTITION BY proc ORDER BY epoch_us(ts) RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW) AS n FROM tele WHERE type = 'NETWORK_CONNECT') AS q WHERE n >= 3")
def thr_count(spark, sf_dir):
    return thresholds.count_met(tele(spark, sf_dir).filter("type = 'NETWORK_CONNECT'"), ["proc"], 3, 3 * DAY).select("event_id", "proc", "n")


@query(f"SELECT event_id, proc, n FROM (SELECT *, count(DISTINCT domain) OVER (PARTITION BY proc ORDER BY epoch_us(ts) RANGE BETWEEN {6 * DAY - 1} PRECEDING AND CURRENT ROW) AS n FROM tele WHERE type = 'DNS_QUERY' AND domain <> '') AS q WHERE n >= 3")
def thr_distinct(spark, sf_dir):
    return thresholds.distinct_met(tele(spark, sf_dir).filter("type = 'DNS_QUERY'"), ["proc"], "domain", 3, 6 * DAY).select("event_id", "proc", F.col("n").cast("long").alias("n"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY proc % 10, type ORDER BY ts DESC, event_id DESC) AS n FROM tele) AS q WHERE n <= 64")
def chain_cap64(spark, sf_dir):
    return thresholds.newest(tele(spark, sf_dir).withColumn("g", F.col("proc") % 10), ["g", "type"]).select("event_id")


@query(f"SELECT proc, min(us) AS s, max(us) + {DAY} AS e FROM (SELECT proc, us, sum(CASE WHEN us - before <= {DAY} THEN 0 ELSE 1 END) OVER (PARTITION BY proc ORDER BY us) AS island FROM (SELECT proc, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY proc ORDER BY ts) AS before FROM tele WHERE type = 'DNS_QUERY') AS a) AS b GROUP BY proc, island")
def req_intervals(spark, sf_dir):
    return matcher.requirement_intervals(tele(spark, sf_dir), dsl.Requirement("DNS_QUERY"), DAY)


@query("SELECT child, parent FROM edges")
def parent_asof(spark, sf_dir):
    return graph.parent_edges(processes(spark, sf_dir))


def _edges(spark, sf_dir):
    return parent_asof(spark, sf_dir)


@query("SELECT e.parent, e.child, p.name AS parent_name, c.name AS child_name FROM edges e JOIN proc p ON p.proc = e.parent JOIN proc c ON c.proc = e.child WHERE c.name = 'sh'")
def spawned(spark, sf_dir):
    p = processes(spark, sf_dir)
    named = lambda side: p.select(F.col("proc").alias(side), F.col("name").alias(f"{side}_name"))
    return _edges(spark, sf_dir).join(named("parent"), "parent").join(named("child").filter(block({"child_name": "sh"}, {"child_name": "string"})), "child").select("parent", "child", "parent_name", "child_name")


@query("SELECT ancestor, descendant, depth FROM walk", recursive=True)
def descendant_d4(spark, sf_dir):
    return graph.descendants(_edges(spark, sf_dir), 4)


ORACLE_SQL["descendant_d4"] = f"WITH RECURSIVE {_VIEWS}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges UNION ALL SELECT e.parent, w.descendant, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.ancestor WHERE w.depth < 4) SELECT ancestor, descendant, depth FROM walk"


@query("SELECT n_regionkey AS ancestor, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def descendant_forest(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return graph.descendants(nation.unionByName(customer), 2).filter("depth = 2").groupBy(F.substr("ancestor", F.lit(2)).cast("int").alias("ancestor")).agg(F.count(F.lit(1)).alias("n"))


def _chain() -> dsl.Pattern:
    return dsl.Pattern("chain", roles=[dsl.Role("a"), dsl.Role("b", {"name": {"in": ["sh", "nginx", "node"]}}), dsl.Role("c")], edges=[dsl.Edge("SPAWNED", "a", "b"), dsl.Edge("DESCENDANT", "b", "c", 2)])


@query("SELECT x.parent AS a, x.child AS b, y.child AS c FROM edges x JOIN edges y ON y.parent = x.child JOIN proc p ON p.proc = x.child WHERE p.name IN ('sh', 'nginx', 'node') UNION SELECT x.parent, x.child, z.child FROM edges x JOIN edges y ON y.parent = x.child JOIN edges z ON z.parent = y.child JOIN proc p ON p.proc = x.child WHERE p.name IN ('sh', 'nginx', 'node')")
def chain_abc(spark, sf_dir):
    held = matcher.bindings(_chain(), processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), 60 * DAY)
    return held.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"), F.col("r_c").alias("c"))


@query("SELECT x.parent AS p, x.child AS b, y.child AS c FROM edges x JOIN edges y ON x.parent = y.parent AND x.child <> y.child")
def distinct_roles(spark, sf_dir):
    siblings = dsl.Pattern("siblings", roles=[dsl.Role("p"), dsl.Role("b"), dsl.Role("c")], edges=[dsl.Edge("SPAWNED", "p", "b"), dsl.Edge("SPAWNED", "p", "c")])
    held = matcher.bindings(siblings, processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), 60 * DAY)
    return held.select(F.col("r_p").alias("p"), F.col("r_b").alias("b"), F.col("r_c").alias("c"))


def _sequence(spark, sf_dir, steps, within, tolerance):
    p = dsl.Pattern("s", roles=[dsl.Role("a")], sequence=dsl.Sequence(steps, within, tolerance))
    return matcher.sequence_assignments(p, processes(spark, sf_dir).select(F.col("proc").alias("r_a")), tele(spark, sf_dir), 60 * DAY, 0)


_TWO = "SELECT x.proc, x.event_id AS first_id, y.event_id AS second_id FROM tele x JOIN tele y ON x.proc = y.proc AND x.event_id <> y.event_id WHERE x.type = 'DNS_QUERY' AND y.type = 'NETWORK_CONNECT' AND epoch_us(y.ts) >= epoch_us(x.ts) - {tol} AND abs(epoch_us(y.ts) - epoch_us(x.ts)) <= {within}"


def _two(spark, sf_dir, within, tolerance):
    got = _sequence(spark, sf_dir, [dsl.Step("a", "DNS_QUERY"), dsl.Step("a", "NETWORK_CONNECT")], within, tolerance)
    return got.select(F.col("r_a").alias("proc"), F.col("id0").alias("first_id"), F.col("id1").alias("second_id"))


@query(_TWO.format(tol=0, within=DAY))
def seq_order(spark, sf_dir):
    return _two(spark, sf_dir, DAY, 0)


@query(_TWO.format(tol=6 * HOUR, within=2 * DAY))
def seq_tolerance(spark, sf_dir):
    return _two(spark, sf_dir, 2 * DAY, 6 * HOUR)


@query(f"SELECT x.proc, x.event_id AS id0, y.event_id AS id1, z.event_id AS id2 FROM tele x JOIN tele y ON x.proc = y.proc JOIN tele z ON x.proc = z.proc WHERE x.type = 'FILE_CREATE' AND y.type = 'DNS_QUERY' AND z.type = 'FILE_CREATE' AND x.event_id <> z.event_id AND epoch_us(y.ts) >= epoch_us(x.ts) - {HOUR} AND epoch_us(y.ts) - epoch_us(x.ts) <= {13 * HOUR} AND epoch_us(z.ts) >= greatest(epoch_us(x.ts), epoch_us(y.ts)) - {HOUR} AND abs(epoch_us(z.ts) - epoch_us(x.ts)) <= {12 * HOUR}")
def seq_within(spark, sf_dir):
    got = _sequence(spark, sf_dir, [dsl.Step("a", "FILE_CREATE"), dsl.Step("a", "DNS_QUERY"), dsl.Step("a", "FILE_CREATE")], 12 * HOUR, HOUR)
    return got.select(F.col("r_a").alias("proc"), "id0", "id1", "id2")


@query(f"SELECT x.proc, x.event_id AS id0, y.event_id AS id1 FROM tele x JOIN tele y ON x.proc = y.proc WHERE x.type = 'NETWORK_CONNECT' AND y.type = 'NETWORK_CLOSE' AND y.remote_port = x.remote_port AND x.remote_addr <> '' AND y.ts >= x.ts AND epoch_us(y.ts) - epoch_us(x.ts) <= {20 * DAY}")
def seq_capture(spark, sf_dir):
    steps = [dsl.Step("a", "NETWORK_CONNECT", {"remote_addr": {"not": {"eq": ""}}}, "c"), dsl.Step("a", "NETWORK_CLOSE", {"remote_port": {"eq": "$c.remote_port"}})]
    return _sequence(spark, sf_dir, steps, 20 * DAY, 0).select(F.col("r_a").alias("proc"), "id0", "id1")


@query(rf"SELECT x.proc, x.event_id AS id0, y.event_id AS id1 FROM tele x JOIN tele y ON x.proc = y.proc WHERE x.type = 'FILE_CREATE' AND y.type = 'PROCESS_START' AND x.path <> '' AND starts_with(x.path, '/tmp/') AND regexp_replace(y.exe, '//+', '/', 'g') = regexp_replace(regexp_replace(x.path, '//+', '/', 'g'), '/[^/]+/\.\.', '', 'g') AND y.ts >= x.ts AND epoch_us(y.ts) - epoch_us(x.ts) <= {30 * DAY}")
def download_execute(spark, sf_dir):
    steps = [dsl.Step("a", "FILE_CREATE", {"path": {"glob": "/tmp/**"}}, "dropped"), dsl.Step("a", "PROCESS_START", {"exe": {"eq": "$dropped.path"}})]
    return _sequence(spark, sf_dir, steps, 30 * DAY, 0).select(F.col("r_a").alias("proc"), "id0", "id1")


def _both() -> dsl.Pattern:
    return dsl.Pattern("both", "HIGH", "Lookup and connection", roles=[dsl.Role("a", events=[dsl.Requirement("DNS_QUERY"), dsl.Requirement("NETWORK_CONNECT")])])


_FIRST = f"SELECT proc, min(us) AS first_us FROM (SELECT proc, epoch_us(ts) AS us, max(CASE WHEN type = 'DNS_QUERY' THEN epoch_us(ts) END) OVER w AS d, max(CASE WHEN type = 'NETWORK_CONNECT' THEN epoch_us(ts) END) OVER w AS c FROM tele WINDOW w AS (PARTITION BY proc ORDER BY ts, event_id)) AS q WHERE us - d < {DAY} AND us - c < {DAY} GROUP BY proc"


@query(_FIRST)
def match_first(spark, sf_dir):
    """The first report of a role that needs two kinds of events within a window."""
    found = matcher.find(_both(), processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), window_us=DAY)
    return found.groupBy(F.col("r_a").alias("proc")).agg(F.min("us").alias("first_us"))


@query(f"SELECT f.proc, first_us FROM ({_FIRST}) AS f JOIN proc USING (proc) WHERE name <> 'nginx'")
def role_exclude(spark, sf_dir):
    p = _both()
    p.exclude = [("a", {"name": "nginx"})]
    found = matcher.find(p, processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), window_us=DAY)
    return found.groupBy(F.col("r_a").alias("proc")).agg(F.min("us").alias("first_us"))


@query(f"SELECT f.proc, first_us, name = 'curl' OR \"user\" = 'root' AS excluded FROM ({_FIRST}) AS f JOIN proc USING (proc)")
def global_exclude(spark, sf_dir):
    skip = [dsl.Exclusion(["*"], {"name": "curl"}), dsl.Exclusion(["both"], {"user": "root"}), dsl.Exclusion(["other"], {"user": "www"})]
    found = matcher.find(_both(), processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), skip, window_us=DAY)
    return found.groupBy(F.col("r_a").alias("proc"), "excluded").agg(F.min("us").alias("first_us")).select("proc", "first_us", "excluded")


@query(f"SELECT name AS rule, count(*) AS n_excluded FROM (SELECT DISTINCT proc FROM ({_FIRST}) AS f) AS g JOIN proc USING (proc) WHERE \"user\" = 'root' GROUP BY name")
def excluded_counts(spark, sf_dir):
    found = match_first(spark, sf_dir).join(processes(spark, sf_dir), "proc").withColumns({"rule": F.col("name"), "excluded": block({"user": "root"}, PROCESS)})
    return findings.excluded_counts(found)


@query()
def suppress(spark, sf_dir):
    t = tele(spark, sf_dir).filter("type = 'DNS_QUERY'").select(F.col("proc").alias("key"), thresholds.micros(F.col("ts")).alias("us"))
    return findings.suppress(t, 2 * DAY)


_DNS = "numbered AS (SELECT proc AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY proc ORDER BY ts, event_id) AS n FROM tele WHERE type = 'DNS_QUERY')"
ORACLE_SQL["suppress"] = f"WITH RECURSIVE {_VIEWS}, {_DNS}, go AS (SELECT key, n, us, us AS last, true AS kept FROM numbered WHERE n = 1 UNION ALL SELECT g.key, m.n, m.us, CASE WHEN m.us - g.last >= {2 * DAY} THEN m.us ELSE g.last END, m.us - g.last >= {2 * DAY} FROM go g JOIN numbered m ON m.key = g.key AND m.n = g.n + 1) SELECT key, us FROM go WHERE kept"


def _limited(spark, sf_dir):
    t = tele(spark, sf_dir).filter("type = 'DNS_QUERY'").select((F.col("proc") % 3).alias("rule"), F.col("event_id").alias("key"), thresholds.micros(F.col("ts")).alias("us"))
    return findings.rate_limit(t, 5 * DAY, 20)


_RATE = f"WITH RECURSIVE {_VIEWS}, numbered AS (SELECT proc % 3 AS rule, event_id AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY proc % 3 ORDER BY ts, event_id) AS n FROM tele WHERE type = 'DNS_QUERY'), go AS (SELECT rule, key, n, us, us AS first, 1 AS i, 1 AS w FROM numbered WHERE n = 1 UNION ALL SELECT g.rule, m.key, m.n, m.us, CASE WHEN m.us - g.first >= {5 * DAY} THEN m.us ELSE g.first END, CASE WHEN m.us - g.first >= {5 * DAY} THEN 1 ELSE g.i + 1 END, CASE WHEN m.us - g.first >= {5 * DAY} THEN g.w + 1 ELSE g.w END FROM go g JOIN numbered m ON m.rule = g.rule AND m.n = g.n + 1)"


@query()
def rate_limit(spark, sf_dir):
    return _limited(spark, sf_dir).filter("kept").select("rule", "key", "us")


ORACLE_SQL["rate_limit"] = f"{_RATE} SELECT rule, key, us FROM go WHERE i <= 20"


@query()
def rate_summary(spark, sf_dir):
    return findings.rate_summaries(_limited(spark, sf_dir), 5 * DAY).select("rule", "us", "severity", "title")


ORACLE_SQL["rate_summary"] = f"{_RATE} SELECT rule, min(us) + {5 * DAY} AS us, 'INFO' AS severity, concat('rule ', rule, ': ', count(*) - 20, ' additional findings suppressed') AS title FROM go GROUP BY rule, w HAVING count(*) > 20"


def _snap(spark, sf_dir):
    return tele(spark, sf_dir).select(F.dayofyear("ts").alias("snap"), "proc")


_SNAP = "snap AS (SELECT DISTINCT dayofyear(ts) AS snap, {key} FROM tele {where}), ends AS (SELECT min(snap) AS lo, max(snap) AS hi FROM snap)"
_DIFF = "SELECT s.snap, {key}, '{up}' AS event FROM snap s, ends WHERE s.snap > lo AND NOT EXISTS (SELECT 1 FROM snap b WHERE {on} AND b.snap = s.snap - 1) UNION ALL SELECT s.snap + 1, {key}, '{down}' FROM snap s, ends WHERE s.snap < hi AND NOT EXISTS (SELECT 1 FROM snap b WHERE {on} AND b.snap = s.snap + 1)"


@query()
def snap_diff_process(spark, sf_dir):
    return lifecycle.snapshot_diff(_snap(spark, sf_dir), ["proc"], started="PROCESS_START", ended="PROCESS_EXIT")


ORACLE_SQL["snap_diff_process"] = f"WITH {_VIEWS}, {_SNAP.format(key='proc', where='')} {_DIFF.format(key='s.proc', up='PROCESS_START', down='PROCESS_EXIT', on='b.proc = s.proc')}"


@query()
def snap_diff_network(spark, sf_dir):
    t = tele(spark, sf_dir).filter("type = 'NETWORK_CONNECT'").select(F.dayofyear("ts").alias("snap"), (F.col("proc") % 20).alias("pid"), (F.col("remote_port") % 700).alias("port"))
    return lifecycle.snapshot_diff(t, ["pid", "port"], started="NETWORK_CONNECT", ended="NETWORK_CLOSE")


_NET = _SNAP.format(key="proc % 20 AS pid, remote_port % 700 AS port", where="WHERE type = 'NETWORK_CONNECT'")
ORACLE_SQL["snap_diff_network"] = f"WITH {_VIEWS}, {_NET} {_DIFF.format(key='s.pid, s.port', up='NETWORK_CONNECT', down='NETWORK_CLOSE', on='b.pid = s.pid AND b.port = s.port')}"


@query("SELECT snap, proc, CASE WHEN before_snap = snap - 1 AND used >= before_used THEN round((used - before_used) / 864.0, 6) END AS percent FROM (SELECT *, lag(snap) OVER w AS before_snap, lag(used) OVER w AS before_used FROM (SELECT dayofyear(ts) AS snap, proc, sum(k) - CASE WHEN proc % 3 = 0 THEN dayofyear(ts) * 20 ELSE 0 END AS used FROM tele GROUP BY 1, 2, proc % 3) AS u WINDOW w AS (PARTITION BY proc ORDER BY snap)) AS q")
def resource_delta(spark, sf_dir):
    used = tele(spark, sf_dir).groupBy(F.dayofyear("ts").alias("snap"), "proc").agg(F.sum("k").alias("cpu_seconds")).withColumn("cpu_seconds", F.col("cpu_seconds") - F.when(F.col("proc") % 3 == 0, F.col("snap") * 20).otherwise(0)).withColumn("seconds", F.col("snap") * 86400)
    return lifecycle.usage_rates(used, ["proc"]).select("snap", "proc", F.round("cpu_percent", 6).alias("percent"))


@query("SELECT proc, image, us AS valid_from, lead(us) OVER (PARTITION BY proc ORDER BY us) AS valid_to FROM (SELECT *, lag(image) OVER (PARTITION BY proc ORDER BY us) AS old FROM (SELECT proc, epoch_us(ts) AS us, CASE WHEN k % 4 = 0 THEN '' ELSE concat('img', k % 4) END AS image FROM tele) AS a WHERE image <> '') AS b WHERE old IS NULL OR old <> image")
def image_history(spark, sf_dir):
    execs = tele(spark, sf_dir).select("proc", thresholds.micros(F.col("ts")).alias("at"), F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("img"), F.col("k") % 4)).alias("image"))
    return lifecycle.image_history(execs).select("proc", "image", "valid_from", "valid_to")


@query()
def fork_exec_fold(spark, sf_dir):
    t = tele(spark, sf_dir).select("event_id", (F.col("event_id") % 40).alias("pid"), thresholds.micros(F.col("ts")).alias("start"), "k")
    kinds = {"fork": F.lit(0), "exec": F.col("k") * 1000 + 1, "exit": F.lit(200_000)}
    parts = [t.filter("k % 2 = 0") if kind == "exit" else t for kind in kinds]
    records = None
    for part, (kind, after) in zip(parts, kinds.items(), strict=True):
        one = part.select("pid", "start", (F.col("start") + after).alias("at"), F.lit(kind).alias("kind"), F.lit(kind).alias("exe"))
        records = one if records is None else records.unionByName(one)
    return lifecycle.fold_fork_exec(records).select("pid", "start", F.col("at").alias("at_us"), "event", "inferred")


_RECORDS = "rec AS (SELECT event_id % 40 AS pid, epoch_us(ts) AS start, epoch_us(ts) AS at_us, 'fork' AS kind FROM tele UNION ALL SELECT event_id % 40, epoch_us(ts), epoch_us(ts) + k * 1000 + 1, 'exec' FROM tele UNION ALL SELECT event_id % 40, epoch_us(ts), epoch_us(ts) + 200000, 'exit' FROM tele WHERE k % 2 = 0)"
ORACLE_SQL["fork_exec_fold"] = f"WITH {_VIEWS}, {_RECORDS} SELECT pid, start, at_us, event, inferred FROM (SELECT pid, start, CASE WHEN kind = 'fork' AND next_kind = 'exec' AND next_at - at_us <= 50000 THEN next_at ELSE at_us END AS at_us, CASE kind WHEN 'fork' THEN 'PROCESS_START' WHEN 'exec' THEN 'PROCESS_EXEC' ELSE 'PROCESS_EXIT' END AS event, false AS inferred, kind = 'exec' AND at_us - before_at <= 50000 AS follower FROM (SELECT *, lead(kind) OVER w AS next_kind, lead(at_us) OVER w AS next_at, lag(at_us) OVER w AS before_at FROM rec WINDOW w AS (PARTITION BY pid, start ORDER BY at_us)) AS a) AS b WHERE NOT coalesce(follower, false) UNION ALL SELECT pid, start, at_us, 'PROCESS_EXIT', true FROM (SELECT pid, start, ended, lead(start) OVER (PARTITION BY pid ORDER BY start) AS at_us FROM (SELECT pid, start, bool_or(kind = 'exit') AS ended FROM rec GROUP BY pid, start) AS l) AS m WHERE NOT ended AND at_us IS NOT NULL"


def _log(spark, sf_dir):
    tab = F.when(F.startswith("type", F.lit("NETWORK")), "Network").when(F.col("type") == "DNS_QUERY", "DNS").when(F.col("type") == "FILE_CREATE", "File").otherwise("Process")
    return tele(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", tab.alias("tab"), "k", "proc")


_LOG = "SELECT event_id AS id, ts, CASE WHEN starts_with(type, 'NETWORK') THEN 'Network' WHEN type = 'DNS_QUERY' THEN 'DNS' WHEN type = 'FILE_CREATE' THEN 'File' ELSE 'Process' END AS tab, k, proc FROM tele"


@query(f"SELECT id, tab FROM (SELECT * FROM ({_LOG}) AS l WHERE tab = 'DNS' AND ts >= (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 9 DAY FROM events) ORDER BY id LIMIT 200) AS q")
def log_query(spark, sf_dir):
    log = _log(spark, sf_dir)
    first = log.agg(F.min("ts")).first()[0]
    return store.log_query(log, "DNS", first + dt.timedelta(days=3), first + dt.timedelta(days=9)).select("id", "tab")


@query(f"SELECT id, tab FROM (SELECT id, tab, row_number() OVER (PARTITION BY tab ORDER BY id DESC) AS n FROM ({_LOG}) AS l) AS q WHERE n <= 500")
def recent_per_tab(spark, sf_dir):
    return store.recent_per_tab(_log(spark, sf_dir)).select("id", "tab")


@query(f"SELECT id FROM (SELECT id FROM ({_LOG}) AS l ORDER BY id DESC LIMIT 50) AS q")
def recent_n(spark, sf_dir):
    return store.recent(_log(spark, sf_dir), 50).select("id")


@query(f"SELECT tab, count(*) AS n FROM ({_LOG}) AS l GROUP BY tab")
def tab_counts(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id FROM ({_LOG}) AS l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    log = _log(spark, sf_dir)
    return store.retention(log.join(F.broadcast(log.agg(F.max("ts").alias("now")))), F.col("now")).select("id")


@query("SELECT finding_id, coalesce(last, 'new') AS status FROM (SELECT event_id AS finding_id FROM tele WHERE type = 'DNS_QUERY') AS f LEFT JOIN (SELECT k AS id, arg_max(CASE WHEN proc % 2 = 0 THEN 'acknowledged' ELSE 'dismissed' END, event_id) AS last FROM tele GROUP BY k) AS c ON c.id = f.finding_id")
def status_latest(spark, sf_dir):
    t = tele(spark, sf_dir)
    changes = t.select(F.col("k").alias("finding_id"), F.when(F.col("proc") % 2 == 0, "acknowledged").otherwise("dismissed").alias("status"), F.col("event_id").alias("seq"))
    return findings.with_latest_status(t.filter("type = 'DNS_QUERY'").select(F.col("event_id").alias("finding_id"), F.lit(None).cast("string").alias("status")), changes).select("finding_id", "status")


@query("SELECT event_id, severity FROM (SELECT event_id, CASE k % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM tele) AS q WHERE severity = 'HIGH'")
def findings_view(spark, sf_dir):
    names = F.array(*(F.lit(s) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")))
    rows = tele(spark, sf_dir).select("event_id", "ts", F.col("event_id").alias("arrival"), F.get(names, (F.col("k") % 5).cast("int")).alias("severity"))
    return findings.findings_view(rows, severity="HIGH").select("event_id", "severity")


@query("SELECT type, round(least(pow(2.0, b / 4.0), top), 6) AS latency FROM (SELECT *, sum(n) OVER (PARTITION BY type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY type) AS total, max(mx) OVER (PARTITION BY type) AS top FROM (SELECT type, greatest(ceil(log2(k + 1.0) * 4), 0) AS b, count(*) AS n, max(k + 1.0) AS mx FROM tele GROUP BY 1, 2) AS c) AS q WHERE upto >= floor((total - 1) * 0.95) + 1 AND upto - n < floor((total - 1) * 0.95) + 1")
def latency_hist(spark, sf_dir):
    got = store.latency_quantile(tele(spark, sf_dir).withColumn("v", F.col("k") + 1.0), "v", 0.95, ["type"])
    return got.select("type", F.round("latency", 6).alias("latency"))


@query("SELECT event_id, CASE k % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'refused' WHEN 2 THEN 'timeout' WHEN 3 THEN 'unreachable' WHEN 4 THEN 'unreachable' ELSE 'other' END AS result FROM tele")
def errno_result(spark, sf_dir):
    errno = F.get(F.array(*(F.lit(x) for x in (0, 111, 110, 101, 92, 5))), (F.col("k") % 6).cast("int"))
    return tele(spark, sf_dir).select("event_id", S.connect_result(errno).alias("result"))


@query("SELECT event_id, CASE k WHEN 1 THEN 'A' WHEN 2 THEN 'NS' WHEN 5 THEN 'CNAME' WHEN 15 THEN 'MX' WHEN 16 THEN 'TXT' WHEN 28 THEN 'AAAA' ELSE concat('TYPE', k) END AS query_type FROM tele")
def dns_type(spark, sf_dir):
    return tele(spark, sf_dir).select("event_id", S.dns_type(F.col("k")).alias("query_type"))


@query("SELECT event_id, CASE WHEN k % 10 = 0 OR k < 20 THEN 0 ELSE (k - 20) * 3 END AS ms FROM tele")
def connection_duration(spark, sf_dir):
    return tele(spark, sf_dir).select("event_id", S.connection_ms(F.when(F.col("k") % 10 == 0, 0).otherwise(F.lit(60_000_000)), F.col("k") * 3_000_000 + 999).alias("ms"))


@query("SELECT event_id, CASE WHEN k & 8 <> 0 THEN 'FILE_MODIFY' WHEN k & 1 <> 0 THEN 'FILE_CREATE' WHEN k & 2 <> 0 THEN 'FILE_DELETE' WHEN k & 4 <> 0 THEN 'FILE_RENAME' END AS type FROM tele WHERE k % 16 <> 0")
def file_events(spark, sf_dir):
    bits = F.col("k").bitwiseAND(8) + F.col("k").bitwiseAND(1) * 256 + F.col("k").bitwiseAND(2) * 256 + F.col("k").bitwiseAND(4) * 16
    return tele(spark, sf_dir).select("event_id", S.file_event_type(S.file_operation(bits)).alias("type")).filter("type is not null")


@query("SELECT event_id, CASE WHEN starts_with(path, '/tmp//x/../') THEN concat('/tmp/', k) ELSE path END AS clean FROM tele WHERE type = 'FILE_CREATE'")
def path_clean(spark, sf_dir):
    return tele(spark, sf_dir).filter("type = 'FILE_CREATE'").select("event_id", S.clean_path(F.col("path")).alias("clean"))


@query("SELECT event_id, CASE WHEN type = 'DNS_QUERY' THEN concat(domain, ' (A)') WHEN type = 'FILE_CREATE' THEN path WHEN starts_with(type, 'NETWORK') THEN concat('tcp ', remote_addr, ':', remote_port) ELSE cmdline END AS summary FROM tele")
def event_summary(spark, sf_dir):
    t = tele(spark, sf_dir)
    return t.select("event_id", findings.event_summary(t).alias("summary"))


@query("SELECT proc % 30 AS inode, coalesce(min(p.pid), 0) AS pid, count(DISTINCT t.event_id) AS n FROM tele t LEFT JOIN (SELECT proc AS inode, min(pid) AS pid FROM proc WHERE proc < 20 GROUP BY proc) AS p ON p.inode = t.proc % 30 GROUP BY proc % 30")
def socket_owner(spark, sf_dir):
    sockets = tele(spark, sf_dir).select("event_id", (F.col("proc") % 30).alias("inode"))
    owners = processes(spark, sf_dir).filter("proc < 20").select(F.col("proc").alias("inode"), "pid")
    return attribution.socket_owner(sockets, owners).groupBy("inode").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("n"))


@query("SELECT via, count(*) AS n FROM (SELECT CASE WHEN k % 5 = 0 THEN 'udp' WHEN k % 3 = 0 THEN 'tcp' ELSE 'none' END AS via FROM tele WHERE type = 'DNS_QUERY') AS q GROUP BY via")
def port_owner(spark, sf_dir):
    ports = spark.range(100).withColumnRenamed("id", "port")
    bound = ports.filter("port % 5 = 0").select(F.lit("udp").alias("protocol"), "port", F.col("port").alias("pid")).unionByName(ports.filter("port % 3 = 0").select(F.lit("tcp").alias("protocol"), "port", (F.col("port") + 1).alias("pid")))
    packets = tele(spark, sf_dir).filter("type = 'DNS_QUERY'").select("event_id", F.col("k").alias("port"))
    return attribution.attribute_ports(packets, bound).groupBy("via").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT severity, count(*) AS n FROM (SELECT CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity FROM tele) AS q GROUP BY severity")
def finding_counts(spark, sf_dir):
    names = F.array(F.lit("HIGH"), F.lit("LOW"), F.lit("INFO"))
    return tele(spark, sf_dir).groupBy(F.get(names, (F.col("k") % 3).cast("int")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def flagship(spark, sf_dir) -> DataFrame:
    """Network-active interpreters, as findings."""
    text = "patterns: [{name: network-active, severity: LOW, title: Active, processes: [{id: a, match: {name: {regex: '^(python|node|curl).*'}}, events: [{type: NETWORK_CONNECT}]}]}]"
    found = dsl.load(text).patterns[0]
    rows = matcher.find(found, processes(spark, sf_dir), tele(spark, sf_dir), _edges(spark, sf_dir), window_us=DAY)
    return findings.rate_limit(rows, DAY, 20).filter("kept").select("rule", "severity", "title", "us", "key")


from . import engine_queries, more_queries  # noqa: E402, F401  register further queries
