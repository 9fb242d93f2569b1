"""Further queries: raw sources, sinks, findings, evidence, lifecycle and scalars, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import attribution, findings, graph, lifecycle, store, thresholds
from .plans import dsl, matcher
from .queries import _VIEWS, DAY, HOUR, ORACLE_SQL, _edges, _sequence, query
from .sources import raw
from .sources.driver_tables import processes, tele


# Sources
@query("SELECT event_id AS pid, k + 1 AS ppid, (proc * 10) + 5000 AS start_ms, concat('a) (b ', k) AS name, concat('/bin/', k) AS exe, concat('run ', k) AS cmdline, CAST(proc AS varchar) AS \"user\" FROM tele")
def proc_files(spark, sf_dir):
    t = tele(spark, sf_dir)
    stat = F.format_string("%d (a) (b %d) S %d " + "0 " * 17 + "%d 0 0", "event_id", "k", F.col("k") + 1, "proc")
    files = t.select(F.col("event_id").alias("pid"), stat.alias("stat"), F.format_string("Name:\tx\nUid:\t%d\t0\t0\t0\nGid:\t7\n", "proc").alias("status"), F.format_string("run\x00%d\x00\x00", "k").alias("cmdline"), F.format_string("/bin/%d", "k").alias("exe"))
    return raw.proc_files(files, 100, 5000)


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 'inbound' ELSE '' END AS direction, CASE WHEN k % 3 = 1 THEN 'ok' ELSE '' END AS result FROM tele")
def snapshot_connections(spark, sf_dir):
    state = F.get(F.array(F.lit("LISTEN"), F.lit("ESTABLISHED"), F.lit("TIME_WAIT")), (F.col("k") % 3).cast("int"))
    return raw.snapshot_connections(tele(spark, sf_dir).select("event_id", state.alias("state"))).select("event_id", "direction", "result")


@query("""SELECT event_id, CASE WHEN k % 6 IN (1, 3) THEN 'NETWORK_CLOSE' ELSE 'NETWORK_CONNECT' END AS type, CASE WHEN k % 6 = 0 AND proc % 4 <> 0 THEN 5000000 ELSE 9000000 END AS at_ns,
        CASE WHEN k % 6 = 4 THEN 'udp' ELSE 'tcp' END AS protocol, CASE k % 6 WHEN 0 THEN CASE WHEN proc % 2 = 0 THEN 'ESTABLISHED' ELSE 'CLOSE' END WHEN 1 THEN 'CLOSE' WHEN 4 THEN 'NONE' ELSE 'LISTEN' END AS state,
        CASE WHEN proc % 3 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, CASE k % 6 WHEN 0 THEN CASE WHEN proc % 2 = 0 THEN 'ok' ELSE 'refused' END WHEN 1 THEN 'ok' WHEN 4 THEN 'ok' ELSE '' END AS result,
        CASE WHEN k % 6 = 1 THEN k END AS bytes_sent, CASE WHEN k % 6 = 1 THEN CASE WHEN proc % 4 = 0 THEN 0 ELSE 4 END END AS duration_ms FROM tele WHERE k % 6 < 5""")  # fmt: skip
def kernel_connections(spark, sf_dir):
    kind = F.get(F.array(*(F.lit(x) for x in ("connect", "close", "listen", "unlisten", "udp", "other"))), (F.col("k") % 6).cast("int"))
    opened = F.when(F.col("proc") % 4 == 0, 0).otherwise(5_000_000).cast("long")
    records = tele(spark, sf_dir).select("event_id", kind.alias("kind"), F.when(F.col("proc") % 3 == 0, "in").otherwise("out").alias("direction"), F.when(F.col("proc") % 2 == 0, 0).otherwise(111).alias("errno"), opened.alias("opened_ns"), F.lit(9_000_000).cast("long").alias("at_ns"), F.col("k").alias("bytes_sent"), F.col("k").alias("bytes_received"))
    return raw.kernel_connections(records).drop("kind", "bytes_received")


@query("SELECT event_id, concat('q', k) AS domain, CASE WHEN k % 2 = 0 THEN 'AAAA' ELSE 'A' END AS query_type, '10.0.0.53' AS resolver FROM tele WHERE k % 3 <> 0 AND proc % 5 <> 0 AND event_id % 7 <> 0")
def dns_packets(spark, sf_dir):
    asked = F.array(F.struct(F.concat(F.lit("q"), "k").alias("name"), F.when(F.col("k") % 2 == 0, 28).otherwise(1).alias("type")), F.struct(F.lit("second").alias("name"), F.lit(1).alias("type")))
    packets = tele(spark, sf_dir).select("ts", F.lit("udp").alias("protocol"), F.col("event_id").alias("src_port"), F.when(F.col("k") % 3 == 0, 80).otherwise(53).alias("dst_port"), F.lit("10.0.0.53").alias("dst_ip"), (F.col("proc") % 5 == 0).alias("response"), F.when(F.col("event_id") % 7 == 0, F.slice(asked, F.lit(1), F.lit(0))).otherwise(asked).alias("questions"))
    return raw.dns_queries(packets.filter("src_port != 53")).select(F.col("src_port").alias("event_id"), "domain", "query_type", "resolver")


ORACLE_SQL["dns_packets"] += " AND event_id <> 53"


@query("SELECT event_id, CASE k % 7 WHEN 1 THEN 'FILE_CREATE' WHEN 2 THEN 'FILE_DELETE' WHEN 3 THEN 'FILE_MODIFY' ELSE 'FILE_RENAME' END AS type FROM tele WHERE k % 7 BETWEEN 1 AND 5")
def windows_file_events(spark, sf_dir):
    return raw.file_actions(tele(spark, sf_dir).select("event_id", (F.col("k") % 7).cast("int").alias("action")), "action", raw.WINDOWS_ACTIONS).select("event_id", "type")


@query("SELECT event_id, CASE k % 5 WHEN 0 THEN 'FILE_CREATE' WHEN 1 THEN 'FILE_MODIFY' WHEN 2 THEN 'FILE_DELETE' ELSE 'FILE_RENAME' END AS type FROM tele WHERE k % 5 < 4")
def es_file_events(spark, sf_dir):
    action = F.get(F.array(*(F.lit(x) for x in ("create", "write", "unlink", "rename", "close"))), (F.col("k") % 5).cast("int"))
    return raw.file_actions(tele(spark, sf_dir).select("event_id", action.alias("action")), "action", raw.ES_ACTIONS).select("event_id", "type")


@query("SELECT event_id, concat(k % 256, '.', proc % 256, '.0.10') AS address, k AS port FROM tele")
def hex_endpoints(spark, sf_dir):
    low = lambda c: F.lpad(F.hex((c % 256).cast("long")), 2, "0")
    text = F.concat(F.lit("0A00"), low(F.col("proc")), low(F.col("k")), F.lit(":"), F.lpad(F.hex(F.col("k").cast("long")), 4, "0"))
    address, port = attribution.hex_endpoint(F.col("raw"))
    return tele(spark, sf_dir).select("event_id", text.alias("raw")).select("event_id", address.alias("address"), port.alias("port"))


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 2 = 0 THEN 2 END AS pid FROM tele")
def endpoint_owner(spark, sf_dir):
    ports = spark.range(101).select(F.lit("10.0.0.1").alias("addr"), F.col("id").alias("port"))
    sockets = ports.filter("port % 3 = 0").select(F.lit("tcp").alias("protocol"), "addr", "port", F.lit(11).alias("inode")).unionByName(ports.filter("port % 2 = 0").select(F.lit("udp").alias("protocol"), "addr", "port", F.lit(12).alias("inode")))
    asked = tele(spark, sf_dir).select("event_id", F.lit("10.0.0.1").alias("addr"), F.col("k").alias("port"))
    return attribution.endpoint_owner(asked, sockets, spark.createDataFrame([(11, 1), (12, 2)], "inode int, pid int")).select("event_id", "pid")


# Scalars
@query("SELECT event_id, CASE WHEN k % 4 = 0 THEN 'fall' WHEN k % 4 = 1 THEN concat('abcdefghijklmno', k) WHEN k % 4 = 2 THEN 'abcdefghijklmno' ELSE 'sh' END AS image FROM tele")
def image_names(spark, sf_dir):
    comm = F.get(F.array(*(F.lit(x) for x in ("", "abcdefghijklmno", "abcdefghijklmno", "sh"))), (F.col("k") % 4).cast("int"))
    argv0 = F.when(F.col("k") % 4 == 1, F.concat(F.lit("/x/abcdefghijklmno"), "k")).when(F.col("k") % 4 == 2, "/x/other").otherwise("/x/shell")
    return tele(spark, sf_dir).select("event_id", S.image_name(comm, argv0, F.lit("/y/fall")).alias("image"))


@query("SELECT event_id, concat('a ', k, ' b') AS cmdline FROM tele")
def argv_join(spark, sf_dir):
    return tele(spark, sf_dir).select("event_id", S.join_argv(F.concat(F.lit("a\x00\x00"), F.col("k").cast("string"), F.lit("\x00b\x00"))).alias("cmdline"))


@query("SELECT event_id, CASE WHEN k = 0 THEN '+0' WHEN k < 30 THEN printf('+%d.%03ds', k * 2, (k * 7) % 1000) ELSE printf('+%dm%02ds', (k * 2) // 60, (k * 2) % 60) END AS offset_text FROM tele")
def offset_texts(spark, sf_dir):
    us = F.when(F.col("k") == 0, 0).otherwise(F.col("k") * 2_000_000 + (F.col("k") * 7) % 1000 * 1000)
    return tele(spark, sf_dir).select("event_id", S.offset_text(us).alias("offset_text"))


@query("SELECT event_id, k * 1000 // 100 + 7 AS ms FROM tele")
def start_times(spark, sf_dir):
    return tele(spark, sf_dir).select("event_id", S.start_ms(F.col("k"), F.lit(7)).alias("ms"))


@query("SELECT event_id, CASE WHEN k < 8 THEN printf('%d B', k * 128) ELSE printf('%.1f KiB', k * 128 / 1024.0) END AS size FROM tele WHERE k < 100 ")
def byte_texts(spark, sf_dir):
    return tele(spark, sf_dir).filter("k < 100").select("event_id", S.bytes_text(F.col("k") * 128).alias("size"))


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 500 WHEN k % 3 = 1 THEN 500 ELSE k END AS us FROM tele")
def time_clamp(spark, sf_dir):
    ts = F.when(F.col("k") % 3 == 0, F.lit(None).cast("long")).when(F.col("k") % 3 == 1, F.col("k") + 1000).otherwise(F.col("k"))
    return tele(spark, sf_dir).select("event_id", S.clamp_time(ts, F.lit(500).cast("long")).alias("us"))


@query("SELECT event_id, CASE WHEN k % 4 < 3 THEN TIMESTAMP '2024-03-05 06:07:00' + to_seconds(CASE WHEN k % 4 = 2 THEN 0 ELSE 8 END) END AS at FROM tele")
def parse_times(spark, sf_dir):
    text = F.get(F.array(*(F.lit(x) for x in ("2024-03-05T06:07:08Z", "2024-03-05 06:07:08", "2024-03-05T06:07", "tomorrow"))), (F.col("k") % 4).cast("int"))
    return tele(spark, sf_dir).select("event_id", store.parse_time(text).cast("timestamp_ntz").alias("at"))


# Lifecycle and identity
@query("SELECT c.proc, coalesce(p.name, c.name) AS name, coalesce(p.exe, c.exe) AS exe, CASE WHEN c.\"user\" <> '' THEN c.\"user\" ELSE p.\"user\" END AS \"user\" FROM proc c LEFT JOIN edges e ON e.child = c.proc LEFT JOIN proc p ON p.proc = e.parent AND p.proc % 2 = 0")
def fork_inherit(spark, sf_dir):
    p = processes(spark, sf_dir)
    starts = p.join(_edges(spark, sf_dir), p["proc"] == F.col("child"), "left").select("proc", "parent", F.col("start").alias("at"), "name", "exe", "cmdline", "user")
    images = p.filter("proc % 2 = 0").select("proc", F.col("start").alias("at"), "name", "exe", "cmdline", "user")
    return lifecycle.inherit(starts, images).select("proc", "name", "exe", "user")


@query("""SELECT t.event_id, coalesce(CASE WHEN t.k % 2 = 0 THEN h.proc END, -1) AS proc FROM tele t LEFT JOIN (SELECT *, coalesce(least(exited_at, lead(start) OVER (PARTITION BY pid ORDER BY start, proc)), exited_at) AS until,
        lead(start) OVER (PARTITION BY pid ORDER BY start, proc) AS next FROM proc) AS h ON h.pid = t.k % 50 AND h.start <= t.ts AND (h.next IS NULL OR h.next > t.ts) AND h.until > t.ts""")  # fmt: skip
def canonical_process(spark, sf_dir):
    events = tele(spark, sf_dir).select("event_id", "ts", (F.col("k") % 50).alias("pid"), F.lit(-1).cast("long").alias("proc"), F.when(F.col("k") % 2 == 1, F.col("ts")).alias("proc_start"))
    held = processes(spark, sf_dir).withColumn("proc", F.col("proc").cast("long"))
    return graph.canonical(events, held).select("event_id", "proc")


@query("SELECT proc, CASE WHEN proc % 3 = 0 THEN 'tracked' WHEN proc % 2 = 0 THEN 'listed' ELSE 'none' END AS via FROM proc")
def describe_process(spark, sf_dir):
    p = processes(spark, sf_dir).select(F.col("proc").alias("pid"), "start", "exe")
    tracked = p.select("pid", F.when(F.col("pid") % 3 == 1, F.col("start") + F.expr("interval 1 second")).otherwise(F.col("start")).alias("start"), F.when(F.col("pid") % 3 == 2, "").otherwise(F.col("exe")).alias("exe"))
    return graph.describe(p.select("pid", "start"), tracked, p.filter("pid % 2 = 0").select("pid", "exe")).select(F.col("pid").alias("proc"), "via")


@query("SELECT proc, 'PROCESS_EXIT' AS event FROM proc WHERE proc % 3 = 0 AND proc % 2 <> 0 UNION ALL SELECT proc, 'PROCESS_START' FROM proc WHERE proc % 2 = 0 AND proc % 3 <> 0")
def reconcile(spark, sf_dir):
    p = processes(spark, sf_dir).select("proc")
    return lifecycle.reconcile(p.filter("proc % 3 = 0"), p.filter("proc % 2 = 0"), ["proc"])


@query("SELECT snap, pid, ppid, coalesce(children, []) AS children FROM (SELECT DISTINCT 1 AS snap, proc AS pid, proc // 3 AS ppid FROM proc) AS a LEFT JOIN (SELECT proc // 3 AS of, list_sort(list(CAST(proc AS bigint))) AS children FROM proc GROUP BY 1) AS b ON b.of = a.pid")
def snapshot_tree(spark, sf_dir):
    snap = processes(spark, sf_dir).select(F.lit(1).alias("snap"), F.col("proc").cast("long").alias("pid"), F.floor(F.col("proc") / 3).alias("ppid"))
    return graph.snapshot_tree(snap)


# Thresholds
@query("SELECT proc % 10 AS g, type, count(*) - 64 AS dropped FROM tele GROUP BY 1, 2 HAVING count(*) > 64")
def cap_dropped(spark, sf_dir):
    return thresholds.truncated(tele(spark, sf_dir).withColumn("g", F.col("proc") % 10), ["g", "type"]).select("g", "type", "dropped")


@query(f"SELECT event_id, EXISTS (SELECT 1 FROM tele m WHERE m.proc = t.proc AND m.type = 'DNS_QUERY' AND m.ts <= t.ts AND epoch_us(m.ts) > epoch_us(t.ts) - {2 * DAY}) AS holds FROM tele t WHERE type = 'NETWORK_CONNECT'")
def threshold_holds(spark, sf_dir):
    t = tele(spark, sf_dir).withColumn("us", thresholds.micros(F.col("ts")))
    return thresholds.still_met(t.filter("type = 'DNS_QUERY'"), t.filter("type = 'NETWORK_CONNECT'").select("proc", "us"), ["proc"], 2 * DAY).join(t.filter("type = 'NETWORK_CONNECT'").select("event_id", "proc", "us"), ["proc", "us"]).select("event_id", "holds").distinct()


# Sequences and evidence
_PAIR = f"SELECT x.proc, x.event_id AS id0, y.event_id AS id1, row_number() OVER (PARTITION BY x.proc ORDER BY x.ts, x.event_id, y.ts, y.event_id) AS n FROM tele x JOIN tele y ON x.proc = y.proc WHERE x.type = 'FILE_CREATE' AND y.type = 'DNS_QUERY' AND epoch_us(y.ts) >= epoch_us(x.ts) - {HOUR} AND abs(epoch_us(y.ts) - epoch_us(x.ts)) <= {3 * DAY}"


def _chosen(spark, sf_dir):
    steps = [dsl.Step("a", "FILE_CREATE", {}, "dropped"), dsl.Step("a", "DNS_QUERY")]
    pattern = dsl.Pattern("s", roles=[dsl.Role("a")], sequence=dsl.Sequence(steps, 3 * DAY, HOUR))
    return matcher.earliest(pattern, _sequence(spark, sf_dir, steps, 3 * DAY, HOUR))


@query(f"SELECT proc, id0, id1 FROM ({_PAIR}) AS q WHERE n = 1")
def sequence_earliest(spark, sf_dir):
    return _chosen(spark, sf_dir).select(F.col("r_a").alias("proc"), "id0", "id1")


@query(f"SELECT proc, concat('dropped=', id0) AS captures FROM ({_PAIR}) AS q WHERE n = 1")
def sequence_captures(spark, sf_dir):
    text = F.array_join(F.transform("captures", lambda c: F.concat(c["name"], F.lit("="), c["event_id"].cast("string"))), ",")
    return _chosen(spark, sf_dir).select(F.col("r_a").alias("proc"), text.alias("captures"))


_AT = "SELECT proc, max(epoch_us(ts)) AS us FROM tele GROUP BY proc"
_WHY = "(SELECT * FROM (SELECT a.proc, {kind} AS kind, event_id, ts, row_number() OVER (PARTITION BY a.proc ORDER BY ts {way}, event_id {way}) AS n FROM last_seen a JOIN tele t ON t.proc = a.proc AND t.type = '{type}' AND epoch_us(ts) > a.us - {span}) AS q WHERE n <= {n})"


@query()
def finding_evidence(spark, sf_dir):
    """Why a role that asks for a connection and for two queries is reported, at the last event of each process."""
    needs = [dsl.Requirement("DNS_QUERY", count=2, within_us=4 * DAY), dsl.Requirement("NETWORK_CONNECT")]
    t = tele(spark, sf_dir)
    at = t.groupBy("proc").agg(F.max(thresholds.micros(F.col("ts"))).alias("us")).select(F.col("proc").alias("key"), "us", F.col("proc").alias("r_a"))
    why = matcher.requirement_evidence(dsl.Pattern("p", roles=[dsl.Role("a", events=needs)]), at, t, 10 * DAY)
    return why.select(F.col("key").alias("proc"), F.array_join("evidence", ",").alias("evidence"))


ORACLE_SQL["finding_evidence"] = (
    f"WITH {_VIEWS}, last_seen AS ({_AT}), why AS ({_WHY.format(kind=0, way='ASC', type='NETWORK_CONNECT', span=10 * DAY, n=1)} UNION ALL {_WHY.format(kind=1, way='DESC', type='DNS_QUERY', span=4 * DAY, n=10)}) "
    "SELECT a.proc, coalesce(string_agg(CAST(event_id AS varchar), ',' ORDER BY kind, ts, event_id), '') AS evidence FROM last_seen a LEFT JOIN why USING (proc) GROUP BY a.proc"
)


# Findings and lines
def _found(spark, sf_dir):
    t = tele(spark, sf_dir).filter("type = 'DNS_QUERY'")
    status = F.get(F.array(F.lit("new"), F.lit("acknowledged"), F.lit("odd")), (F.col("k") % 3).cast("int"))
    rule = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("rule"), F.col("k") % 4))
    roles = F.create_map(F.lit("b"), F.struct(F.lit("").alias("name"), F.col("proc").alias("pid")), F.lit("a"), F.struct(F.lit("sh").alias("name"), F.col("k").alias("pid")))
    return t.select(F.col("event_id").alias("id"), "ts", F.when(F.col("k") % 7 != 0, F.concat(F.lit("finding-"), "event_id")).alias("finding_id"), status.alias("status"), rule.alias("rule"), F.lit("LOW").alias("severity"), F.concat(F.lit("t"), "k").alias("title"), F.lit("d").alias("description"), F.concat(F.lit("line "), "k").alias("line"), roles.alias("roles"), "k", "proc")


_FOUND = "found AS (SELECT event_id AS id, ts, CASE WHEN k % 7 <> 0 THEN concat('finding-', event_id) END AS finding_id, CASE k % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'acknowledged' ELSE 'odd' END AS status, CASE WHEN k % 5 = 0 THEN '' ELSE concat('rule', k % 4) END AS rule, concat('t', k) AS title, concat('line ', k) AS line, k, proc FROM tele WHERE type = 'DNS_QUERY')"


def _on_found(name: str, sql: str):
    ORACLE_SQL[name] = f"WITH {_VIEWS}, {_FOUND} {sql}"


@query()
def findings_total(spark, sf_dir):
    return findings.finding_counts(_found(spark, sf_dir))


_on_found("findings_total", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'new') AS unhandled FROM found")


@query()
def finding_rules(spark, sf_dir):
    return findings.rules_with_findings(_found(spark, sf_dir))


_on_found("finding_rules", "SELECT DISTINCT rule FROM found WHERE rule <> ''")


@query()
def recent_findings(spark, sf_dir):
    return findings.recent_findings(_found(spark, sf_dir), 60).select("id", "key", "title", "status")


_on_found("recent_findings", "SELECT id, coalesce(finding_id, concat('row-', id)) AS key, CASE WHEN finding_id IS NULL THEN line ELSE title END AS title, CASE WHEN status = 'odd' THEN 'new' ELSE status END AS status FROM found ORDER BY id DESC LIMIT 60")


@query()
def console_lines(spark, sf_dir):
    c = [F.col(x) for x in ("severity", "rule", "title", "description", "roles")]
    return _found(spark, sf_dir).select("id", findings.console_line(*c, F.lit(3)).alias("console"), findings.list_line(*c[1:]).alias("listed"), findings.headless_line(*c, F.lit(3)).alias("headless"))


_on_found("console_lines", "SELECT id, concat('severity=LOW rule=', rule, ' title=', title, ' description=d roles=[a=sh(', k, ') b=?(', proc, ')] events=3') AS console, concat('[', rule, '] ', title, ' — d  (a=sh(', k, ') b=?(', proc, '))') AS listed, concat('severity=LOW rule=', rule, '  ', title, ' — d  roles=[a=sh(', k, ') b=?(', proc, ')] events=3') AS headless FROM found")


@query()
def finding_export(spark, sf_dir):
    f = _found(spark, sf_dir)
    saved = findings.save_rows(f.withColumn("finding_id", F.coalesce("finding_id", F.lit("none"))).drop("ts").withColumn("ts", F.lit("t")).withColumn("events", F.array("id")))
    return saved.select("finding_id", "status", "finding", F.get_json_object("evidence", "$.roles.a.name").alias("name"), findings.finding_json(saved, "tab", "line").alias("export"))


_on_found("finding_export", """SELECT coalesce(finding_id, 'none') AS finding_id, 'new' AS status, concat('{"finding_id":"', coalesce(finding_id, 'none'), '","ts":"t","rule":"', rule, '","severity":"LOW","title":"', title, '","description":"d"}') AS finding, 'sh' AS name, concat('{"tab":"Findings","line":"', line, '","status":"new"}') AS export FROM found""")


@query("SELECT event_id, CASE WHEN k % 3 = 0 THEN 'a' WHEN k % 3 = 1 THEN 'b' ELSE concat('pid ', k) END AS role FROM tele")
def event_roles(spark, sf_dir):
    roles = F.create_map(F.lit("b"), F.when(F.col("k") % 3 == 2, F.lit(-1)).otherwise(F.col("proc")), F.lit("a"), F.when(F.col("k") % 3 == 0, F.col("proc")).otherwise(F.lit(-2)))
    return tele(spark, sf_dir).select("event_id", findings.role_of(roles, F.col("proc"), F.col("k")).alias("role"))


@query("SELECT event_id, row_number() OVER w AS place, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY proc) AS us FROM tele WINDOW w AS (PARTITION BY proc ORDER BY ts, event_id)")
def finding_timeline(spark, sf_dir):
    t = tele(spark, sf_dir).select(F.col("proc").alias("finding_id"), thresholds.micros(F.col("ts")).alias("at"), F.col("event_id").alias("position"))
    line = findings.timeline(t, time="at")
    first = t.groupBy(F.col("finding_id").alias("_f")).agg(F.min("at").alias("first"))
    return line.join(first, F.col("finding_id") == F.col("_f")).select(F.col("position").alias("event_id"), "place", (F.col("at") - F.col("first")).alias("us"))


@query("""SELECT event_id, CASE WHEN starts_with(type, 'NETWORK') THEN 'Network' WHEN type = 'DNS_QUERY' THEN 'DNS' WHEN type = 'FILE_CREATE' THEN 'File' ELSE 'Process' END AS tab,
        CASE WHEN starts_with(type, 'NETWORK') THEN printf('%s  PID=%-6d  %-5s  %s:%d  %s', type, k, 'tcp', coalesce(remote_addr, ''), remote_port, 'NONE')
             WHEN type = 'DNS_QUERY' THEN printf('%-40s  %-6s  resolver=%-16s  %s', domain, 'A', '10.0.0.53', CASE WHEN k % 3 = 0 THEN printf('PID=%-6d sh', k) WHEN k % 3 = 1 THEN printf('PID=%-6d', k) ELSE '<unknown>' END)
             WHEN type = 'FILE_CREATE' THEN printf('%s  PID=%-6d  %s', type, k, path) ELSE printf('%s  PID=%-6d  %-20s  %s', type, k, 'sh', exe) END AS line FROM tele WHERE type <> 'DNS_QUERY' OR k > 1""")  # fmt: skip
def telemetry_lines(spark, sf_dir):
    dns = F.col("type") == "DNS_QUERY"
    t = tele(spark, sf_dir).filter("type != 'DNS_QUERY' or k > 1").withColumns({"pid": F.when(dns & (F.col("k") % 3 == 2), 0).otherwise(F.col("k")), "name": F.when(~dns | (F.col("k") % 3 == 0), "sh"), "protocol": F.lit("tcp"), "state": F.lit("NONE"), "query_type": F.lit("A"), "resolver": F.lit("10.0.0.53")})
    return findings.telemetry_lines(t)


@query("SELECT concat('events=', count(*), ' processes=', count(DISTINCT proc), ' ports=', coalesce(max(remote_port), 0)) AS line, printf('collector: %s   patterns: %d   pattern errors: %d   findings: %d new / %d', 'poll', 4, 0, count(*) FILTER (WHERE k = 1), count(*)) AS summary FROM tele")
def health(spark, sf_dir):
    n = tele(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("proc").alias("processes"), F.coalesce(F.max("remote_port"), F.lit(0)).alias("ports"), F.count_if(F.col("k") == 1).alias("new"))
    return n.select(findings.health_line({c: F.col(c) for c in ("events", "processes", "ports")}).alias("line"), findings.summary_line(F.lit("poll"), F.lit(4), F.lit(0), F.col("new"), F.col("events")).alias("summary"))


@query("SELECT proc AS pid, CASE WHEN proc % 4 = 0 THEN NULL ELSE max(k) END AS k FROM tele GROUP BY proc")
def usage_order(spark, sf_dir):
    usage = tele(spark, sf_dir).groupBy(F.col("proc").alias("pid")).agg(F.max("k").alias("k"))
    return store.order_usage(usage.withColumn("k", F.when(F.col("pid") % 4 != 0, F.col("k"))), "k")
