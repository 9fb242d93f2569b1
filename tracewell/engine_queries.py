"""Queries of the matcher's behaviour over time: lasting matches, images that change, evidence, and windows of a whole rule."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .operators import findings, graph, lifecycle, store
from .plans import dsl, matcher, rules
from .queries import _LOG, _VIEWS, DAY, ORACLE_SQL, _log, query, shipped
from .sources import raw
from .sources.driver_tables import processes, tele

_TOP = "(SELECT max(epoch_us(ts)) FROM tele)"


def _islands(rows: str, by: str = "proc") -> str:
    """Merged intervals of (by, s, e)."""
    before = f"SELECT *, max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ({rows}) AS i0"
    return f"SELECT {by}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN s <= pe THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM ({before}) AS i1) AS i2 GROUP BY {by}, g"


def _both(a: str, b: str) -> str:
    """The time in which an interval of each of two sets holds."""
    return f"SELECT a.proc, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM ({a}) AS a JOIN ({b}) AS b ON a.proc = b.proc AND a.s < b.e AND b.s < a.e"


def _reports(held: str, window: int, ctes: str = "", top: str = _TOP) -> str:
    """Views ending in said(proc, us): a key's reports while ``held`` lasts."""
    return f"""WITH RECURSIVE {_VIEWS}, {ctes} held AS ({_islands(held)}), isl AS (SELECT proc, s, least(e, {top} + 1) AS e, row_number() OVER (PARTITION BY proc ORDER BY s) AS n FROM held WHERE s <= {top}),
    go AS (SELECT proc, n, s AS us, s AS last, e, true AS kept FROM isl WHERE n = 1
        UNION ALL SELECT g.proc, CASE WHEN g.last + {window} < g.e THEN g.n ELSE i.n END, CASE WHEN g.last + {window} < g.e THEN g.last + {window} ELSE greatest(i.s, g.last + {window}) END,
            CASE WHEN g.last + {window} < g.e THEN g.last + {window} WHEN greatest(i.s, g.last + {window}) < i.e THEN greatest(i.s, g.last + {window}) ELSE g.last END,
            CASE WHEN g.last + {window} < g.e THEN g.e ELSE i.e END, g.last + {window} < g.e OR greatest(i.s, g.last + {window}) < i.e
        FROM go g LEFT JOIN isl i ON i.proc = g.proc AND i.n = g.n + 1 WHERE g.last + {window} < g.e OR i.n IS NOT NULL),
    said AS (SELECT proc, us FROM go WHERE kept)"""


def _holds(kind: str, window: int, source: str = "tele") -> str:
    return f"SELECT proc, epoch_us(ts) AS s, epoch_us(ts) + {window} AS e FROM {source} WHERE type = '{kind}'"


def _alive(window: int) -> str:
    return f"SELECT proc, epoch_us(start) AS s, epoch_us(exited_at) + {window} AS e FROM proc"


@query()
def rearm(spark, sf_dir):
    """A match that lasts is reported again a window after its last report."""
    p = dsl.Pattern("files", roles=[dsl.Role("a", events=[dsl.Requirement("FILE_CREATE")])])
    return matcher.find(p, processes(spark, sf_dir), tele(spark, sf_dir), window_us=2 * DAY).select(F.col("r_a").alias("proc"), "us")


ORACLE_SQL["rearm"] = _reports(_both(_islands(_holds("FILE_CREATE", 2 * DAY)), _alive(2 * DAY)), 2 * DAY) + " SELECT proc, us FROM said"


@query()
def role_only_lasting(spark, sf_dir):
    """A role without requirements lasts as long as its process, and a window more."""
    p = dsl.Pattern("shells", roles=[dsl.Role("a", {"name": "sh"})])
    return matcher.find(p, processes(spark, sf_dir), tele(spark, sf_dir), window_us=4 * DAY).select(F.col("r_a").alias("proc"), "us")


ORACLE_SQL["role_only_lasting"] = _reports(f"SELECT x.* FROM ({_alive(4 * DAY)}) AS x JOIN proc USING (proc) WHERE name = 'sh'", 4 * DAY) + " SELECT proc, us FROM said"

# Some closed connections stand for program changes.
_PROGRAMS = ("sh", "node", "curl")
_EXECS = "execs AS (SELECT * REPLACE (CASE WHEN type = 'NETWORK_CLOSE' AND event_id % 3 = 0 THEN 'PROCESS_EXEC' ELSE type END AS type, CASE WHEN type = 'NETWORK_CLOSE' AND event_id % 3 = 0 THEN CASE k % 4 WHEN 0 THEN '/bin/sh' WHEN 1 THEN '/bin/node' WHEN 2 THEN '/bin/curl' ELSE '' END ELSE exe END AS exe) FROM tele), img AS (SELECT proc, exe, s, coalesce(lead(s) OVER (PARTITION BY proc ORDER BY s), 4611686018427387903) AS e FROM (SELECT *, lag(exe) OVER (PARTITION BY proc ORDER BY s) AS old FROM (SELECT proc, exe, epoch_us(ts) AS s FROM execs WHERE type = 'PROCESS_EXEC' AND exe <> '') AS x) AS y WHERE old IS NULL OR old <> exe),"


def _with_execs(spark, sf_dir):
    changed = (F.col("type") == "NETWORK_CLOSE") & (F.col("event_id") % 3 == 0)
    exe = F.coalesce(F.get(F.array(*(F.lit(f"/bin/{x}") for x in _PROGRAMS)), (F.col("k") % 4).cast("int")), F.lit(""))
    return tele(spark, sf_dir).withColumns({"exe": F.when(changed, exe).otherwise(F.col("exe")), "cmdline": F.when(changed, "").otherwise(F.col("cmdline")), "type": F.when(changed, "PROCESS_EXEC").otherwise(F.col("type"))})


@query()
def image_as_of(spark, sf_dir):
    """A role fits while its process runs the program: it changes in the middle of windows."""
    p = dsl.Pattern("shell-net", roles=[dsl.Role("a", {"exe": "/bin/sh"}, events=[dsl.Requirement("NETWORK_CONNECT")])])
    return matcher.find(p, processes(spark, sf_dir), _with_execs(spark, sf_dir), window_us=2 * DAY).select(F.col("r_a").alias("proc"), "us")


_SHELL = "SELECT proc, s, e FROM img WHERE exe = '/bin/sh'"
ORACLE_SQL["image_as_of"] = _reports(_both(_both(_islands(_holds("NETWORK_CONNECT", 2 * DAY)), _SHELL), _alive(2 * DAY)), 2 * DAY, _EXECS) + " SELECT proc, us FROM said"


@query()
def counted_by_image(spark, sf_dir):
    """A threshold counts events at whose time the process could fill the role."""
    p = dsl.Pattern("shell-files", roles=[dsl.Role("a", {"exe": "/bin/sh"}, events=[dsl.Requirement("FILE_CREATE", count=2, within_us=3 * DAY)])])
    return matcher.find(p, processes(spark, sf_dir), _with_execs(spark, sf_dir), window_us=5 * DAY).select(F.col("r_a").alias("proc"), "us")


_COUNTED = f"SELECT proc, us AS s, us + {5 * DAY} AS e FROM (SELECT t.proc, epoch_us(t.ts) AS us, count(*) OVER (PARTITION BY t.proc ORDER BY epoch_us(t.ts) RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW) AS n FROM tele t JOIN img i ON i.proc = t.proc AND i.exe = '/bin/sh' AND epoch_us(t.ts) >= i.s AND epoch_us(t.ts) < i.e WHERE t.type = 'FILE_CREATE') AS q WHERE n >= 2"
ORACLE_SQL["counted_by_image"] = _reports(_both(_both(_islands(_COUNTED), _SHELL), _alive(5 * DAY)), 5 * DAY, _EXECS) + " SELECT proc, us FROM said"


@query()
def excluded_by_image(spark, sf_dir):
    """An exclusion looks at the image at the time of the report."""
    p = dsl.Pattern("net", roles=[dsl.Role("a", events=[dsl.Requirement("NETWORK_CONNECT")])])
    found = matcher.find(p, processes(spark, sf_dir), _with_execs(spark, sf_dir), None, [dsl.Exclusion(["net"], {"exe": "/bin/sh"})], window_us=2 * DAY)
    return found.select(F.col("r_a").alias("proc"), "us", "excluded")


ORACLE_SQL["excluded_by_image"] = _reports(_both(_islands(_holds("NETWORK_CONNECT", 2 * DAY)), _alive(2 * DAY)), 2 * DAY, _EXECS) + " SELECT proc, us, EXISTS (SELECT 1 FROM img WHERE img.proc = said.proc AND exe = '/bin/sh' AND us >= img.s AND us < img.e) AS excluded FROM said"


@query()
def images_over_time(spark, sf_dir):
    held = lifecycle.images(processes(spark, sf_dir), _with_execs(spark, sf_dir))
    return held.filter("exe like '/bin/%'").select("proc", "exe", "s", "e")


ORACLE_SQL["images_over_time"] = f"WITH {_VIEWS}, {_EXECS.rstrip(',')} SELECT proc, exe, s, e FROM img"


@query()
def finding_evidence(spark, sf_dir):
    """What a finding shows: roles, the events that explain it, what its sequence captured, and replaced images."""
    steps = [dsl.Step("a", "FILE_CREATE", {}, "dropped"), dsl.Step("a", "DNS_QUERY")]
    p = dsl.Pattern("staged", roles=[dsl.Role("a", events=[dsl.Requirement("NETWORK_CONNECT")])], sequence=dsl.Sequence(steps, 2 * DAY, 0), max_findings=1_000_000_000)
    got = matcher.detect([p], processes(spark, sf_dir), _with_execs(spark, sf_dir), window_us=3 * DAY)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    images = F.array_join(F.transform(F.col("previous_images")["a"], lambda x: x["exe"]), ",")
    named = F.array_join(F.transform("captures", lambda x: F.concat(x["name"], F.lit("="), x["event_id"].cast("string"))), ",")
    return got.select(F.col("roles")["a"].cast("long").alias("proc"), "us", joined("evidence").alias("evidence"), named.alias("captures"), F.coalesce(images, F.lit("")).alias("images"))


_STAGED = f"SELECT x.proc, epoch_us(x.ts) AS t0, x.event_id AS id0, epoch_us(y.ts) AS t1, y.event_id AS id1 FROM tele x JOIN tele y ON x.proc = y.proc WHERE x.type = 'FILE_CREATE' AND y.type = 'DNS_QUERY' AND y.ts >= x.ts AND epoch_us(y.ts) - epoch_us(x.ts) <= {2 * DAY}"
_PAIR_HOLDS = _islands(f"SELECT proc, t1 AS s, t0 + {3 * DAY} AS e FROM pair WHERE t1 < t0 + {3 * DAY}")
ORACLE_SQL["finding_evidence"] = (
    _reports(_both(_both(_PAIR_HOLDS, _islands(_holds("NETWORK_CONNECT", 3 * DAY))), _alive(3 * DAY)), 3 * DAY, f"{_EXECS} pair AS ({_STAGED}),")
    + f""", step AS (SELECT s.proc, s.us, min(struct_pack(t0 := t0, id0 := id0, t1 := t1, id1 := id1)) AS x FROM said s JOIN pair p ON p.proc = s.proc AND t0 > s.us - {3 * DAY} AND t1 <= s.us GROUP BY ALL),
    example AS (SELECT s.proc, s.us, arg_min(event_id, epoch_us(ts)) AS id FROM said s JOIN tele t ON t.proc = s.proc AND t.type = 'NETWORK_CONNECT' AND epoch_us(ts) <= s.us AND epoch_us(ts) > s.us - {3 * DAY} GROUP BY ALL),
    base AS (SELECT proc, concat('/usr/bin/', name) AS exe, 0::BIGINT AS s FROM proc), every AS (SELECT * FROM base UNION ALL SELECT proc, exe, s FROM img),
    gone AS (SELECT proc, exe, lead(s) OVER (PARTITION BY proc ORDER BY s) AS e FROM every),
    was AS (SELECT s.proc, s.us, string_agg(exe, ',' ORDER BY e) AS images FROM (SELECT s.proc, s.us, exe, e, row_number() OVER (PARTITION BY s.proc, s.us ORDER BY e DESC) AS n FROM said s JOIN gone g ON g.proc = s.proc AND g.e <= s.us) AS s WHERE n <= 4 GROUP BY ALL)
    SELECT step.proc, step.us, concat(x.id0, ',', x.id1, ',', example.id) AS evidence, concat('dropped=', x.id0) AS captures, coalesce(images, '') AS images FROM step JOIN example ON example.proc = step.proc AND example.us = step.us LEFT JOIN was ON was.proc = step.proc AND was.us = step.us"""
)


@query()
def rate_limit_one_rule(spark, sf_dir):
    """All events under one rule: its windows are opened segment by segment, not by one task."""
    t = tele(spark, sf_dir).select(F.lit("all").alias("rule"), F.col("event_id").alias("key"), matcher.micros(F.col("ts")).alias("us"))
    return findings.rate_limit(t, DAY // 48, 5).filter("kept").select("key", "window")


ORACLE_SQL["rate_limit_one_rule"] = f"WITH RECURSIVE {_VIEWS}, numbered AS (SELECT event_id AS key, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS n FROM tele), go AS (SELECT key, n, us, us AS first, 1::BIGINT AS i, 1::BIGINT AS w FROM numbered WHERE n = 1 UNION ALL SELECT m.key, m.n, m.us, CASE WHEN m.us - g.first >= {DAY // 48} THEN m.us ELSE g.first END, CASE WHEN m.us - g.first >= {DAY // 48} THEN 1 ELSE g.i + 1 END, CASE WHEN m.us - g.first >= {DAY // 48} THEN g.w + 1 ELSE g.w END FROM go g JOIN numbered m ON m.n = g.n + 1) SELECT key, w AS \"window\" FROM go WHERE i <= 5"


@query("SELECT ancestor, count(*) AS n, max(depth) AS deepest FROM walk GROUP BY ancestor")
def descendant_d16(spark, sf_dir):
    """As deep as a pattern may ask: one join a generation."""
    p = processes(spark, sf_dir).withColumn("ppid", F.col("proc") % 50 - 1)
    walk = graph.descendants(graph.parent_edges(p), 16)
    return walk.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


_DEEP = _VIEWS.replace("c.ppid = p.pid", "c.proc % 50 - 1 = p.pid")
ORACLE_SQL["descendant_d16"] = f"WITH RECURSIVE {_DEEP}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges UNION ALL SELECT e.parent, w.descendant, w.depth + 1 FROM walk w JOIN edges e ON e.child = w.ancestor WHERE w.depth < 16) SELECT ancestor, count(*) AS n, max(depth) AS deepest FROM walk GROUP BY ancestor"


@query()
def derived_captures(spark, sf_dir):
    """Captures of stored findings, whose first events line up with the steps of the rule or not."""
    t = tele(spark, sf_dir)
    stored = t.groupBy((F.col("event_id") % 997).alias("finding")).agg(F.array_sort(F.collect_list(F.struct("event_id", "type"))).alias("evidence"))
    got = stored.select("finding", findings.derived_captures(F.col("evidence"), [("FILE_CREATE", "dropped"), ("NETWORK_CONNECT", ""), ("FILE_CREATE", "again")]).alias("c"))
    return got.select("finding", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["event_id"].cast("string"))), ",").alias("captures"))


ORACLE_SQL["derived_captures"] = f"WITH {_VIEWS}, l AS (SELECT event_id % 997 AS finding, list(event_id ORDER BY event_id) AS ids, list(type ORDER BY event_id) AS types FROM tele GROUP BY 1) SELECT finding, CASE WHEN len(ids) >= 3 AND types[1:3] = ['FILE_CREATE', 'NETWORK_CONNECT', 'FILE_CREATE'] THEN concat('dropped=', ids[1], ',again=', ids[3]) ELSE '' END AS captures FROM l"


@query(f"SELECT id, tab, k FROM ({_LOG}) AS l WHERE tab = 'Network' AND ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 10 DAY FROM events) AND ts <= (SELECT date_trunc('day', min(ts)) + INTERVAL 12 DAY FROM events)")
def log_table(spark, sf_dir):
    """A log that is written by tab and day, loses its expired days, and is asked for two of them: only these are read."""
    log = _log(spark, sf_dir)
    first = log.agg(F.min("ts")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/log-{uuid.uuid4().hex}"
    store.append(log, path)
    store.drop_expired(spark, path, first + dt.timedelta(days=15), 7)
    kept = store.open_log(spark, path, "id long, ts timestamp_ntz, k long, proc long")
    return store.log_query(kept, "Network", first + dt.timedelta(days=10), first + dt.timedelta(days=12), 1 << 30).select("id", "tab", "k")


@query()
def truncated_sequences(spark, sf_dir):
    """Roles are bound, the sequence is not there, and a cap of events would have dropped some of theirs."""
    seq = dsl.Sequence([dsl.Step("a", "FILE_CREATE"), dsl.Step("a", "DNS_QUERY", {"domain": {"suffix": "7.Example"}})], DAY // 4, 0)
    p = dsl.Pattern("s", roles=[dsl.Role("a", {"name": {"in": ["sh", "curl"]}})], sequence=seq)
    got = matcher.possibly_truncated(p, processes(spark, sf_dir), tele(spark, sf_dir), window_us=DAY, keep=12)
    return got.select(F.col("r_a").alias("proc"), "dropped")


ORACLE_SQL["truncated_sequences"] = f"""WITH {_VIEWS}, bound AS (SELECT proc FROM proc WHERE name IN ('sh', 'curl') AND proc IN (SELECT proc FROM tele WHERE type = 'FILE_CREATE') AND proc IN (SELECT proc FROM tele WHERE type = 'DNS_QUERY' AND domain LIKE '%7.Example')),
    found AS (SELECT x.proc FROM tele x JOIN tele y ON x.proc = y.proc WHERE x.type = 'FILE_CREATE' AND y.type = 'DNS_QUERY' AND y.domain LIKE '%7.Example' AND y.ts >= x.ts AND epoch_us(y.ts) - epoch_us(x.ts) <= {DAY // 4})
    SELECT proc, sum(n - 12)::BIGINT AS dropped FROM (SELECT proc, type, count(*) AS n FROM tele WHERE type IN ('FILE_CREATE', 'DNS_QUERY') GROUP BY ALL) AS c JOIN bound USING (proc) WHERE n > 12 AND proc NOT IN (SELECT proc FROM found) GROUP BY proc"""


@query("SELECT event_id, CASE WHEN proc = 7 THEN 'event' END AS what FROM tele WHERE proc = 7 UNION ALL SELECT CASE WHEN parent = 7 THEN child ELSE parent END, CASE WHEN parent = 7 THEN 'child' ELSE 'parent' END FROM edges WHERE 7 IN (parent, child)")
def inspect_process(spark, sf_dir):
    """Chain and relationships of one process."""
    events, edges = matcher.inspect(7, processes(spark, sf_dir), tele(spark, sf_dir))
    own = F.when(F.col("parent") == 7, F.col("child")).otherwise(F.col("parent"))
    return events.select("event_id", F.lit("event").alias("what")).unionByName(edges.select(own.alias("event_id"), F.when(F.col("parent") == 7, "child").otherwise("parent").alias("what")))


@query()
def shipped_patterns(spark, sf_dir):
    """The example patterns over all events, of ten processes and brought together in 200 seconds: one is a scheduler."""
    t = tele(spark, sf_dir)
    step = 200_000_000 // max(1, t.agg(F.max("event_id")).first()[0] or 1)
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") * step / 1_000_000).cast("decimal(18,6)"))
    key = (F.col("type") == "FILE_CREATE") & (F.col("k") % 10 == 0)
    events = t.withColumns({"ts": at, "proc": F.col("proc") % 10, "path": F.when(key, "/home/u/.ssh/keys").otherwise(F.col("path")), "type": F.when(key, "FILE_MODIFY").otherwise(F.col("type"))})
    procs = events.groupBy("proc").agg(F.min("ts").alias("start")).select("proc", F.col("proc").alias("pid"), F.lit(None).cast("long").alias("ppid"), "start", F.lit(None).cast("timestamp_ntz").alias("exited_at"), F.when(F.col("proc") == 1, "cron").otherwise("sh").alias("name"), F.lit("/bin/x").alias("exe"), F.lit("x").alias("cmdline"), F.lit("u").alias("user"))
    edges = procs.filter("proc > 0").select(F.floor(F.col("proc") / 3).cast("long").alias("parent"), F.col("proc").alias("child"))
    return matcher.detect(shipped().patterns, procs, events, edges).select("rule", "severity", "title", "us", "key")


ORACLE_SQL["shipped_patterns"] = f"""WITH {_VIEWS}, ev AS (SELECT proc % 10 AS proc, epoch_us(TIMESTAMP '2024-01-01') + event_id * (200000000 // (SELECT max(event_id) FROM tele)) AS us, CASE WHEN type = 'FILE_CREATE' AND k % 10 = 0 THEN 'FILE_MODIFY' ELSE type END AS type, remote_port FROM tele),
    born AS (SELECT proc, min(us) AS us FROM ev GROUP BY proc),
    sweep AS (SELECT proc, min(us) AS us FROM (SELECT proc, us, count(DISTINCT remote_port) OVER (PARTITION BY proc ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE type = 'NETWORK_CONNECT' AND remote_port > 0) AS q WHERE n >= 30 GROUP BY proc),
    job AS (SELECT proc, min(us) AS us FROM ev WHERE type = 'FILE_MODIFY' AND proc IN (3, 4, 5, 9) GROUP BY proc)
    SELECT 'port-sweep' AS rule, 'HIGH' AS severity, 'Many ports tried in a minute' AS title, us, concat('port-sweep|', proc) AS key FROM sweep
    UNION ALL SELECT 'scheduler-child-writes-keys', 'CRITICAL', 'A scheduled job changed login keys', greatest(us, (SELECT us FROM born WHERE proc = 1), CASE WHEN proc = 9 THEN (SELECT us FROM born WHERE proc = 3) ELSE 0 END), concat('scheduler-child-writes-keys|1,', proc) FROM job"""


_TRACKED = "tracked AS (SELECT pid, max(epoch_us(start)) AS start, max(epoch_us(start)) + 1000 AS seen, max(proc) % 7 = 0 AS pending FROM proc WHERE proc % 3 <> 0 GROUP BY pid), listed AS (SELECT proc % 60 AS pid, max(epoch_us(start)) AS start FROM proc WHERE proc % 2 = 0 GROUP BY 1), taken AS (SELECT max(epoch_us(start)) AS t FROM proc)"


@query()
def reconcile_margin(spark, sf_dir):
    """Tracked processes against a listing: what is too young to tell is left alone."""
    p = processes(spark, sf_dir).withColumn("us", matcher.micros(F.col("start")))
    tracked = p.filter("proc % 3 != 0").groupBy("pid").agg(F.max("us").alias("start"), (F.max("us") + 1000).alias("seen"), (F.max("proc") % 7 == 0).alias("pending"))
    listed = p.filter("proc % 2 = 0").groupBy((F.col("proc") % 60).alias("pid")).agg(F.max("us").alias("start"))
    taken = p.agg(F.max("us")).first()[0]
    return lifecycle.reconcile_listing(tracked, listed, taken, DAY // 8)


ORACLE_SQL["reconcile_margin"] = f"""WITH {_VIEWS}, {_TRACKED}, gone AS (SELECT k.* FROM tracked k, taken WHERE NOT pending AND seen < t - {DAY // 8} AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.pid = k.pid AND l.start = k.start))
    SELECT pid, start, t AS at, 'PROCESS_EXIT' AS event, true AS inferred, false AS reconciled FROM gone, taken
    UNION ALL SELECT pid, start, start, 'PROCESS_START', false, true FROM listed, taken WHERE start < t - {DAY // 8} AND pid NOT IN (SELECT pid FROM tracked WHERE pid NOT IN (SELECT pid FROM gone))"""


@query("SELECT 'shell-of-server' AS rule, 'HIGH' AS severity, concat('sh below ', p.name) AS title, c.proc FROM edges e JOIN proc c ON c.proc = e.child JOIN proc p ON p.proc = e.parent WHERE c.name = 'sh' AND p.name IN ('nginx', 'node') UNION ALL SELECT 'busy', 'MEDIUM', 'busy', parent FROM edges GROUP BY parent HAVING count(*) >= 3")
def process_rules(spark, sf_dir):
    """Rules that are functions of the process tree."""

    def shell(tree):
        found = tree.filter((F.col("name") == "sh") & F.col("parent.name").isin("nginx", "node"))
        return found.select("proc", F.lit("HIGH").alias("severity"), F.concat(F.lit("sh below "), F.col("parent.name")).alias("title"))

    return rules.apply_rules(processes(spark, sf_dir), {"shell-of-server": shell, "busy": lambda tree: tree.filter("n_children >= 3")})


@query("SELECT event_id AS snap, concat(k, '@', CASE WHEN k % 4 = 0 THEN 0 ELSE epoch_us(ts) END) AS proc, coalesce(exe, '') AS exe FROM tele")
def snapshot_identity(spark, sf_dir):
    """Processes of a snapshot by PID and start; some starts are unknown."""
    start = F.when(F.col("k") % 8 == 0, F.lit(0)).when(F.col("k") % 4 == 0, F.lit(None)).otherwise(matcher.micros(F.col("ts")))
    none = F.lit(None).cast("string")
    snaps = tele(spark, sf_dir).select(F.col("event_id").alias("snap"), F.col("k").cast("int").alias("pid"), F.lit(1).alias("ppid"), F.timestamp_micros(start).alias("start"), none.alias("name"), "exe", none.alias("cmdline"), none.alias("user"))
    return raw.snapshot_processes(snaps).select("snap", "proc", "exe")


@query("SELECT proc, sum(CASE WHEN k % 3 <> 0 THEN k END)::BIGINT AS cpu, max(CASE WHEN k % 5 = 1 THEN k * 1024 END) AS rss, count(*) FILTER (k % 3 = 0) AS unreadable FROM tele GROUP BY proc")
def resource_validity(spark, sf_dir):
    """Usage that could not be read is missing, not 0."""
    k = F.col("k")
    samples = tele(spark, sf_dir).select("proc", F.struct(F.col("event_id").alias("snap"), F.col("proc").cast("int").alias("pid"), F.when(k % 3 == 0, 0.0).otherwise(k.cast("double")).alias("cpu_seconds"), F.when(k % 6 == 0, None).otherwise(k % 3 != 0).alias("cpu_valid"), (k * 1024).alias("rss_bytes"), (k % 5 == 1).alias("rss_valid")).alias("s"))
    got = raw.resource_samples(samples.select("s.*"))
    return got.groupBy(F.col("pid").cast("long").alias("proc")).agg(F.sum("cpu_seconds").cast("long").alias("cpu"), F.max("rss_bytes").alias("rss"), F.count_if(F.col("cpu_seconds").isNull()).alias("unreadable"))
