"""The pattern language, predicates, and the matcher against a naive replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell import queries as Q
from tracewell.functions import scalars as S
from tracewell.functions.predicates import PatternError, block, check
from tracewell.operators import findings, graph, lifecycle
from tracewell.plans import dsl, matcher

T0 = dt.datetime(2026, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, proc string, type string, remote_port long, path string, exe string"
PROCS = "proc string, pid long, ppid long, start timestamp_ntz, exited_at timestamp_ntz, name string, exe string, cmdline string, user string"


def one(spark, value, kind, spec):
    return spark.createDataFrame([(value,)], "f " + ("long" if kind == "number" else "string")).select(block({"f": spec}, {"f": kind})).first()[0]


@pytest.mark.parametrize(("value", "kind", "spec", "want"), [
    ("root", "string", "root", True), ("", "string", "", True), (None, "string", {"not": "root"}, True), (None, "string", {"not": ""}, False),
    ("", "string", {"in": ["", "a"]}, False), ("Sh", "string", {"eq": "sH", "nocase": True}, True), ("sh\n", "string", {"regex": "sh$"}, False),
    ("É", "string", {"regex": "é", "nocase": True}, True), ("/tmp/a/b", "path", {"glob": "/tmp/*"}, False), ("/tmp/a/b", "path", {"glob": "/tmp/**"}, True),
    ("/a.log", "path", {"glob": "/[!b].lo?"}, True), ("10.1.2.3", "address", {"cidr": ["10.0.0.0/8"]}, True), ("::ffff:10.1.2.3", "address", {"cidr": ["10.1.2.3"]}, True),
    ("2001:db8::1", "address", {"cidr": ["2001:db8::/33"]}, True), ("2001:db8:8000::1", "address", {"cidr": ["2001:db8::/33"]}, False), ("10.1.2.3.4", "address", {"cidr": ["0.0.0.0/0"]}, False),
    ("256.1.1.1", "address", {"cidr": ["0.0.0.0/0"]}, False), ("::", "address", {"cidr": ["::/0"]}, True), (0, "number", {"gte": 0, "lt": 1}, True), (None, "number", {"not": {"gt": 5}}, True), (None, "number", {"lt": 5}, False),
])
def test_truth_table(spark, value, kind, spec, want):
    assert one(spark, value, kind, spec) is want


@pytest.mark.parametrize(("kind", "spec"), [("number", {"prefix": "1"}), ("string", {"gt": 1}), ("string", {"cidr": ["10.0.0.0/8"]}), ("number", ""), ("string", {"regex": "("}), ("string", {"regex": r"(a)\1"}), ("path", {"glob": "[a"}), ("path", {"glob": "a\\"}), ("address", {"cidr": ["10.0.0.0/99"]}), ("string", {"nocase": True})])
def test_illegal_operators(kind, spec):
    with pytest.raises(PatternError):
        check("f", kind, spec)


def test_paths_and_texts(spark):
    cases = {"/a/./b/../c": "/a/c", "//a//": "/a", "/..": "/", "a/../..": "..", "": ".", "../a/..": "..", "/": "/"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", S.clean_path(F.col("p")).alias("c"), S.offset_text(F.lit(63_000_000)).alias("o"), S.bytes_text(F.lit(1536)).alias("b")).collect()
    assert {r["p"]: r["c"] for r in got} == cases and (got[0]["o"], got[0]["b"]) == ("+1m03s", "1.5 KiB")
    line = spark.range(1).select(findings.console_line(F.lit("LOW"), F.lit("r"), F.lit("t"), F.lit("d"), F.create_map(F.lit("b"), F.struct(F.lit("").alias("name"), F.lit(2).alias("pid")), F.lit("a"), F.struct(F.lit("sh").alias("name"), F.lit(1).alias("pid"))), F.lit(3))).first()[0]
    assert line == "severity=LOW rule=r title=t description=d roles=[a=sh(1) b=?(2)] events=3"


def test_language_loads_isolates_and_round_trips(tmp_path):
    found = Q.shipped()
    assert len(found.patterns) == 4 and not found.problems
    dsl.save(found, str(tmp_path / "p.yaml"))
    reader = dsl.Reloader(str(tmp_path / "p.yaml"))
    assert reader.poll() and not reader.poll() and reader.current.patterns == found.patterns
    bad = dsl.load("patterns: [{name: a, processes: [{id: x}]}, {name: b, oops: 1}, {name: c, processes: [{id: x, events: [{type: NOPE}]}]}]\nextra: 1\nexclusions: [{rules: [a], match: {name: sh}}, {rules: [a]}]")
    assert [p.name for p in bad.patterns] == ["a"] and [n for n, _ in bad.problems] == ["b", "c", "exclusions[1]"] and bad.warnings and len(bad.exclusions) == 1
    assert dsl.duration_text(dsl.duration_us("1m30s")) == "1m30s"
    with pytest.raises(PatternError):
        dsl.duration_us("5 min")
    assert dsl.draft_exclusion("r", {"exe": "/bin/sh", "user": "root", "cmdline": "sh -c x"}).match == {"exe": {"eq": "/bin/sh"}, "user": {"eq": "root"}, "cmdline": {"prefix": "sh"}}


def world(seed, n=160):
    rng = random.Random(seed)
    procs = [(f"p{i}", i, rng.randrange(4), T0, None, rng.choice(["sh", "node"]), f"/bin/{i}", "", "") for i in range(8)]
    events = [(i, T0 + dt.timedelta(seconds=3 * i), f"p{rng.randrange(8)}", rng.choice(["NETWORK_CONNECT", "FILE_CREATE"]), rng.randrange(5), f"/tmp/{rng.randrange(3)}", None) for i in range(n)]
    return procs, events


def naive(procs, events, w):
    """First instants at which a role's process has both kinds of events in the window, with suppression, event by event."""
    out, last = [], {}
    for _, ts, p, *_ in events:
        have = {k: [e[1] for e in events if e[2] == p and e[3] == k and ts - w < e[1] <= ts] for k in ("NETWORK_CONNECT", "FILE_CREATE")}
        if all(have.values()) and (p not in last or ts - last[p] >= w):
            if p not in last:
                out.append((p, int((ts - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))))
            last[p] = ts
    return sorted(out)


def test_matcher_against_replay(spark):
    procs, events = world(3)
    p, e = spark.createDataFrame(procs, PROCS), spark.createDataFrame(events, EVENTS)
    pattern = dsl.Pattern("both", roles=[dsl.Role("a", events=[dsl.Requirement("NETWORK_CONNECT"), dsl.Requirement("FILE_CREATE")])], max_findings=1000)
    w = dt.timedelta(seconds=30)
    found = matcher.find(pattern, p, e, window_us=30_000_000)
    assert sorted(tuple(r) for r in found.groupBy("r_a").agg(F.min("us")).collect()) == naive(procs, events, w)


def test_graph_pattern_needs_distinct_related_processes(spark):
    procs, events = world(5)
    p, e = spark.createDataFrame(procs, PROCS), spark.createDataFrame(events, EVENTS)
    edges = spark.createDataFrame([(f"p{x[2]}", x[0]) for x in procs if f"p{x[2]}" != x[0]], "parent string, child string")
    pattern = dsl.Pattern("pair", roles=[dsl.Role("a"), dsl.Role("b", {"name": "sh"})], edges=[dsl.Edge("SPAWNED", "a", "b")])
    got = {(r["r_a"], r["r_b"]) for r in matcher.match_intervals(pattern, p, e, edges, 30_000_000).collect()}
    assert got == {(f"p{x[2]}", x[0]) for x in procs if x[5] == "sh" and f"p{x[2]}" != x[0]}


def test_wide_predicates_stay_small_plans(spark):
    col = F.col("v")
    e = S.in_cidr(col, ["10.0.0.0/8", "192.168.0.0/16", "2001:db8::/32", "fe80::/10", "172.16.0.0/12"])
    plan = spark.createDataFrame([("10.1.1.1",)], "v string").filter(e)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 30_000


def test_parent_as_of_the_start_under_reused_pids(spark):
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    rng = random.Random(4)
    rows = []
    for i in range(90):
        start = rng.choice([None, *range(40)])
        rows.append((f"p{i}", rng.randrange(6), rng.randrange(7), at(start), at(rng.choice([None, None, (start or 0) + rng.randrange(20)])), "n", "/x", "", ""))
    p = spark.createDataFrame(rows, PROCS)
    derived = {}
    for pid in range(6):
        held = sorted((r for r in rows if r[1] == pid), key=lambda r: (r[3] is not None, r[3] or T0, r[0]))
        for r, after in zip(held, [*held[1:], None], strict=True):
            derived[r[0]] = min((x for x in (r[4], after and after[3]) if x is not None), default=None)
    want = {}
    for c in rows:
        held = [h for h in rows if h[1] == c[2] and h[0] != c[0] and (h[3] is None or c[3] is None or h[3] <= c[3])]
        held = [h for h in held if derived[h[0]] is None or c[3] is not None and derived[h[0]] >= c[3]]
        if held:
            want[c[0]] = max(held, key=lambda h: (h[3] is not None, h[3] or T0, h[0]))[0]
    got = {r["child"]: r["parent"] for r in graph.parent_edges(p).collect()}
    assert {c: x for c, x in got.items() if dict((r[0], r[3]) for r in rows)[c] is not None} == {c: x for c, x in want.items() if dict((r[0], r[3]) for r in rows)[c] is not None}


def test_roles_must_be_connected_and_saving_keeps_rejected_entries(tmp_path):
    two = "{id: %s}"
    text = f"patterns: [{{name: split, processes: [{', '.join(two % x for x in 'abcd')}], relationships: [{{type: SPAWNED, parent: a, child: b}}, {{type: SPAWNED, parent: c, child: d}}]}}, {{name: fine, processes: [{{id: a}}]}}]"
    found = dsl.load(text)
    assert [n for n, why in found.problems if "connected" in why] == ["split"] and [p.name for p in found.patterns] == ["fine"]
    dsl.save(found, str(tmp_path / "p.yaml"))
    again = dsl.load((tmp_path / "p.yaml").read_text())
    assert [p.name for p in again.patterns] == ["fine"] and [n for n, _ in again.problems] == ["split"]


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_rate_windows_of_a_long_rule(spark, monkeypatch, segment):
    monkeypatch.setattr(findings, "SEGMENT_WINDOWS", segment)
    rng, w = random.Random(2), 50
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3000)) for _ in range(2500)]
    got = {(r["rule"], r["us"]): r["window"] for r in findings.rate_limit(spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(rows)], "rule string, us long, key int"), w).collect()}
    for rule in ("a", "b", None):
        first, number = None, 0
        for t in sorted({t for r, t in rows if r == rule}):
            if first is None or t - first >= w:
                first, number = t, number + 1
            assert got[(rule, t)] == number


def test_windows_of_one_rule_are_opened_by_many_tasks(spark):
    """Gaps longer than segments, and every row under one rule: the segments, not the rule, are the tasks' share."""
    rng = random.Random(8)
    times = sorted({at * 10_000 + rng.randrange(4000) for at in (-3, 0, 1, 2, 40, 41) for _ in range(300)})
    df = spark.createDataFrame([("r", t) for t in times], "rule string, us long")
    got = {r["us"]: r["opens"] for r in findings._windows(df, "rule", "us", 50).collect()}
    first, want = None, {}
    for t in times:
        want[t] = first is None or t - first >= 50
        first = t if want[t] else first
    assert got == want
    plan = findings._windows(df, "rule", "us", 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_segment") > 4 and "hashpartitioning(rule#" in plan
    segments = df.select((F.col("us") / (50 * findings.SEGMENT_WINDOWS)).cast("long")).distinct().count()
    assert segments > 5


@pytest.mark.parametrize("seed", range(3))
def test_lasting_matches_are_reported_at_each_lapse(spark, seed):
    rng, w = random.Random(seed), 20
    rows = [(f"k{rng.randrange(6)}", (s := rng.randrange(400)), s + rng.randint(1, 60), (rng.randrange(3),)) for _ in range(60)]
    before = {f"k{k}": rng.choice([None, rng.randrange(30)]) for k in range(6)}
    got = findings.lasting(spark.createDataFrame([(*r, before[r[0]]) for r in rows], "key string, s long, e long, bound struct<r_a:int>, last long"), w)
    want = []
    for key, last in before.items():
        for t in range(500):  # every instant
            bound = [b for k, s, e, b in rows if k == key and s <= t < e]
            if bound and (last is None or t - last >= w):
                want.append((key, t, min(bound)))
                last = t
    assert sorted((r["key"], r["us"], tuple(r["bound"])) for r in got.collect()) == want


def test_descent_plans_one_join_a_generation(spark):
    edges = spark.createDataFrame([(f"p{i // 2}", f"p{i}") for i in range(1, 40)], "parent string, child string")
    plan = graph.descendants(edges, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 15
    got = {(r["ancestor"], r["descendant"], r["depth"]) for r in graph.descendants(edges, 16).collect()}
    want = {(f"p{i >> d}", f"p{i}", d) for i in range(1, 40) for d in range(1, 7) if i >> (d - 1)}
    assert {x for x in got if x[0] != "p0" or x[2] < 7} >= {x for x in want if int(x[0][1:]) > 0} and all(int(a[1:]) == int(b[1:]) >> d for a, b, d in got)


def test_image_changes_and_evidence(spark):
    """A process that becomes a shell and leaves it again; its findings, and what they show."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    procs = [("p", 1, 0, at(0), None, "init", "/sbin/init", "init", "root")]
    named = EVENTS + ", name string, cmdline string, user string"
    rows = [(1, 1, "NETWORK_CONNECT", None, None, None, None), (2, 10, "PROCESS_EXEC", "sh", "/bin/sh", "sh -c", ""), (3, 12, "PROCESS_EXEC", "", "", "", "nobody"), (4, 14, "PROCESS_EXEC", "sh", "/bin/sh", "sh -c", "nobody"), (5, 20, "FILE_CREATE", None, None, None, None), (6, 25, "PROCESS_EXEC", "ls", "/bin/ls", "ls", "www"), (7, 200, "FILE_CREATE", None, None, None, None)]
    events = spark.createDataFrame([(i, at(s), "p", kind, 80, "/tmp/x", exe, name, cmd, user) for i, s, kind, name, exe, cmd, user in rows], named)
    p = spark.createDataFrame(procs, PROCS)
    role = dsl.Role("a", {"name": "sh"}, events=[dsl.Requirement("NETWORK_CONNECT")])
    us = lambda s: int((at(s) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    found = matcher.detect([dsl.Pattern("shell", roles=[role])], p, events, window_us=60_000_000).collect()
    assert [(r["us"], r["roles"], r["evidence"]) for r in found] == [(us(10), {"a": "p"}, [1])]
    assert [x["exe"] for x in found[0]["previous_images"]["a"]] == ["/sbin/init"] and found[0]["finding_id"] == f"finding-{us(10)}000"
    ran = [(r["exe"], r["user"]) for r in lifecycle.images(p, events).orderBy("s").collect()]
    assert ran == [("/sbin/init", "root"), ("/bin/sh", "root"), ("/bin/ls", "www")]
    steps = dsl.Sequence([dsl.Step("a", "NETWORK_CONNECT", {}, "c"), dsl.Step("a", "FILE_CREATE", {"path": {"not": ""}})], 50_000_000, 0)
    both = matcher.detect([dsl.Pattern("seq", roles=[dsl.Role("a", {"user": "www"})], sequence=steps)], p, events, window_us=60_000_000).collect()
    assert [(r["us"], r["evidence"], [tuple(c) for c in r["captures"]]) for r in both] == [(us(25), [1, 5], [("c", 1)])]
