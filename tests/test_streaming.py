"""Streams against batches: the same findings, and the same process events."""

import datetime as dt
import os
import random

import pytest

from tracewell.operators import lifecycle
from tracewell.plans import dsl, matcher
from tracewell.sources import raw
from tracewell.streaming import health, tracker
from tracewell.streaming.live import LiveDetector, event_stream

T0 = dt.datetime(2026, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, proc string, type string, remote_port long, path string, pid long, ppid long, start timestamp_ntz, name string, exe string, cmdline string, user string"
PROCS = "proc string, pid long, ppid long, start timestamp_ntz, exited_at timestamp_ntz, name string, exe string, cmdline string, user string"
W = 30_000_000


def at(s):
    return T0 + dt.timedelta(seconds=s)


def world(seed, n=260):
    """Events in order: processes start, change their program and exit in the stream; PIDs are reused; some run before it."""
    rng = random.Random(seed)
    seeded = [(f"s{i}", i, 0, at(-100), None, rng.choice(["sh", "node"]), f"/bin/{i}", "", "") for i in range(3)]
    alive = {r[0]: r[1] for r in seeded}
    rows, made = [], 0
    for i in range(n):
        t, roll = at(2 * i), rng.random()
        if roll < 0.18 or not alive:
            free = [x for x in range(9) if x not in alive.values()]
            if free:
                made += 1
                pid = rng.choice(free)
                alive[f"p{made}"] = pid
                rows.append((i, t, f"p{made}", "PROCESS_START", None, None, pid, rng.choice([*alive.values(), 77]), t, rng.choice(["sh", "node", "curl"]), "/bin/x", "x", "root"))
                continue
        who = rng.choice(sorted(alive))
        if roll < 0.28 and len(alive) > 2:
            del alive[who]
            rows.append((i, t, who, "PROCESS_EXIT", *[None] * 9))
        elif roll < 0.4:
            rows.append((i, t, who, "PROCESS_EXEC", None, None, None, None, None, rng.choice(["sh", "curl", ""]), rng.choice(["/bin/sh", "/bin/curl"]), "", rng.choice(["", "www"])))
        else:
            rows.append((i, t, who, rng.choice(["NETWORK_CONNECT", "FILE_CREATE", "FILE_CREATE"]), rng.randrange(5), f"/tmp/{rng.randrange(3)}", *[None] * 7))
    return seeded, rows


def patterns():
    need = dsl.Requirement
    seq = dsl.Sequence([dsl.Step("a", "FILE_CREATE", {}, "f"), dsl.Step("b", "FILE_CREATE", {"path": {"eq": "$f.path"}})], 20_000_000, 2_000_000)
    return [
        dsl.Pattern("both", roles=[dsl.Role("a", events=[need("NETWORK_CONNECT"), need("FILE_CREATE")])], max_findings=2),
        dsl.Pattern("shell", roles=[dsl.Role("a", {"name": "sh"})], max_findings=100),
        dsl.Pattern("counted", roles=[dsl.Role("a", {"name": {"not": "node"}}, events=[need("FILE_CREATE", count=2, within_us=15_000_000)])], max_findings=100),
        dsl.Pattern("family", roles=[dsl.Role("a"), dsl.Role("b", {"name": {"in": ["sh", "curl"]}}, events=[need("FILE_CREATE")])], edges=[dsl.Edge("DESCENDANT", "a", "b", 3)], max_findings=100),
        dsl.Pattern("staged", roles=[dsl.Role("a"), dsl.Role("b")], edges=[dsl.Edge("SPAWNED", "a", "b")], sequence=seq, max_findings=100),
    ]


def said(df):
    return sorted((r["rule"], r["us"], r["key"]) for r in df.collect())


def batch(spark, found, seeded, rows):
    events = spark.createDataFrame(rows, EVENTS)
    p = lifecycle.arrived(spark.createDataFrame(seeded, PROCS), events)
    return said(matcher.detect(found.patterns, p, events, None, found.exclusions, W))


@pytest.mark.parametrize("which", [(0, 3), (1, 2), (4,)])
def test_micro_batches_report_what_one_batch_does(spark, tmp_path, which):
    seeded, rows = world(1, 130)
    found = dsl.PatternSet([patterns()[k] for k in which], [dsl.Exclusion(["family"], {"user": "www"})])
    live = LiveDetector(spark, found, spark.createDataFrame(seeded, PROCS), f"file://{tmp_path}/live", W)
    cuts = [0, 60, 61, len(rows)]
    for k in range(3):
        part = spark.createDataFrame(rows[cuts[k] : cuts[k + 1]], EVENTS)
        live.process(part, k)
        if k == 1:  # a batch that is repeated after a failure, by another driver
            live = LiveDetector(spark, found, spark.createDataFrame(seeded, PROCS), f"file://{tmp_path}/live", W)
            live.process(part, k)
    want = batch(spark, found, seeded, rows)
    assert said(live.findings()) == want and {r[0] for r in want} == {p.name for p in found.patterns}
    assert len(list((tmp_path / "live" / "state").glob("batch=*"))) <= 2


def test_a_running_stream_survives_restarts_and_agrees_with_the_batch(spark, tmp_path):
    """Ordered files of events, one micro-batch a file; the query is stopped and started again from its checkpoint."""
    seeded, rows = world(6, 200)
    found = dsl.PatternSet(patterns()[:1])
    size = -(-len(rows) // 3)
    for k in range(3):
        spark.createDataFrame(rows[size * k : size * k + size], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    watch = health.StreamHealth()
    spark.streams.addListener(watch)
    os.makedirs(tmp_path / "seen")
    for k in range(3):  # each start sees one more file
        for f in (tmp_path / "in" / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / "seen" / f"{k}-{f.name}")
        live = LiveDetector(spark, found, spark.createDataFrame(seeded, PROCS), f"file://{tmp_path}/live", W)
        stream = health.observed(event_stream(spark, f"file://{tmp_path}/seen", EVENTS, 1))
        query = live.start(stream, f"file://{tmp_path}/checkpoint", once=True)
        assert query.awaitTermination(120) and query.exception() is None
    spark.streams.removeListener(watch)
    assert said(live.findings()) == batch(spark, found, seeded, rows)
    assert len(list((tmp_path / "live" / "events").glob("batch=*"))) < 3  # expired events are gone
    assert watch.counters["events"] == len(rows) and watch.counters["batches"] >= 3 and watch.counters["failed"] == 0
    assert watch.line().startswith(f"events={len(rows)} ") and "PROCESS_EXEC" in watch.by_type


def test_late_events_count_from_when_they_come(spark, tmp_path):
    proc = [("p", 1, 0, at(-5), None, "sh", "/bin/sh", "", "")]
    row = lambda i, s, kind: (i, at(s), "p", kind, *[None] * 9)
    need = [dsl.Requirement("NETWORK_CONNECT"), dsl.Requirement("FILE_CREATE")]
    live = LiveDetector(spark, dsl.PatternSet([dsl.Pattern("both", roles=[dsl.Role("a", events=need)])]), spark.createDataFrame(proc, PROCS), f"file://{tmp_path}/live", W)
    live.process(spark.createDataFrame([row(1, 100, "NETWORK_CONNECT")], EVENTS), 0)
    live.process(spark.createDataFrame([row(2, 95, "FILE_CREATE"), row(3, 10, "FILE_CREATE"), row(4, 101, "DNS_QUERY")], EVENTS), 1)
    base = int((T0 - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    assert [r[1] for r in said(live.findings())] == [base + 100_000_001]
    live.process(spark.createDataFrame([], EVENTS), 2)  # an empty batch is passed over
    assert len(said(live.findings())) == 1


def test_set_clears_what_reload_keeps(spark, tmp_path):
    proc = [("p", 1, 0, at(-5), None, "sh", "/bin/sh", "", "")]
    row = lambda i, s: (i, at(s), "p", "FILE_CREATE", *[None] * 9)
    pattern = dsl.Pattern("files", roles=[dsl.Role("a", events=[dsl.Requirement("FILE_CREATE")])])
    live = LiveDetector(spark, dsl.PatternSet([pattern]), spark.createDataFrame(proc, PROCS), f"file://{tmp_path}/live", W)
    one = lambda i, s: live.process(spark.createDataFrame([row(i, s)], EVENTS), i)
    one(0, 0)
    live.reload(dsl.PatternSet([pattern, dsl.Pattern("more", roles=[dsl.Role("a", events=[dsl.Requirement("FILE_CREATE")])])]))
    one(1, 5)
    assert [r[0] for r in said(live.findings())] == ["files", "more"]
    live.set_patterns(dsl.PatternSet([pattern]))
    one(2, 10)
    assert [r[0] for r in said(live.findings())] == ["files", "files", "more"]
    again = LiveDetector(spark, dsl.PatternSet([pattern]), spark.createDataFrame(proc, PROCS), f"file://{tmp_path}/live", W)
    assert again.epoch == 1


def test_patterns_are_reloaded_between_batches(spark, tmp_path):
    path = tmp_path / "p.yaml"
    text = "patterns: [{name: %s, processes: [{id: a, events: [{type: FILE_CREATE}]}]}]"
    path.write_text(text % "one")
    reader = dsl.Reloader(str(path))
    reader.poll()
    live = LiveDetector(spark, reader.current, spark.createDataFrame([], PROCS), f"file://{tmp_path}/live", W, reloader=reader)
    for name, want in (("two", "two"), ("{broken", "two")):
        path.write_text(text % name)
        live.process(spark.createDataFrame([], EVENTS), 0)
        assert [p.name for p in live.found.patterns] == [want]


def naive(records, seed, grace):
    """One host's records in order."""
    held = {r[1]: [r[2], r[3], r[4], None] for r in seed}
    out = []

    def announce(pid):
        if held[pid][3] is not None:
            out.append(("PROCESS_START", pid, held[pid][1], held[pid][3], held[pid][2], False))
            held[pid][3] = None

    def end(pid, at, inferred):
        announce(pid)
        out.append(("PROCESS_EXIT", pid, held[pid][1], at, held[pid][2], inferred))
        del held[pid]

    for _, kind, pid, ppid, start, at_us, _, name, *_ in records:
        for _, p in sorted((x[3], p) for p, x in held.items() if x[3] is not None and x[3] + grace < at_us):
            announce(p)
        if pid in held and held[pid][1] != start and kind != "exit":
            end(pid, at_us, True)
        if kind == "fork" and pid not in held:
            if ppid in held:
                announce(ppid)
            held[pid] = [ppid, start, held[ppid][2] if ppid in held else name, at_us]
        elif kind == "exec":
            fresh = pid not in held or held[pid][3] is not None
            held[pid] = [ppid, start, name, None]
            out.append(("PROCESS_START" if fresh else "PROCESS_EXEC", pid, start, at_us, name, False))
        elif kind == "exit" and pid in held and held[pid][1] == start:
            end(pid, at_us, False)
    for _, p in sorted((x[3], p) for p, x in held.items() if x[3] is not None):
        announce(p)
    return sorted(out)


def test_raw_records_have_what_the_tracker_takes(spark):
    rows = [("exec", 5, 1, 7, 9, "a-very-long-nam", "/bin/a-very-long-name", "x", "/bin/a-very-long-name", "root"), ("fork", 6, 5, 8, 8, "", "/bin/sh", None, None, None)]
    got = raw.process_records(spark.createDataFrame(rows, raw.PROCESS_RECORDS))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], tracker.RECORDS).schema]
    assert [r["name"] for r in got.collect()] == ["a-very-long-name", "sh"]


def test_kernel_records_become_process_events_in_a_stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracker.PROVIDER)
    rng, base = random.Random(3), 1_767_225_600_000_000
    seed = [(h, 1, 0, 5, "init", "/sbin/init", "", "root") for h in ("h1", "h2")]
    records, holder = [], {"h1": {}, "h2": {}}
    for i in range(300):
        host = rng.choice(["h1", "h2"])
        now, roll = base + i * 20_000, rng.random()
        if roll < 0.45 or not holder[host]:
            pid = rng.randrange(2, 14)
            holder[host][pid] = now
            records.append((host, "fork", pid, rng.choice([1, *holder[host]]), now, now, f"n{i}"))
        else:
            pid = rng.choice(sorted(holder[host]))
            kind = "exec" if roll < 0.8 else "exit"
            records.append((host, kind, pid, 1, holder[host][pid], now, f"n{i}"))
            if kind == "exit":
                del holder[host][pid]
    rows = [(*r[:6], dt.datetime.fromtimestamp(r[5] / 1e6, dt.UTC), r[6], f"/bin/{r[6]}", "", "") for r in records]
    end = [("h1", "exit", 999, 1, 1, base + 90_000_000, dt.datetime.fromtimestamp((base + 90_000_000) / 1e6, dt.UTC), "", "", "", "")]
    for k, part in enumerate([rows[:100], rows[100:200], rows[200:], end, end]):
        spark.createDataFrame(part, tracker.RECORDS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(tracker.RECORDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seeded = spark.createDataFrame(seed, "host string, pid long, ppid long, start long, name string, exe string, cmdline string, user string")
    made = tracker.track(stream, seeded)
    query = made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(150) and query.exception() is None
    finally:
        query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(tracker.EVENTS).parquet(f"{tmp_path}/out").collect()
    for host in ("h1", "h2"):
        mine = sorted((r["type"], r["pid"], r["start"], r["at"], r["name"], r["inferred"]) for r in got if r["host"] == host)
        assert mine == naive([r for r in rows if r[0] == host], [s for s in seed if s[0] == host], 50_000)
