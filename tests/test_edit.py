"""Editing pattern files, the log table, and defaults that depend on sources."""

import datetime as dt

import pytest
import yaml

from tracewell import queries as Q
from tracewell.functions.predicates import PatternError
from tracewell.operators import store
from tracewell.plans import dsl, edit, matcher

FILE = """# who owns this file
patterns:
  # first
  - name: one
    processes:
      - {id: a, match: {name: sh}}   # shells

  - name: two
    processes:
      - id: a
        events:
          - type: FILE_CREATE
            where: {path: {glob: "/tmp/*"}}
# about exclusions
exclusions:
  - rules: [one]
    match: {user: root}
    # a remark inside

# the end
"""


def test_all_problems_of_an_entry_with_their_lines():
    text = "name: x\nseverty: HIGH\nprocesses:\n  - id: a\n    match:\n      name: {regex: '('}\n      cmdline: {gt: 3}\n    events:\n      - type: DNS_QUERY\n        wher: {}\n        where: {remote_port: 1}\n"
    got = edit.pattern_problems(text)
    assert [p.line for p in got] == [2, 6, 7, 10, 11] and got[0].path == "severty" and got[3].path == "processes[0].events[0].wher"
    assert edit.pattern_problems("name: x\nprocesses: [{id: a}]\n") == []
    assert [p.line for p in edit.pattern_problems("name: x\nprocesses: [{id: a\n")] == [3]
    assert edit.pattern_problems("")[0].message and edit.pattern_problems("- a")[0].line == 1
    assert "duplicate" in (m := edit.pattern_problems("name: x\nprocesses: [{id: a}, {id: a}]\n")[0].message).lower() or m
    assert [(p.line, p.path) for p in edit.exclusion_problems("exclusions:\n- rules: [a]\n  match: {name: sh}\n- rules: [b]\n- rule: [b]\n  match: {name: {gt: 1}}\n")] == [(4, "[1]"), (5, "[2].rule")]
    assert edit.exclusion_problems("- rules: [a]\n  match: {name: sh}\n") == [] and edit.exclusion_problems("") == []


def test_changes_leave_the_rest_as_it_is_written():
    more = dsl.Exclusion(["two"], {"exe": {"eq": "/bin/x"}}, "why")
    new = edit.append_exclusion(FILE, more)
    kept = [x for x in new.splitlines() if x in FILE.splitlines()]
    assert kept == FILE.splitlines() and len(dsl.load(new).exclusions) == 2 and dsl.load(new).exclusions[1] == more
    assert new.index("rules: [one]") < new.index("- two") < new.index("# the end")
    bare = edit.append_exclusion("patterns: []  # none\n", more)
    assert bare.startswith("patterns: []  # none\nexclusions:\n") and dsl.load(bare).exclusions == [more]
    assert len(dsl.load(edit.append_exclusion("exclusions: [{rules: [a], match: {name: sh}}]\npatterns: []", more)).exclusions) == 2
    edited = edit.replace_pattern(FILE, "one", "name: one\nseverity: HIGH\nprocesses:\n  - id: a\n")
    assert dsl.load(edited).patterns[0].severity == "HIGH" and edited.split("- name: two")[1] == FILE.split("- name: two")[1] and "# first" in edited
    none = edit.replace_exclusions(FILE, [])
    assert "exclusions:" not in none.replace("# about exclusions", "") and "# the end" in none and yaml.safe_load(none)["patterns"] == yaml.safe_load(FILE)["patterns"]
    for name, text in (("three", "name: three\nprocesses: [{id: a}]"), ("one", "name: one\noops: 1")):
        with pytest.raises(PatternError):
            edit.replace_pattern(FILE, name, text)


def test_log_reads_and_drops_days(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2026, 1, d, h)
    rows = [(i, day(1 + i % 9, i % 24), ("DNS", "File")[i % 2], i) for i in range(200)]
    path = f"file://{tmp_path}/log"
    frame = spark.createDataFrame(rows, "id long, ts timestamp_ntz, tab string, k long")
    store.append(frame.filter("id < 100"), path)
    frame.filter("id >= 100").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = store.append_stream(stream, path, f"file://{tmp_path}/checkpoint", once=True)
    assert query.awaitTermination(60) and query.exception() is None
    log = store.open_log(spark, path, "id long, ts timestamp_ntz, k long")
    got = store.log_query(log, "DNS", day(3, 5), day(4, 20), 1000)
    assert [r["id"] for r in got.collect()] == [i for i, ts, tab, _ in rows if tab == "DNS" and day(3, 5) <= ts <= day(4, 20)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tab" in plan and "day#" in plan.split("PartitionFilters")[1].split("]")[0]
    gone = store.drop_expired(spark, path, day(9, 12), 3)
    assert gone == [f"tab={t}/day=2026-01-0{d}" for t in ("DNS", "File") for d in range(1, 6)]
    assert sorted(r["id"] for r in store.open_log(spark, path, "id long, ts timestamp_ntz, k long").collect()) == [i for i, ts, *_ in rows if ts >= day(6)]


def test_drafted_exclusions():
    process = {"exe": "/opt/tool/run", "cmdline": "run --fast x", "user": "www"}
    assert dsl.draft_exclusion("r", process, {"exe": "prefix", "cmdline": "prefix", "name": "eq"}).match == {"exe": {"prefix": "/opt/tool/"}, "cmdline": {"prefix": "run "}}
    assert dsl.draft_exclusion("r", {"exe": "run", "cmdline": "run"}, {"exe": "prefix", "cmdline": "contains"}).match == {"exe": {"prefix": "run"}, "cmdline": {"contains": "run"}}
    for modes in ({"exe": "regex"}, {"nope": "eq"}, {"name": "eq"}):
        with pytest.raises(PatternError):
            dsl.draft_exclusion("r", process, modes)


def test_defaults_by_source():
    assert matcher.default_tolerance("ebpf", "ebpf") == 250_000 and matcher.default_tolerance("poll", "ebpf") == matcher.default_tolerance("ebpf", "poll") == 3_000_000
    assert len(Q.shipped().patterns) == 4
