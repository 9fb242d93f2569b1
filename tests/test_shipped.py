"""All shipped patterns on tables large enough that each threshold is met."""

import glob
import os

import pytest

import tracewell.engine_queries as E

DATA = "/root/testdata/sf0.1"
duckdb = pytest.importorskip("duckdb")

#: What the query's SQL leaves out: the third threshold of shipped.yaml, forty names in half a minute. ev as in that SQL, with names.
LOOKUPS = f"""WITH {E._VIEWS}, ev AS (SELECT proc % 10 AS proc, epoch_us(TIMESTAMP '2024-01-01') + event_id * (200000000 // (SELECT max(event_id) FROM tele)) AS us, type, domain FROM tele),
    burst AS (SELECT proc, min(us) AS us FROM (SELECT proc, us, count(DISTINCT domain) OVER (PARTITION BY proc ORDER BY us RANGE BETWEEN 29999999 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE type = 'DNS_QUERY' AND domain <> '' AND NOT suffix(lower(domain), '.local')) AS q WHERE n >= 40 GROUP BY proc)
    SELECT 'lookup-burst' AS rule, 'MEDIUM' AS severity, 'Many names looked up at once' AS title, us, concat('lookup-burst|', proc) AS key FROM burst"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_findings_are_the_sql_and_the_bursts_of_lookups(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    told, bursts = con.execute(E.ORACLE_SQL["shipped_patterns"]).fetchall(), con.execute(LOOKUPS).fetchall()
    assert len(told) == 14 and len(bursts) == 10
    assert sorted(map(tuple, E.shipped_patterns(spark, DATA).collect())) == sorted(told + bursts)
