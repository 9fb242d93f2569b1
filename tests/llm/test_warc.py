import base64
import gzip
import hashlib
import os
import zlib

import pytest

from tracewell.llm import warc

PAGES = "page_id long, url string, html string, sha string, keep long, n long, salt int, salts int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2, 3, 4, "y") for i, u, h in rows], PAGES)


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        first = min(same) if same and len(body) >= least and i is not None else i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=repr)


ROWS = [(i, f"https://x.org/{i} ä\r\nX: 1", h) for i, h in enumerate(["<p>a</p>", None, "", "WARC/1.1\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 40_000, "<p>a</p>", " ", "x" * 300_000, "é" * 40_000])] + [(100 + i, None, "hot page") for i in range(60)] + [(None, "u", "hot page"), (100, "v", "hot page")]


@pytest.mark.parametrize("least", [0, 7, 10**6])
def test_round_trip(spark, least):
    got = warc.round_trip(pages(spark, ROWS).repartition(3), least)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS, least)


def test_hot_digests_are_dealt_to_groups(spark):
    planned = warc.plan_records(pages(spark, ROWS), parts=20)
    got = [(r["record_id"], r["record_type"], r["refers_to"]) for r in planned.collect()]
    assert sorted(got) == sorted((f"urn:page:{'none' if i is None else i}", kind, to if to is None else f"urn:page:{to}") for i, _, _, kind, to in brute(ROWS))


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, ROWS).limit(0)).collect() == []


def test_predicates_are_pushed_and_blocks_skipped(spark, tmp_path):
    warc.archive(pages(spark, ROWS), f"file://{tmp_path}/a")
    found = warc.read_archive(spark, f"file://{tmp_path}/a", "record_id string, record_type string, x_payload_length string").filter("record_type = 'revisit' and x_payload_length = '8'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "Filter " not in plan  # nothing is left for Spark to filter
    assert found.count() == len([r for r in brute(ROWS) if r[3] == "revisit" and r[1] == 8])
    # a damaged block is only met by those who ask for payloads
    name = next(os.path.join(at, f) for at, _, files in os.walk(tmp_path / "a") for f in files if f.endswith(".warc.gz"))
    big = warc.gzip_member(warc.record({"record_type": "response", "record_id": "urn:page:9", "payload": os.urandom(200_000), "target_uri": "u"}), 6)
    with open(name, "ab") as f:
        f.write(big[:150_000] + b"\xff" * 1000 + big[151_000:])
    assert warc.read_archive(spark, f"file://{tmp_path}/a", "record_id string").filter("record_id = 'urn:page:9'").count() == 1
    with pytest.raises(Exception, match="(?i)error|incorrect|invalid"):
        warc.read_archive(spark, f"file://{tmp_path}/a").select("payload").collect()


def test_foreign_archives(spark, tmp_path):
    """Plain and gzipped members without lengths, folded headers, chunked and compressed bodies, other record types."""
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nab\r\n\r\n3;x=1\r\ncde\r\n0\r\n\r\n"
    zipped = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"inner")

    def rec(kind, block, ctype="application/http; msgtype=response"):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nWARC-Target-URI: http://a/\r\n  b\r\nContent-Type: {ctype}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [rec("response", chunked), rec("metadata", b"k: v", "application/warc-fields"), rec("response", zipped), rec("resource", b"raw", "text/plain")]
    os.makedirs(tmp_path / "f/sub")
    (tmp_path / "f/a.warc").write_bytes(b"".join(records))
    (tmp_path / "f/sub/b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "f/c.warc.gz.tmp").write_bytes(b"not read")
    got = warc.read_archive(spark, str(tmp_path / "f")).collect()
    assert sorted((r["record_type"], bytes(r["payload"])) for r in got) == sorted([("response", b"ab\r\ncde"), ("metadata", b"k: v"), ("response", b"inner"), ("resource", b"raw")] * 2)
    assert {r["target_uri"] for r in got} == {"http://a/ b"} and got[0]["headers"]["warc-type"]
    assert sorted(r[0] for r in warc.read_archive(spark, str(tmp_path / "f"), "record_type string").filter("record_type like 'res%' and record_type in ('resource', 'x')").collect()) == ["resource"] * 2


def test_members_tell_their_length():
    member = warc.gzip_member(b"abc" * 100, 6)
    assert zlib.decompress(member, 31) == b"abc" * 100 and int.from_bytes(member[16:20], "little") == len(member)
