import gzip
import hashlib
import os
import tempfile

import duckdb
from pyspark.sql import functions as F

from cardtrail.llm import warc
from cardtrail.llm.queries import ORACLE_SQL, op5_warc
from cardtrail.session import scratch_path

from .helpers import SF001

PAGES = "page_id long, url string, html string"


def brute(rows):
    out, first = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = i if first.get(b) is None else min(first[b], i) if i is not None else first[b]
    for i, _, h in rows:
        b = (h or "").encode()
        target = first.get(b) if len(b) >= 100 and first.get(b) != i else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if target is None else "revisit", target))
    return sorted(out, key=str)


def roundtrip(spark, pages):
    path = scratch_path(spark, "test-archives")
    warc.write_warc(pages, path, archive_records=5)
    return path, warc.read_warc(spark, path)


def test_records_in_payloads_and_awkward_rows(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"
    long = "<p>" + "x" * 500_000 + "</p>"
    rows = [(1, "u", fake), (2, "u", fake * 3), (3, None, None), (4, "", ""), (5, "u\r\nX: y", "\r\n"), (6, "u", "\r\n\r\n"),
            (7, "u", long), (8, "u", long), (9, "u", "é🙂" * 60), (10, "u", "é🙂" * 60), (11, "u", "short"), (12, "u", "short"),
            (None, "u", "q" * 200), (13, "u", "q" * 200), (14, "u", "WARC/1."), (15, "u", "ends\r"), (16, "u", "WARC/1.1\r\n"),
            (17, "u", "r" * 100), (17, "u", "r" * 100), (18, "u", "r" * 100), (19, "u", "r" * 99), (20, "u", "r" * 99)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("first_id", F.lit("clash"))
    path, back = roundtrip(spark, pages)
    got = back.collect()
    assert all(r["valid"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
    # the candidates held the false records that the chain rejects
    assert warc.candidates(spark, path).where("page_id = 666").count() >= 4


def test_archives_are_warc_files(spark):
    path, _ = roundtrip(spark, spark.createDataFrame([(1, "http://x/", "hello")], PAGES))
    folder = path.replace("file:", "")
    data = b"".join(gzip.open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    head, body = data.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 5" in head
    assert body == b"hello\r\n\r\n"


def test_a_broken_chain_keeps_what_comes_before(spark):
    folder = tempfile.mkdtemp(prefix="ct-warc-")
    record = lambda i, n: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\nab\r\n\r\n".encode()
    with open(f"{folder}/part-0", "wb") as f:
        f.write(record(1, 2) + record(2, 2) + record(3, 1) + record(4, 2))
    assert sorted(r["page_id"] for r in warc.read_warc(spark, folder).collect()) == [1, 2, 3]


def test_damage_is_seen(spark):
    rows = [(1, "http://a/", "first " * 40), (2, "http://b/", "first " * 40), (3, None, "third")]
    path, back = roundtrip(spark, spark.createDataFrame(rows, PAGES).coalesce(1))
    assert {(r["page_id"], r["url"], r["valid"]) for r in back.collect()} == {(1, "http://a/", True), (2, "http://b/", True), (3, None, True)}
    assert warc.unfinished(spark, path).count() == 0
    name = path.replace("file:", "")
    name = os.path.join(name, next(f for f in os.listdir(name) if f.startswith("part-")))
    data = gzip.open(name).read()
    folder = tempfile.mkdtemp(prefix="ct-warc-")
    with open(f"{folder}/part-0", "wb") as f:
        f.write(data.replace(b"first ", b"worst ", 1))
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    changed = ("first " * 40).replace("first", "worst", 1).encode()
    assert got[1]["payload_digest"] == hashlib.sha256(changed).hexdigest() and not got[1]["valid"]
    assert got[2]["payload_digest"] is None and got[2]["payload_bytes"] is None and not got[2]["valid"]
    assert got[3]["valid"] and warc.unfinished(spark, folder).count() == 0
    with open(f"{folder}/part-1", "wb") as f:
        f.write(data[:-3])
    with open(f"{folder}/part-2", "wb") as f:
        f.write(b"no archive")
    assert sorted(r["bytes"] for r in warc.unfinished(spark, folder).collect()) == [10, len(data) - 3]


def test_empty_table(spark):
    assert roundtrip(spark, spark.createDataFrame([], PAGES))[1].count() == 0


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF001}/pages.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op5_warc"]).fetchall(), key=str)
    got = sorted((tuple(r) for r in op5_warc(spark, SF001).collect()), key=str)
    assert got == want and len(got) == 250
