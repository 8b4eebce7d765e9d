"""WARC archives: writing, and reading by boundary-chain verification.

``write_warc`` writes one WARC/1.1 record per page through Spark's text writer, whose line
separator is the record terminator, so that archives can lie in any store that Spark
reaches; each is compressed with gzip. ``read_warc`` reads archives back without trusting the magic: every task scans
its archives for anything that looks like a record header, also inside payloads, and
emits (offset, offset of the successor that the header's length implies). Pointer jumping
from offset 0 of each archive then doubles the reach of every link per round and keeps
exactly the records of the chain; a header in a payload is never reached.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the smallest
page_id is a response and the others revisit it, without a payload of their own.

Null html is an empty payload; null page_id and url are written as absent headers, and a
null page_id is larger than all others. Rows that share both page_id and payload are
written once each, all as response if they are the smallest. An empty table gives an
empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import Scratch, map_batches

MAGIC = b"WARC/1."
END = "\r\n\r\n"
HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)")
URN = "urn:page:"


#: Payloads with copies that may be broadcast: rows of under 100 bytes.
MOST_BROADCAST = 100_000


def plan_records(pages: DataFrame, scratch: Scratch, min_revisit: int = 100) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.encode("payload", "utf-8"), 256)})
    same = F.col("payload_bytes") >= min_revisit
    first = (rows.where(same).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
             .where("copies > 1").select("payload_digest", "first_id"))
    first = scratch.cut(first, "first")
    if first.count() <= MOST_BROADCAST:
        first = F.broadcast(first)  # else the payloads are shuffled by digest, and AQE splits a frequent one
    rows = rows.join(first, "payload_digest", "left")
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def write_warc(pages: DataFrame, path: str, min_revisit: int = 100, archive_records: int = 4096) -> None:
    """Write archives of up to ``archive_records`` records each to the folder ``path``."""
    scratch = Scratch(pages.sparkSession, "warc-plan")
    rows = plan_records(pages, scratch, min_revisit)
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    safe_url = F.regexp_replace("url", r"[\r\n]", " ")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit(f"WARC-Record-ID: <{URN}"), F.col("page_id").cast("string"), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(F.length(safe_url) > 0, F.concat(F.lit("WARC-Target-URI: "), safe_url)),
        F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    (rows.select(F.concat(head, F.lit(END), block).alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", archive_records).option("compression", "gzip").text(path))
    scratch.drop("first")


LINKS = "archive string, at long, next long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, valid boolean"
END_MARK = "end"


def candidates(spark, path: str) -> DataFrame:
    """A row for each header found at any offset of the archives under ``path``: where it
    is, where its successor should be, and what it says; a response's length and digest are
    those of its bytes, and ``valid`` tells whether they have the digest that its header
    names. The end of each archive is a row of type END_MARK that follows itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"]):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows.append((name, len(data), len(data), None, None, END_MARK, None, None, None, True))
                at = data.find(MAGIC)
                while at >= 0:
                    stop = data.find(b"\r\n\r\n", at)
                    if stop < 0:
                        break
                    said = {m[1].lower(): m[2] for m in HEADER.finditer(data, at, stop)}
                    length = said.get(b"content-length", b"")
                    if length.isdigit() and len(length) < 19 and stop + 8 + int(length) <= len(data):
                        start, end = stop + 4, stop + 4 + int(length)
                        kind = said.get(b"warc-type", b"").decode("latin-1")
                        digest = said.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("latin-1")
                        uri = said.get(b"warc-target-uri")
                        size, found = int(length), digest
                        if kind == "response":
                            found = hashlib.sha256(memoryview(data)[start:end]).hexdigest()
                        rows.append((name, at, end + 4, _page(said.get(b"warc-record-id")), uri and uri.decode("utf-8", "replace"), kind, size, found,
                                     _page(said.get(b"warc-refers-to")), found == digest))
                    at = data.find(MAGIC, at + 1)
            names = [c.split()[0] for c in LINKS.split(", ")]
            nullable = ("page_id", "refers_to", "payload_bytes")  # never through floats
            yield pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="Int64") if n in nullable else [r[i] for r in rows] for i, n in enumerate(names)})

    return map_batches(files, run, LINKS)


def _page(urn: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d{1,19})>", urn or b"")
    return int(m[1]) if m else None


def reachable(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(archive, at) of the links reached from offset 0, by pointer jumping.

    Each round holds the set reached by fewer than 2^r steps and each link's 2^r-th
    successor; it adds the successors of the reached set and doubles the jumps. Rounds
    end when nothing is added: log2 of the longest chain."""
    jump = links.select("archive", "at", "next")
    reached = jump.where("at = 0").select("archive", "at")
    count, number = reached.count(), 0
    while True:
        ahead = jump.join(reached, ["archive", "at"], "left_semi").select("archive", F.col("next").alias("at"))
        found = jump.select("archive", "at").join(ahead.unionByName(reached), ["archive", "at"], "left_semi")
        found = scratch.cut(found, f"reached{number}")
        total = found.count()
        if total == count:
            return found
        further = jump.select("archive", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jump = scratch.cut(jump.join(further, ["archive", "next"]).select("archive", "at", F.col("beyond").alias("next"))
                           .unionByName(jump.join(further, ["archive", "next"], "left_anti").select("archive", "at", "next")), f"jump{number}")
        if number:
            scratch.drop(f"reached{number - 1}", f"jump{number - 1}")
        reached, count, number = found, total, number + 1


RECORDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


def read_warc(spark, path: str) -> DataFrame:
    """The records of the chain of every archive under ``path``: page_id, url, payload_bytes
    and payload_digest of the full payload, record_type, refers_to, valid.

    Lengths and digests come from the bytes read: a response's from its own, a revisit's
    from the response that it names, if that one has the digest that the revisit names;
    else they are null and the revisit is not valid."""
    scratch = Scratch(spark, "warc")
    links = scratch.cut(candidates(spark, path), "links")
    records = links.join(reachable(links, scratch), ["archive", "at"], "left_semi").where(F.col("record_type") != END_MARK)
    responses = (records.where("record_type = 'response'")
                 .select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")).distinct())
    revisits = records.where("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumns({"payload_bytes": F.col("full_bytes"), "payload_digest": F.col("full_digest"), "valid": F.col("full_digest").isNotNull()})
    return records.where("record_type <> 'revisit'").select(*RECORDS).unionByName(revisits.select(*RECORDS))


def unfinished(spark, path: str) -> DataFrame:
    """The archives under ``path`` (archive, bytes) whose chain doesn't lead to their end:
    what stands behind the break is in no record."""
    scratch = Scratch(spark, "warc-chains")
    links = scratch.cut(candidates(spark, path), "links")
    ends = links.where(F.col("record_type") == END_MARK).select("archive", "at")
    return ends.join(reachable(links, scratch), ["archive", "at"], "left_anti").withColumnRenamed("at", "bytes")
