"""Ids above 2^53 beside null ids in one partition, per operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardtrail.llm import byte_bpe, exact_topk, main_text, mixing, neardup, nndescent, ppm, secret_scan, toxicity, warc

from .helpers import SF0001, documents

BIG = 9007199254740993
TEXT = "one two three four five six seven eight nine ten"
ROWS = [(None, TEXT, "en", "a", None), (BIG, TEXT + " eleven", "en", "a", BIG), (BIG + 2, TEXT + " eleven twelve", "en", "a", 3), (None, None, None, None, None)]
IDS = sorted(str(r[0]) for r in ROWS)


def labels(spark):
    return spark.createDataFrame([(BIG, 0, 0)], "doc_id long, quality int, toxic int")


DOCUMENT_OPERATORS = {
    "scan": lambda docs, _: secret_scan.scan_secrets(docs),
    "redact": lambda docs, _: secret_scan.redact_secrets(docs),
    "encode": lambda docs, _: byte_bpe.encode(docs),
    "digests": lambda docs, _: byte_bpe.encode_digests(docs),
    "decode": lambda docs, _: byte_bpe.decode(byte_bpe.encode(docs)),
    "neardup": lambda docs, _: neardup.near_duplicates(docs),
    "ppm": lambda docs, _: ppm.score_documents(docs),
    "toxicity": lambda docs, of: toxicity.score_documents(docs, of),
    "drop toxic": lambda docs, of: toxicity.drop_toxic(docs, of),
    "mix": lambda docs, _: mixing.mix(docs),
}


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_document_operators(spark, name):
    docs = documents(spark, ROWS).coalesce(1)
    out = DOCUMENT_OPERATORS[name](docs, labels(spark))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == IDS
    if "n_chars" in out.columns:
        kept = {r["doc_id"]: r["n_chars"] for r in out.where("doc_id is not null").collect()}
        assert kept == ({BIG: BIG, BIG + 2: 3} if name == "drop toxic" else {BIG: len(ROWS[1][1]), BIG + 2: len(ROWS[2][1])})


def test_near_duplicates_keep_their_links(spark):
    long = " ".join(f"w{n}" for n in range(60))
    rows = [(i, f"{long} {t[-6:]}" if t else t, *r) for i, t, *r in ROWS]
    found = neardup.near_duplicates(documents(spark, rows).coalesce(1)).where("doc_id is not null")
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(BIG, BIG), (BIG + 2, BIG)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, documents(spark, ROWS).coalesce(1), SF0001)
    ids = {str(r["doc_id"]) for r in out.select("doc_id").collect()}
    assert ids <= set(IDS) and str(BIG) in ids


def test_pages(spark):
    rows = [(None, "u", "<p>no id</p>" * 20), (BIG, "v", "<p>big</p>"), (BIG + 2, "w", "<p>no id</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = sorted(str(r[0]) for r in rows)
    assert sorted(str(r["page_id"]) for r in main_text.extract_main_text(pages).collect()) == want
    path = corpus_pipeline.Scratch(spark, "test-ids").path("archives")
    warc.write_warc(pages, path)
    assert sorted(str(r["page_id"]) for r in warc.read_warc(spark, path).collect()) == want


def test_vectors(spark):
    rows = [(None, [1.0, 0.0]), (BIG, [0.5, 0.5]), (BIG + 2, [0.0, 1.0]), (BIG + 4, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    ids = {r[0] for r in rows[1:]}
    query = F.col("vec_id").isNotNull()
    for out in (exact_topk.exact_topk(vectors, vectors.where(query), k=2), nndescent.nearest(vectors, query, k=2)):
        got = out.collect()
        assert {r["query_id"] for r in got} <= ids and {r["vec_id"] for r in got} <= ids | {None} and len(got) >= 6
