"""Streaming extract against the batch extract; sinks and job entry points."""

import os
import tempfile

from pyspark.sql import functions as F

from cardtrail import jobs, sinks
from cardtrail.functions import predicates as P
from cardtrail.plans import two_round
from cardtrail.queries import BEGIN, CARDS, END
from cardtrail.sources.cards import cards_from_list, cards_from_text
from cardtrail.sources.testdata import transaction_view
from cardtrail.streaming.extract import extract_stream

from .conftest import SF001


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stream_extract_equals_batch(spark):
    tmp = tempfile.mkdtemp(prefix="ct-stream-")
    view = transaction_view(spark, SF001).filter(P.date_closed(BEGIN, END))
    # The history arrives as two batches of files.
    view.filter(F.col("pdate") < "19970215").write.parquet(f"{tmp}/src/part=1")
    view.filter(F.col("pdate") >= "19970215").write.parquet(f"{tmp}/src/part=2")
    cards = cards_from_list(spark, CARDS)
    q = extract_stream(spark, f"{tmp}/src/*", view.schema, cards, f"{tmp}/sink",
                       checkpoint=f"{tmp}/ckpt", known_rows=len(CARDS))
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp}/sink")
    want = two_round.round0_extract(view, cards, len(CARDS))
    assert got.count() == 30
    assert _sorted(got.select(*want.columns)) == _sorted(want)


def test_sinks_roundtrip(spark):
    tmp = tempfile.mkdtemp(prefix="ct-sinks-")
    df = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "c string, d string, round int")
    sinks.write_row_text(df.select("c", "d"), f"{tmp}/text")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp}/text").collect())
    assert lines == ["[a,null]", "[b,x]"]
    sinks.write_delimited(df.select("c", "d"), f"{tmp}/tsv")
    raw = "".join(open(os.path.join(f"{tmp}/tsv", f)).read()
                  for f in os.listdir(f"{tmp}/tsv") if f.endswith(".txt"))
    assert sorted(raw.split("\n")[:-1]) == ["a\t\\N", "b\tx"]
    sinks.write_rounds(df, f"{tmp}/rounds")
    assert {d for d in os.listdir(f"{tmp}/rounds") if d.startswith("round=")} == \
        {"round=1", "round=2"}


def test_jobs(spark):
    tmp = tempfile.mkdtemp(prefix="ct-jobs-")
    with open(f"{tmp}/seeds.txt", "w") as f:
        f.write("\n".join(CARDS) + "\n")
    seeds = cards_from_text(spark, f"{tmp}/seeds.txt")
    history = transaction_view(spark, SF001)
    assert jobs.two_rounds_job(spark, history, seeds, BEGIN, END, f"{tmp}/two") == 20
    assert spark.read.parquet(f"{tmp}/two/extract").count() == 30
    assert spark.read.parquet(f"{tmp}/two/cards_round0").count() == 12
    history.write.parquet(f"{tmp}/hist")
    args = jobs.SearchArgs.parse([BEGIN, END, f"{tmp}/hist", "tfr_out_acct_no",
                                  "tfr_in_acct_no", ",".join(CARDS)])
    res = jobs.parametric_trace(spark, args, fmt="parquet")
    assert res == [10, 17, 25, 31, 34, 36, 37, 39, 40, 40]
    res = jobs.parametric_trace(spark, args, out=f"{tmp}/trace", fmt="parquet")
    assert spark.read.parquet(f"{tmp}/trace/cards").count() == 40
    res = jobs.two_round_trace_job(history, seeds, BEGIN, END, f"{tmp}/trace2")
    assert res == [10, 25, 54] and spark.read.parquet(f"{tmp}/trace2/cards").count() == 54
    jobs.transfer_cards_job(spark.read.parquet(f"{tmp}/two/extract"), f"{tmp}/transfer-cards")
    assert spark.read.parquet(f"{tmp}/transfer-cards").count() == 12
    assert [r["n_unreadable"] for r in spark.read.parquet(f"{tmp}/two/unreadable").collect()] == [0, 0]
    res = jobs.every_round_job(history, seeds, BEGIN, END, f"{tmp}/every")
    assert spark.read.parquet(f"{tmp}/every/transfers").count() == 384
    res = jobs.edges_job(history, seeds, BEGIN, END, f"{tmp}/edges")
    assert res.sizes == [10, 25, 55, 119, 200]
    assert spark.read.text(f"{tmp}/edges").count() == 203
    res = jobs.all_rows_job(history, seeds, BEGIN, END, f"{tmp}/all")
    assert spark.read.text(f"{tmp}/all/consumption").count() == 97
    assert spark.read.text(f"{tmp}/all/transfers").count() == 315
    jobs.extract_job(history, seeds, BEGIN, END, f"{tmp}/extract")
    assert spark.read.parquet(f"{tmp}/extract").count() == 30
    plain = cards_from_list(spark, ["6222021234567890"])
    assert jobs.digest_cards(plain, "demo-key").first()["card"] == "25eb098adee3cea314e45c2f8ef0181d"


def test_stream_extract_resumes_from_checkpoint(spark):
    tmp = tempfile.mkdtemp(prefix="ct-stream2-")
    view = transaction_view(spark, SF001).filter(P.date_closed(BEGIN, END))
    cards = cards_from_list(spark, CARDS)
    view.filter(F.col("pdate") < "19970215").write.parquet(f"{tmp}/src/part=1")
    q = extract_stream(spark, f"{tmp}/src/*", view.schema, cards, f"{tmp}/sink",
                       checkpoint=f"{tmp}/ckpt", known_rows=len(CARDS))
    q.awaitTermination()
    first = spark.read.parquet(f"{tmp}/sink").count()
    # A new day arrives; the next run only reads the new files.
    view.filter(F.col("pdate") >= "19970215").write.parquet(f"{tmp}/src/part=2")
    q = extract_stream(spark, f"{tmp}/src/*", view.schema, cards, f"{tmp}/sink",
                       checkpoint=f"{tmp}/ckpt", known_rows=len(CARDS))
    q.awaitTermination()
    assert first < 30
    assert spark.read.parquet(f"{tmp}/sink").count() == 30


def test_trace_cleanup_removes_its_folder(spark):
    from cardtrail.plans import closure
    rows = spark.createDataFrame([("a", "b")], "s string, d string")
    res = closure.trace(rows, cards_from_list(spark, ["a"]), "s", "d")
    assert not os.path.exists(res.path.replace("file:", "") + "/adjacency")
    assert os.path.exists(res.path.replace("file:", "") + "/frontier")
    res.cleanup()
    assert not os.path.exists(res.path.replace("file:", ""))


def test_catalog_tables(spark):
    from cardtrail.sources.history import history_schema
    name = "ct_cards_" + os.urandom(4).hex()
    schema = history_schema(["card"])
    assert sinks.ensure_table(spark, name, schema) is True
    assert sinks.ensure_table(spark, name, schema) is False
    cards_from_list(spark, ["a", "b"]).write.mode("append").insertInto(name)
    assert spark.table(name).count() == 2
    sinks.save_table(cards_from_list(spark, ["c"]), name)
    assert [r["card"] for r in spark.table(name).collect()] == ["c"]
    sinks.drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
