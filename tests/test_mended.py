"""Cases that once lost or changed data, and the plans of wide card lists."""

import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cardtrail import sinks
from cardtrail.functions import predicates as P
from cardtrail.operators import semi, summary
from cardtrail.sources.cards import cards_from_arg, cards_from_list
from cardtrail.sources.testdata import transaction_view
from cardtrail.streaming.extract import extract_stream

from .conftest import SF001
from .test_streaming_sinks import BEGIN, CARDS, END


def test_stream_extract_resumes_with_the_default_checkpoint(spark):
    tmp = tempfile.mkdtemp(prefix="ct-stream3-")
    view = transaction_view(spark, SF001).filter(P.date_closed(BEGIN, END))
    cards = cards_from_list(spark, CARDS)
    view.filter(F.col("pdate") < "19970215").write.parquet(f"{tmp}/src/part=1")
    extract_stream(spark, f"{tmp}/src/*", view.schema, cards, f"{tmp}/sink", known_rows=len(CARDS)).awaitTermination()
    view.filter(F.col("pdate") >= "19970215").write.parquet(f"{tmp}/src/part=2")
    extract_stream(spark, f"{tmp}/src/*", view.schema, cards, f"{tmp}/sink", known_rows=len(CARDS)).awaitTermination()
    assert spark.read.parquet(f"{tmp}/sink").count() == 30


def _pairs(spark, *amounts):
    return spark.createDataFrame([("a", "b", x) for x in amounts], "tfr_in_acct_no string, tfr_out_acct_no string, trans_at string")


def test_fractional_amounts_are_summed_exactly(spark):
    rows = _pairs(spark, "12.34", "5", "0.0001", None, " ")
    assert summary.pair_amount(rows).first()["amount"] == Decimal("17.3401")
    text = summary.pair_amount(rows).select(summary.plain_amount("amount").alias("t"))
    assert text.first()["t"] == "17.3401"
    assert summary.pair_amount(_pairs(spark, "10", "20")).select(summary.plain_amount("amount").alias("t")).first()["t"] == "30"


def test_amounts_that_do_not_fit_are_counted(spark):
    rows = _pairs(spark, "12.34", "5", "x", "0.00001", None, " ")
    assert summary.unreadable_amounts(rows).first()["n_unreadable"] == 1  # five decimals are exact too
    assert summary.unreadable_amounts(rows, amount_type="decimal(28,4)").first()["n_unreadable"] == 2
    assert summary.unreadable_amounts(rows, amount_type="bigint").first()["n_unreadable"] == 3


@pytest.mark.parametrize("arg, want", [("a,", ["a"]), ("a,,b,", ["a", "", "b"]), ("a,b", ["a", "b"]), ("", []), (",,", [])])
def test_trailing_separators_add_no_card(spark, arg, want):
    assert [r["card"] for r in cards_from_arg(spark, arg).collect()] == want


def test_overwrite_keeps_an_existing_table(spark):
    name = "ct_kept_" + os.urandom(4).hex()
    spark.sql(f"CREATE TABLE {name} (card STRING, x STRING) USING csv OPTIONS (sep '\t')")
    sinks.save_table(spark.createDataFrame([("c", "d")], "other string, card string"), name)
    assert spark.table(name).columns == ["card", "x"] and spark.table(name).collect() == [("c", "d")]
    assert "csv" in spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Provider'").first()["data_type"].lower()
    sinks.drop_table(spark, name)


def test_delimited_files_have_no_quotes_and_refuse_separators(spark):
    tmp = tempfile.mkdtemp(prefix="ct-tabs-")
    rows = spark.createDataFrame([('a"b', None), ("", "x")], "c string, d string")
    sinks.write_delimited(rows, f"{tmp}/ok")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp}/ok").collect()) == ["\tx", 'a"b\t\\N']
    assert sorted(sinks.read_delimited(spark, f"{tmp}/ok", ["c", "d"]).collect(), key=str) == sorted([('a"b', None), ("", "x")], key=str)
    with pytest.raises(Exception, match="can't be written delimited"):
        sinks.write_delimited(spark.createDataFrame([("c\td",)], "c string"), f"{tmp}/bad")


def test_wide_lists_shuffle_the_history_once_per_leg(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = transaction_view(spark, SF001).select("tfr_in_acct_no", "tfr_out_acct_no")
        cards = rows.select(F.col("tfr_in_acct_no").alias("card")).distinct()
        wide = semi.touching(rows, cards, ["tfr_in_acct_no", "tfr_out_acct_no"])
        want = semi.touching(rows, cards, ["tfr_in_acct_no", "tfr_out_acct_no"], known_rows=cards.count()).count()
        assert wide.count() == want
        # the anti join stands above the semi join of its leg, not below it
        plan = wide._jdf.queryExecution().optimizedPlan().toString()
        anti, semi_at = plan.index("LeftAnti"), plan.rindex("LeftSemi")
        assert anti < semi_at and plan.count("LeftSemi") == 2 and plan.count("LeftAnti") == 1
        bag = semi.legs_extract(rows, cards, ["tfr_in_acct_no", "tfr_out_acct_no"])
        assert bag.count() == semi.legs_extract(rows, cards, ["tfr_in_acct_no", "tfr_out_acct_no"], method="explode").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
