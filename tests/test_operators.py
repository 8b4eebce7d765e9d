"""Predicates, semi joins, bags, sets, summaries and the digest on literal rows."""

import hashlib
import hmac

from pyspark.sql import functions as F

from cardtrail.functions import predicates as P
from cardtrail.functions.digest import card_digest, card_message, hmac_md5
from cardtrail.functions.text import row_text
from cardtrail.operators import semi, sets, summary
from cardtrail.plans import two_round
from cardtrail.sources.cards import cards_from_arg, cards_from_list

COLS = "pri_acct_no_conv string, tfr_in_acct_no string, tfr_out_acct_no string, trans_id string, trans_at string, pdate string"


def test_l9_trim_spaces_only(spark):
    df = spark.createDataFrame([("a ",), ("a",), ("\ta",)], "c string")
    edges = summary.edge_list(df.withColumn("d", F.lit("x")), "c", "d")
    assert sorted(r["c"] for r in edges.collect()) == ["\ta", "a"]


def test_l10_bag_counts_each_leg(spark):
    rows = spark.createDataFrame([("k", "k", "k", "S33", "100", "20170301")], COLS)
    cards = cards_from_list(spark, ["k"])
    for method in ("explode", "union"):
        t = two_round.run(rows, cards, 1, method=method)
        assert t.extract.count() == 3
        (pair,) = t.round0_pairs.collect()
        assert pair["amount"] == 300


def test_l11_null_kind_is_not_consumption(spark):
    rows = spark.createDataFrame([("k", None, None, None, "1", "20170301"),
                                  ("k", None, None, "S22", "1", "20170301"),
                                  ("k", None, None, "S25", "1", "20170301")], COLS)
    assert semi.consumption_of(rows, cards_from_list(spark, ["k"]), known_rows=1).count() == 1


def test_duplicate_cards_do_not_multiply(spark):
    rows = spark.createDataFrame([("k", "x", "y", "S33", "1", "20170301")], COLS)
    assert semi.semi_join(rows, cards_from_list(spark, ["k", "k"]), "pri_acct_no_conv").count() == 1


def test_touching_each_row_once_and_nulls(spark):
    rows = spark.createDataFrame([("p", "k", "k", "S33", "1", "1"),
                                  ("p", None, "k", "S33", "1", "1"),
                                  ("p", None, None, "S33", "1", "1")], COLS)
    t = semi.touching(rows, cards_from_list(spark, ["k"]), ["tfr_in_acct_no", "tfr_out_acct_no"])
    assert t.count() == 2


def test_dates_compare_as_strings(spark):
    df = spark.createDataFrame([("20160930",), ("20160931",), ("20161001",), ("x",)], "pdate string")
    assert df.filter(P.date_closed("20160701", "20160931")).count() == 2
    assert df.filter(P.date_half_open(20160701, 20160931)).count() == 1
    assert df.filter(P.date_ranges([("20160930", "20160930"), ("20161001", "20161001")])).count() == 2


def test_nonblank_drops_null_and_spaces(spark):
    df = spark.createDataFrame([("a", "b"), (" ", "b"), (None, "b"), ("a", "")], "s string, d string")
    assert df.filter(P.nonblank("s", "d")).count() == 1
    assert df.filter(P.not_null_nor_empty("s", "d")).count() == 2


def test_endpoint_bag_and_set(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), (None, None)], "s string, d string")
    assert sets.endpoint_bag(df, ["s", "d"]).count() == 6
    assert {r["card"] for r in sets.endpoint_set(df, ["s", "d"]).collect()} == {"a", "b", None}
    assert summary.distinct_count(sets.endpoint_bag(df, ["s", "d"])).first()["n_cards"] == 2


def test_pair_amount_skips_malformed(spark):
    rows = spark.createDataFrame([("p", "i", "o", "S33", "5", "1"), ("p", "i", "o", "S33", "x", "1")], COLS)
    assert summary.pair_amount(rows).first()["amount"] == 5


def test_l12_l13_digest(spark):
    df = spark.createDataFrame([("6222021234567890",), ("",)], "card string")
    got = df.select(card_message("card").alias("m"), card_digest("card", "demo-key").alias("h")).collect()
    assert got[0]["m"] == "098765432120222661"
    assert got[0]["h"] == "25eb098adee3cea314e45c2f8ef0181d"
    assert got[1]["m"] == "0" and got[1]["h"] == "3d03acb78f19c9376fc6d9ccf1b23619"


def test_digest_long_key_matches_hmac(spark):
    key = "k" * 100
    df = spark.createDataFrame([("héllo",)], "m string")
    got = df.select(hmac_md5("m", key).alias("h")).first()["h"]
    assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.md5).hexdigest()


def test_row_text(spark):
    df = spark.createDataFrame([("a", None, "1")], "x string, y string, z string")
    assert df.select(row_text(df).alias("t")).first()["t"] == "[a,null,1]"


def test_cards_from_arg(spark):
    assert [r["card"] for r in cards_from_arg(spark, "a,b,a").collect()] == ["a", "b", "a"]
    assert cards_from_arg(spark, "").count() == 0


def test_touching_both_plans_agree(spark):
    rows = spark.createDataFrame([("p", "k", "k", "S33", "1", "1"),
                                  ("p", "k", "k", "S33", "1", "1"),
                                  ("p", None, "k", "S33", "1", "1"),
                                  ("p", "j", None, "S33", "1", "1"),
                                  ("p", "x", "y", "S33", "1", "1"),
                                  ("p", None, None, "S33", "1", "1")], COLS)
    cards = cards_from_list(spark, ["k", "j", "k"])
    cols = ["tfr_in_acct_no", "tfr_out_acct_no"]
    small = sorted(map(tuple, semi.touching(rows, cards, cols, known_rows=3).collect()), key=str)
    big = sorted(map(tuple, semi.touching(rows, cards, cols, known_rows=None).collect()), key=str)
    assert small == big and len(small) == 4
