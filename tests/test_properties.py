"""Properties of the extract and the two rounds on random rows, against plain
Python; the CLI and card-list appends."""

import tempfile
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cardtrail import __main__ as cli
from cardtrail.operators import semi
from cardtrail.plans import two_round
from cardtrail.sources.cards import append_cards, cards_from_list

COLS = ("pri_acct_no_conv string, tfr_in_acct_no string, tfr_out_acct_no string, "
        "trans_id string, trans_at string, pdate string")
ACCT = st.sampled_from(["a", "b", "c", "d", "", None])
ROW = st.tuples(ACCT, ACCT, ACCT, st.sampled_from(["S33", "S25", "S22", None]),
                st.sampled_from(["1", "20", "300", "x", None]), st.just("20170301"))


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(ROW, max_size=12), cards=st.lists(st.sampled_from(["a", "b", "z"]), max_size=3))
def test_bag_extract_and_pair_sums(spark, rows, cards):
    df = spark.createDataFrame(rows, COLS)
    card_df = cards_from_list(spark, cards)
    listed = set(cards)
    ext = two_round.round0_extract(df, card_df, len(cards))
    legs = [semi.semi_join(df, card_df, c, len(cards)).count()
            for c in ("tfr_in_acct_no", "tfr_out_acct_no", "pri_acct_no_conv")]
    assert ext.count() == sum(legs)
    # The same bag from Python: one copy per listed leg.
    bag = [r for r in rows for v in (r[1], r[2], r[0]) if v is not None and v in listed]
    assert Counter(map(tuple, ext.collect())) == Counter(bag)
    sums = {}
    for r in bag:
        if r[3] == "S33":
            key = (r[1], r[2])
            add = int(r[4]) if r[4] is not None and r[4].isdigit() else None
            if add is not None:
                sums[key] = (sums.get(key) or 0) + add
            else:
                sums.setdefault(key, None)
    got = {(x["tfr_in_acct_no"], x["tfr_out_acct_no"]): x["amount"]
           for x in two_round.run(df, card_df, len(cards)).round0_pairs.collect()}
    assert got == sums


def test_seed_order_and_row_order_do_not_matter(spark):
    from cardtrail.plans import closure
    edges = [("a", "b"), ("b", "c"), ("d", "e"), ("c", "d")]
    one = closure.trace(spark.createDataFrame(edges, "s string, d string"),
                        cards_from_list(spark, ["a", "e"]), "s", "d")
    two = closure.trace(spark.createDataFrame(edges[::-1], "s string, d string"),
                        cards_from_list(spark, ["e", "a"]), "s", "d")
    assert one.sizes == two.sizes
    assert sorted(r["card"] for r in one.cards().collect()) == \
        sorted(r["card"] for r in two.cards().collect())


def test_append_cards(spark):
    path = tempfile.mkdtemp(prefix="ct-cards-") + "/list"
    append_cards(cards_from_list(spark, ["a", "b"]), path)
    append_cards(cards_from_list(spark, ["b"]), path)
    assert sorted(r["card"] for r in spark.read.parquet(path).collect()) == ["a", "b", "b"]


def test_cli_trace(spark, capsys):
    tmp = tempfile.mkdtemp(prefix="ct-cli-")
    rows = [("a", "b", "1", "10000", "00", "20160701"), ("b", "c", "1", "10000", "00", "20160702"),
            ("c", "d", "0", "10000", "00", "20160702")]
    spark.createDataFrame(rows, "tfr_out_acct_no string, tfr_in_acct_no string, sti_takeout_in string, "
                                "cu_trans_st string, resp_cd1 string, pdate string").write.parquet(f"{tmp}/h")
    spark.read.parquet(f"{tmp}/h").createOrReplaceTempView("cli_history")
    assert cli.main(["trace", "20160701", "20160931", "cli_history", "tfr_out_acct_no",
                     "tfr_in_acct_no", "a"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[:4] == ["round 0\t1", "round 1\t2", "round 2\t3", "round 3\t3"]


def test_cli_edges(spark, capsys):
    tmp = tempfile.mkdtemp(prefix="ct-cli2-")
    rows = [("a", "b", "20160701"), ("b", "c", "20160702"), ("c", "d", "20160703")]
    spark.createDataFrame(rows, "tfr_in_acct_no string, tfr_out_acct_no string, pdate string") \
        .write.parquet(f"{tmp}/h")
    with open(f"{tmp}/seeds.txt", "w") as f:
        f.write("a\n")
    assert cli.main(["edges", f"{tmp}/h", f"{tmp}/seeds.txt", "20160701", "20160731",
                     f"{tmp}/out"]) == 0
    out = capsys.readouterr().out.split("\n")
    assert out[:5] == ["round 0\t1", "round 1\t2", "round 2\t3", "round 3\t4", "round 4\t4"]
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp}/out").collect())
    assert lines == ["[a,b]", "[b,c]", "[c,d]"]
