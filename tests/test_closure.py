"""The closure on literal fixtures (FIXTURES.md section 4) and on random
graphs against a plain Python loop."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardtrail.plans import closure
from cardtrail.sources.cards import cards_from_list

from .pyloop import closure_loop

SCHEMA = "s string, d string"


def _run(spark, edges, seeds, **kw):
    rows = spark.createDataFrame(edges, SCHEMA)
    res = closure.trace(rows, cards_from_list(spark, seeds), "s", "d", **kw)
    got = {r["card"] for r in res.cards().collect()}
    return res, got


@pytest.mark.parametrize("method", ["delta", "full"])
def test_l1_early_stop_by_count(spark, method):
    edges = [("a", "b"), ("b", "c")]
    res, got = _run(spark, edges, ["a", "z"], method=method)
    assert got == {"a", "b"} and res.sizes == [2, 2] and res.rounds == 1
    res, got = _run(spark, edges, ["a", "z"], stop="set", method=method)
    assert got == {"a", "b", "c"}


@pytest.mark.parametrize("method", ["delta", "full"])
def test_l2_lost_seed(spark, method):
    res, got = _run(spark, [("a", "b")], ["a", "z", "y"], method=method)
    assert got == {"a", "b"} and res.sizes == [3, 2, 2]


def test_l3_duplicate_seeds_count(spark):
    res, got = _run(spark, [("a", "b")], ["a", "a"])
    assert res.sizes == [2, 2] and res.rounds == 1 and got == {"a", "b"}


def test_l4_blank_end_spreads(spark):
    res, _ = _run(spark, [("a", ""), ("b", "")], ["a"])
    assert {r["card"] for r in res.cards(1).collect()} == {"a", ""}
    assert {r["card"] for r in res.cards(2).collect()} == {"a", "b", ""}
    assert res.sizes == [1, 2, 3, 3]


def test_l5_null_end_counts_once_matches_nothing(spark):
    res, got = _run(spark, [("a", None)], ["a"])
    assert got == {"a", None} and res.sizes == [1, 2, 2]


def test_l6_self_loop(spark):
    res, got = _run(spark, [("a", "a")], ["a"])
    assert got == {"a"} and res.sizes == [1, 1] and res.rounds == 1


def test_l7_cycle_terminates(spark):
    res, got = _run(spark, [("a", "b"), ("b", "c"), ("c", "a")], ["a"])
    assert got == {"a", "b", "c"}


def test_l8_no_match(spark):
    res, got = _run(spark, [("a", "b")], ["z"])
    assert got == set() and res.sizes == [1, 0, 0]


def test_empty_seed_list(spark):
    res, got = _run(spark, [("a", "b")], [])
    assert res.rounds == 0 and got == set() and res.sizes == [0]
    rows = spark.createDataFrame([("a", "b")], SCHEMA)
    assert closure.touching_rows(rows, res, ["s", "d"]).count() == 0
    assert closure.rows_per_round(rows, res, ["s", "d"]).count() == 0


def test_zero_rounds(spark):
    res, got = _run(spark, [("a", "b")], ["a", "z"], max_rounds=0)
    assert res.rounds == 0 and res.sizes == [2] and got == {"a", "z"}


def test_max_rounds(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    res, got = _run(spark, edges, ["a"], max_rounds=2)
    assert got == {"a", "b", "c"} and res.rounds == 2


def test_row_outputs_lag_the_frontier(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d")]
    rows = spark.createDataFrame(edges, SCHEMA)
    res = closure.trace(rows, cards_from_list(spark, ["a"]), "s", "d", max_rounds=2)
    # Round 2 is driven by S1 = {a, b}: rows a-b and b-c.
    touched = {(r["s"], r["d"]) for r in closure.touching_rows(rows, res, ["s", "d"]).collect()}
    assert touched == {("a", "b"), ("b", "c")}
    per = sorted((r["round"], r["s"], r["d"])
                 for r in closure.rows_per_round(rows, res, ["s", "d"]).collect())
    assert per == [(1, "a", "b"), (2, "a", "b"), (2, "b", "c")]


def test_duplicate_rows_stay_duplicates(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("x", "y")], SCHEMA)
    res = closure.trace(rows, cards_from_list(spark, ["a"]), "s", "d", max_rounds=1)
    assert closure.touching_rows(rows, res, ["s", "d"]).count() == 2
    assert closure.rows_per_round(rows, res, ["s", "d"]).count() == 2


NAMES = st.sampled_from(["a", "b", "c", "d", "e", "f", "g", "", None])
EDGES = st.lists(st.tuples(NAMES, NAMES), min_size=0, max_size=12)
SEEDS = st.lists(st.sampled_from(["a", "b", "c", "z"]), min_size=0, max_size=3)


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=EDGES, seeds=SEEDS, method=st.sampled_from(["delta", "full"]),
       stop=st.sampled_from(["count", "set"]), max_rounds=st.sampled_from([None, 1, 3]))
def test_matches_python_loop(spark, edges, seeds, method, stop, max_rounds):
    want, sizes, rounds, sets_ = closure_loop(edges, seeds, max_rounds, stop)
    res, got = _run(spark, edges, seeds, method=method, stop=stop, max_rounds=max_rounds)
    assert res.rounds == rounds
    assert res.sizes == sizes
    assert got == want
    # Every intermediate set, and the per-round touching rows.
    for r in range(1, rounds + 1):
        assert {x["card"] for x in res.cards(r).collect()} == sets_[r]
    rows = spark.createDataFrame(edges, SCHEMA)
    per = sorted(((x["round"], x["s"] or "~", x["d"] or "~")
                  for x in closure.rows_per_round(rows, res, ["s", "d"]).collect()))
    expect = []
    for r in range(1, rounds + 1):
        drive = sets_[r - 1]
        for s, d in edges:
            if (s is not None and s in drive) or (d is not None and d in drive):
                expect.append((r, s or "~", d or "~"))
    assert per == sorted(expect)


def test_swapping_src_dest_keeps_sets(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "e"), ("e", "a")]
    rows = spark.createDataFrame(edges, SCHEMA)
    seeds = cards_from_list(spark, ["c"])
    one = closure.trace(rows, seeds, "s", "d")
    two = closure.trace(rows, seeds, "d", "s")
    assert one.sizes == two.sizes
    assert {r["card"] for r in one.cards().collect()} == {r["card"] for r in two.cards().collect()}


def test_frontier_first_rounds(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d")]
    res, _ = _run(spark, edges, ["a"])
    fr = {r["card"]: r["round"] for r in res.frontier.collect()}
    assert fr == {"a": 1, "b": 1, "c": 2, "d": 3}
    assert [tuple(r) for r in res.sizes_df().orderBy("round").collect()] == \
        [(0, 1), (1, 2), (2, 3), (3, 4), (4, 4)]
    assert res.frontier.filter(F.col("card").isNull()).count() == 0


def test_large_known_set_plan_agrees(spark):
    """Forcing every size over the broadcast bound takes the shuffle plans."""
    edges = [("a", "b"), ("b", None), ("c", ""), ("", "d"), ("b", "c"), ("e", "f")]
    small, got_small = _run(spark, edges, ["a"])
    spark.conf.set("cardtrail.broadcast.maxRows", "0")
    try:
        big, got_big = _run(spark, edges, ["a"])
        rows = spark.createDataFrame(edges, SCHEMA)
        per_big = sorted(map(str, closure.rows_per_round(rows, big, ["s", "d"]).collect()))
        touch_big = closure.touching_rows(rows, big, ["s", "d"]).count()
    finally:
        spark.conf.unset("cardtrail.broadcast.maxRows")
    per_small = sorted(map(str, closure.rows_per_round(rows, small, ["s", "d"]).collect()))
    assert got_small == got_big == {"a", "b", "c", "d", "", None}
    assert small.sizes == big.sizes
    assert per_small == per_big
    assert touch_big == closure.touching_rows(rows, small, ["s", "d"]).count()


def test_an_edge_is_shuffled_once(spark):
    edges = [("b", "a"), ("a", "b"), ("c", "c"), ("c", None), (None, "d"), (None, None), ("", "a")]
    adj = closure.adjacency(spark.createDataFrame(edges, SCHEMA), "s", "d", once=True)
    got = sorted(((r["a"], r["b"]) for r in adj.collect()), key=str)
    assert got == sorted([("a", "b"), ("b", "a"), ("c", "c"), ("c", None), ("d", None), ("", "a"), ("a", "")], key=str)
    plan = adj._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # turned round above the aggregation


def test_a_round_shuffles_far_ends_alone(spark):
    adj = closure.adjacency(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], SCHEMA), "s", "d")
    probe = cards_from_list(spark, ["a", "b"])
    known = cards_from_list(spark, ["a", "b", "x"])
    for known_rows in (3, 10**9):
        fresh = closure.new_cards(adj, probe, 2, known, known_rows)
        assert [r["card"] for r in fresh.collect()] == ["c"]
        assert fresh._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1  # that of the adjacency
