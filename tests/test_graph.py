"""Numbered cards, neighbour lists, contraction and resumed runs against the plain loop
and the plain trace."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardtrail import queries as Q
from cardtrail.functions.digest import card_digest
from cardtrail.plans import closure, contraction, encoded
from cardtrail.plans.manifest import Manifest
from cardtrail.session import scratch_path
from cardtrail.sources.cards import cards_from_list
from cardtrail.sources.testdata import transaction_view

from .conftest import SF001
from .pyloop import closure_loop

EDGES = "s string, d string"


def frame(spark, edges):
    return spark.createDataFrame(edges, EDGES)


def size_of(path):
    path = path.removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_numbers_follow_the_order_of_cards(spark):
    cards = [f"c{i * 7919 % 1000:04d}" for i in range(1000)] + ["", "é", None, "c0001"]
    ids = encoded.number_cards(spark.createDataFrame([(c,) for c in cards], "card string").repartition(7), scratch_path(spark, "test-ids"))
    got = {r["card"]: r["id"] for r in ids.collect()}
    want = sorted({c for c in cards if c is not None}, key=lambda c: c.encode())
    assert got == {c: i for i, c in enumerate(want)}


def test_lists_hold_every_neighbour_once_and_hubs_are_cut(spark):
    pairs = {(0, b) for b in range(1, 500)} | {(b, 0) for b in range(1, 500)} | {(3, None), (4, 4)}
    df = spark.createDataFrame(sorted(pairs, key=str), "a long, b long")
    path = scratch_path(spark, "test-lists")
    rows = encoded.neighbour_lists(df, path, longest=100).collect()
    assert sorted(((r["a"], b) for r in rows for b in r["b"]), key=str) == sorted(pairs, key=str)
    hub = [r["b"] for r in rows if r["a"] == 0]
    assert len(hub) == 5 and max(map(len, hub)) < 160 and all(b == sorted(b) for b in hub)
    plain = encoded.neighbour_lists(df, path + "-2").where("a = 0").collect()
    assert [r["b"] for r in plain] == [list(range(1, 500))]
    assert [r["b"] for r in rows if r["a"] == 3] == [[0, None]]


def test_lists_are_smaller_than_pairs_of_digests(spark):
    view = transaction_view(spark, SF001).where("trans_id <> 'S22'")
    rows = view.select(card_digest(F.trim("tfr_out_acct_no"), "k").alias("s"), card_digest(F.trim("tfr_in_acct_no"), "k").alias("d"))
    path = scratch_path(spark, "test-size")
    pairs = closure.adjacency(rows, "s", "d")
    pairs.write.parquet(f"{path}/strings")
    graph = encoded.encode(spark.read.parquet(f"{path}/strings"), path)
    encoded.neighbour_lists(graph.pairs, path)
    before, lists, ids = (size_of(f"{path}/{n}") for n in ("strings", "lists", "ids"))
    print(f"adjacency of {graph.n_pairs} pairs: {before} bytes as digests, {lists} as lists beside {ids} of the dictionary")
    assert lists * 4 < before and lists + ids < before


@pytest.mark.parametrize("method", ["delta", "full"])
def test_layouts_agree_with_the_loop(spark, method, layout="lists"):
    edges = [("a", "b"), ("b", "c"), ("c", None), ("d", ""), (None, "e"), ("", "b"), ("x", "y"), ("a", "a")]
    cases = [(["a", "a", "zz"], "count"), (["nobody"], "set"), ([None, "x"], "set")] if method == "delta" else [(["c"], "set"), (["e"], "count"), ([], "count")]
    for seeds, stop in cases:
        want, sizes, rounds, sets = closure_loop(edges, [s for s in seeds if s is not None] if stop == "set" else seeds, None, stop)
        res = closure.trace(frame(spark, edges), cards_from_list(spark, seeds) if seeds else spark.createDataFrame([], "card string"), "s", "d", stop=stop, method=method, layout=layout)
        if seeds and None not in seeds:
            assert {r["card"] for r in res.cards().collect()} == want and res.sizes[1:] == sizes[1:len(res.sizes)]
        plain = closure.trace(frame(spark, edges), cards_from_list(spark, seeds) if seeds else spark.createDataFrame([], "card string"), "s", "d", stop=stop, method=method)
        assert sorted(map(str, res.frontier.collect())) == sorted(map(str, plain.frontier.collect())) and res.sizes == plain.sizes
        assert sorted(map(str, res.lookup().collect())) == sorted(map(str, plain.lookup().collect()))


nodes = st.sampled_from([None, "", "a", "b", "c", "d", "e", "f", "g", "h"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(edges=st.lists(st.tuples(nodes, nodes), max_size=14), seeds=st.lists(st.sampled_from(["a", "b", "", "z"]), min_size=1, max_size=3))
def test_contraction_equals_the_loop(spark, edges, seeds):
    reached, _ = contraction.reach(frame(spark, edges), cards_from_list(spark, seeds), "s", "d")
    got = [r["card"] for r in reached.collect()]
    want, size = set(), -1
    current = set(seeds)
    while len(want) != size:
        size = len(want)
        want = {x for s, d in edges if (s is not None and s in current) or (d is not None and d in current) for x in (s, d)}
        current = want
    assert len(got) == len(set(got)) and set(got) == want


def test_contraction_of_a_long_chain(spark):
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame([(order[i], order[i + 1]) for i in range(9_999)], "a long, b long")
    path = scratch_path(spark, "test-chain")
    found, rounds = contraction.components(pairs, path)
    assert found.where("component = 0").count() == found.count() == 10_000
    assert rounds < 29  # jobs, one a round, and the first one
    straight, rounds = contraction.components(spark.range(9_999).selectExpr("id AS a", "id + 1 AS b"), path + "-2")
    assert straight.where("component = 0").count() == 10_000 and rounds < 29


def test_contraction_of_a_hub_and_loops(spark):
    pairs = spark.range(1, 3000).selectExpr("cast(0 as long) a", "id b").union(spark.sql("SELECT 5000L, 5000L")).union(spark.sql("SELECT 6000L, cast(null as long)"))
    found, rounds = contraction.components(pairs, scratch_path(spark, "test-hub"))
    assert found.count() == 3000 and found.where("component = 0").count() == 3000 and rounds <= 3


class Stopped(Exception):
    pass


@pytest.mark.parametrize("layout, fails_in", [("pairs", "seeds"), ("pairs", "adjacency"), ("pairs", "round=1"), ("pairs", "round=4"), ("lists", "round=4")])
def test_a_stopped_run_goes_on_from_its_last_round(spark, monkeypatch, layout, fails_in):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(6)] + [("c3", None)]
    plain = closure.trace(frame(spark, edges), cards_from_list(spark, ["c0"]), "s", "d")
    path = scratch_path(spark, "test-run")
    write, write_seeds = closure.write_counted, closure._write_seeds

    def stops(df, to, mode="overwrite"):
        if to.endswith(fails_in):
            df.limit(1).write.mode("overwrite").parquet(to)  # half of it
            raise Stopped
        return write(df, to, mode)

    def stops_at_seeds(seeds, to):
        raise Stopped

    monkeypatch.setattr(closure, "write_counted", stops)
    if fails_in == "seeds":
        monkeypatch.setattr(closure, "_write_seeds", stops_at_seeds)
    args = (frame(spark, edges), cards_from_list(spark, ["c0"]), "s", "d")
    with pytest.raises(Stopped):
        closure.trace(*args, layout=layout, run_path=path)
    written = []

    def notes(df, to, mode="overwrite"):
        written.append(to.rsplit("/", 1)[1])
        return write(df, to, mode)

    monkeypatch.setattr(closure, "write_counted", notes)
    monkeypatch.setattr(closure, "_write_seeds", write_seeds)
    if fails_in.startswith("round"):  # the history isn't read again
        monkeypatch.setattr(closure, "adjacency", None)
    again = closure.trace(*args, layout=layout, run_path=path)
    assert again.sizes == plain.sizes and sorted(map(str, again.frontier.collect())) == sorted(map(str, plain.frontier.collect()))
    if fails_in == "round=4":
        assert written == [f"round={r}" for r in range(4, plain.rounds + 1)]
    del written[:]
    monkeypatch.setattr(closure, "adjacency", None)
    same = closure.trace(*args, layout=layout, run_path=path)
    assert same.sizes == plain.sizes and not written and same.frontier.count() == plain.frontier.count()
    with pytest.raises(ValueError, match="other settings"):
        closure.trace(*args, layout=layout, run_path=path, stop="set")


def test_more_rounds_take_a_run_further(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    path = scratch_path(spark, "test-further")
    args = (frame(spark, edges), cards_from_list(spark, ["c0"]), "s", "d")
    assert closure.trace(*args, max_rounds=2, run_path=path).sizes == [1, 2, 3]
    assert closure.trace(*args, max_rounds=4, run_path=path).sizes == [1, 2, 3, 4, 5]
    less = closure.trace(*args, max_rounds=1, run_path=path)
    assert less.sizes == [1, 2] and less.frontier.count() == 2


def test_a_failed_run_without_a_path_leaves_nothing(spark, monkeypatch):
    made = []
    monkeypatch.setattr(closure, "scratch_path", lambda s, n: made.append(scratch_path(s, n)) or made[-1])
    monkeypatch.setattr(closure, "new_cards", lambda *a, **k: (_ for _ in ()).throw(Stopped()))
    with pytest.raises(Stopped):
        closure.trace(frame(spark, [("a", "b"), ("b", "c")]), cards_from_list(spark, ["a"]), "s", "d")
    assert made and not os.path.exists(made[0].removeprefix("file:"))


def test_manifest(spark):
    m = Manifest(spark, scratch_path(spark, "test-manifest"))
    assert m.steps() == {}
    m.done("a", n=1)
    m.done("a", n=9007199254740993, text="é")
    m.done("b")
    assert m.steps() == {"a": {"n": 9007199254740993, "text": "é"}, "b": {}}
    m.forget()
    assert m.steps() == {}


def test_whole_history_by_contraction(spark):
    got = {r["card"] for r in Q.history_by_contraction(spark, SF001).collect()}
    assert got == {r["card"] for r in Q.trace_history_fixpoint(spark, SF001).collect()}


def test_numbered_graphs_read_the_history_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    edges = [("b", "a"), ("a", "b"), ("c", "c"), ("c", None), (None, "d"), (None, None), ("b", "c")]
    rows = frame(spark, edges).mapInPandas(seen, EDGES)
    graph = encoded.encode(closure.adjacency(rows, "s", "d"), scratch_path(spark, "test-once"))
    ids = {r["id"]: r["card"] for r in graph.ids.collect()}
    got = sorted(((ids[r["a"]], ids.get(r["b"])) for r in graph.pairs.collect()), key=str)
    assert got == sorted([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "c"), ("c", None), ("d", None)], key=str)
    assert graph.n_pairs == 7 and read.value == len(edges)
