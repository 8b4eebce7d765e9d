"""The bucketed adjacency layout (for large histories): same results, and a
round's probe prunes the adjacency's partitions dynamically."""

import tempfile

from pyspark.sql import functions as F

from cardtrail.plans import closure
from cardtrail.queries import BEGIN, CARDS, END
from cardtrail.sources.cards import cards_from_list
from cardtrail.sources.testdata import transaction_view

from .conftest import SF001
from .pyloop import closure_loop

FORCE = {"cardtrail.trace.bucketRows": "0", "cardtrail.trace.buckets": "8"}


def _forced(spark, fn):
    for k, v in FORCE.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k in FORCE:
            spark.conf.unset(k)


def test_bucketed_trace_matches_fixture(spark):
    view = transaction_view(spark, SF001, BEGIN, END)
    cards = cards_from_list(spark, CARDS)
    r = _forced(spark, lambda: closure.preset_edges(view, cards, BEGIN, END))
    assert r.result.sizes == [10, 25, 55, 119, 200]
    assert r.edges.count() == 203


def test_bucketed_trace_matches_loop(spark):
    edges = [("a", "b"), ("b", None), ("c", ""), ("", "d"), ("b", "c"), ("e", "f"), ("f", "g")]
    want, sizes, rounds, _ = closure_loop(edges, ["a", "f", "z"])
    rows = spark.createDataFrame(edges, "s string, d string")
    for method in ("delta", "full"):
        res = _forced(spark, lambda: closure.trace(rows, cards_from_list(spark, ["a", "f", "z"]),
                                                   "s", "d", method=method))
        assert res.sizes == sizes and res.rounds == rounds
        assert {x["card"] for x in res.cards().collect()} == want


def test_probe_prunes_bucket_partitions(spark):
    tmp = tempfile.mkdtemp(prefix="ct-buckets-")
    adj = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(200)], "a string, b string")
    adj.withColumn("bucket", closure.bucket_of("a", 8)).write.partitionBy("bucket") \
        .parquet(f"{tmp}/adj")
    spark.createDataFrame([("c1", 1), ("c7", 2)], "card string, round int").write \
        .partitionBy("round").parquet(f"{tmp}/frontier")
    probe = spark.read.parquet(f"{tmp}/frontier").filter(F.col("round") == 2).select("card")
    out = closure.expand(spark.read.parquet(f"{tmp}/adj"), probe, 1, buckets=8)
    assert sorted(r["card"] for r in out.collect()) == ["c7", "c8"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    # a pruning subquery, not the literal true that stands where pruning is off
    assert "dynamicpruningexpression" in plan and "dynamicpruningexpression(true)" not in plan


def test_wide_rounds_do_not_shuffle_the_adjacency(spark, monkeypatch):
    monkeypatch.setattr(closure, "_BUCKET_ROWS", 50)
    tmp = tempfile.mkdtemp(prefix="ct-wide-")
    rows = [(f"c{i}", f"c{i + 1}") for i in range(300)] + [("hub", f"x{i}") for i in range(150)]
    adj = closure.adjacency(spark.createDataFrame(rows, "s string, d string"), "s", "d")
    wide = closure.WideAdjacency(adj, f"{tmp}/wide", 8)
    probe = spark.createDataFrame([(f"c{i}",) for i in range(0, 300, 7)] + [("hub",), ("x3",)], "card string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = wide.endpoints(probe)
        want = closure.endpoints(adj, probe, None)
        assert sorted(r["card"] for r in got.collect()) == sorted(r["card"] for r in want.collect())
        assert [r["__hub"] for r in wide.hubs.collect()] == ["hub"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        assert "Bucketed: true" in final and "hashpartitioning(a" not in final and "hashpartitioning(b" not in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    wide.drop()
    assert not spark.catalog.tableExists(wide.name)


def test_trace_beyond_the_broadcast_bound_matches_fixture(spark):
    spark.conf.set("cardtrail.broadcast.maxRows", "0")
    try:
        r = closure.preset_edges(transaction_view(spark, SF001, BEGIN, END), cards_from_list(spark, CARDS), BEGIN, END)
        assert r.result.sizes == [10, 25, 55, 119, 200]
    finally:
        spark.conf.unset("cardtrail.broadcast.maxRows")
