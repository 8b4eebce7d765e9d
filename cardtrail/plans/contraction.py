"""What the seeds reach in the end, by contracting the graph instead of walking it.

A trace to the fixed point takes a round per hop. Here every card learns the least card of
its connected component by alternating two steps until nothing changes: in a large star
each card hands its greater neighbours to its least one, in a small star its smaller ones
(itself included). Each pair of steps is one job, and the number of jobs grows with the
logarithm of the longest chain. The cards in a component of a seed are those that the
trace reaches with ``stop="set"``; rounds and sizes don't come out of this.

Per card only a minimum is aggregated, map-side first, and joined back to the card's
edges, a join whose hot cards adaptive execution splits. Cards are numbers (``encoded``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import CARD, IN_COL, OUT_COL
from ..functions import predicates as P
from ..session import delete_path, scratch_path
from . import closure, encoded


def stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges ``(u, v)``, ``u > v``; distinct edges
    ``(u, v)`` again, ``u > v``."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
    return small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()


def components(pairs: DataFrame, path: str, max_rounds: int = 200) -> tuple[DataFrame, int]:
    """``(node, component)`` of the nodes with a neighbour other than themselves, component
    the least node reachable; and the rounds that it took. ``pairs``: (a, b), any order,
    nulls and loops ignored."""
    spark = pairs.sparkSession

    def written(edges: DataFrame, number: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        edges = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
        edges.write.mode("overwrite").parquet(f"{path}/edges{number}")
        return spark.read.schema("u long, v long").parquet(f"{path}/edges{number}"), (seen.get["n"], seen.get["mark"])

    edges, mark = written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0)
    for number in range(1, max_rounds + 1):
        further, after = written(stars(edges), number)
        delete_path(spark, f"{path}/edges{number - 1}")
        edges = further
        if after == mark:
            # every node now has one edge, to the least node of its component
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots), number
        mark = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def reach(rows: DataFrame, seeds: DataFrame, src: str, dest: str) -> tuple[DataFrame, int]:
    """``(card)``: what ``closure.trace(..., stop="set")`` ends with over ``rows``; and the
    rounds of contraction. A null end is reached with its other end and leads nowhere."""
    path = scratch_path(rows.sparkSession, "contraction")
    graph = encoded.encode(closure.adjacency(rows, src, dest, once=True), path)
    found, rounds = components(graph.pairs, path)
    # nodes whose only neighbours are themselves or null are components of their own
    nodes = graph.ids.join(found, F.col("id") == F.col("node"), "left").select(CARD, "id", F.coalesce("component", "id").alias("component"))
    seeded = nodes.join(seeds.select(F.col(CARD).cast("string").alias("__seed")), F.col(CARD) == F.col("__seed"), "left_semi").select(F.col("component").alias("__reached")).distinct()
    reached = nodes.join(seeded, F.col("component") == F.col("__reached"), "left_semi")
    blind = graph.pairs.filter("b is null").join(reached.select(F.col("id").alias("__id")), F.col("a") == F.col("__id"), "left_semi")
    return reached.select(CARD).unionAll(blind.limit(1).select(F.lit(None).cast("string").alias(CARD))), rounds


def preset_reach(history: DataFrame, seeds: DataFrame, begin: str | None, end: str | None,
                 src: str = IN_COL, dest: str = OUT_COL) -> DataFrame:
    """Closed window, blank ends dropped: the cards that the seeds reach in the end."""
    return reach(closure.edge_rows(history, src, dest, P.date_window(begin, end, True)), seeds, src, dest)[0]
