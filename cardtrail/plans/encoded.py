"""The transfer graph with cards as dense numbers and neighbours as sorted lists.

Cards of the history are 32-character digests; a graph over them shuffles and stores
mostly those. Here every card becomes its place in the sorted order of all cards, from a
range sort: each task numbers its own cards, and the number of cards in the partitions
before it (one number per partition) is added. The adjacency then holds one row per card
with the sorted array of its neighbours' numbers; Parquet stores the arrays as differences
(DELTA_BINARY_PACKED, its encoding of longs in data pages of version 2).

A hub's neighbours are cut into lists of about ``LIST`` by a hash, so no list and no group
grows with the graph. A null end stays null: last in its neighbours' lists, without a
number, and never a row of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CARD
from ..session import broadcast_row_limit, delete_path
from ..sinks import write_counted

#: Longest list of neighbours, about.
LIST = 65_536
ID = "id"
#: Parquet options under which long columns are stored as differences.
DELTA = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
_ROWS = 33  # bits of a row's number within its partition, in monotonically_increasing_id


def number_cards(cards: DataFrame, path: str) -> DataFrame:
    """``(card, id)`` of the distinct non-null cards, ids 0, 1, ... in the cards' order,
    written below ``path``."""
    spark = cards.sparkSession
    ordered = cards.filter(F.col(CARD).isNotNull()).select(CARD).distinct().repartitionByRange(CARD).sortWithinPartitions(CARD)
    ordered.select(CARD, F.monotonically_increasing_id().alias("place")).write.mode("overwrite").parquet(f"{path}/places")
    placed = spark.read.schema(f"{CARD} string, place long").parquet(f"{path}/places")
    part = F.shiftright("place", _ROWS)
    start, starts = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per partition
        starts.append((r["part"], start))
        start += r["count"]
    offsets = spark.createDataFrame(starts, "part long, start long")
    numbered = placed.join(F.broadcast(offsets), part == F.col("part")).select(CARD, (F.col("start") + F.col("place").bitwiseAND(F.lit((1 << _ROWS) - 1))).alias(ID))
    numbered.write.mode("overwrite").options(**DELTA).parquet(f"{path}/ids")
    return spark.read.schema(f"{CARD} string, {ID} long").parquet(f"{path}/ids")


def with_ids(df: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the cards of ``columns`` replaced by their numbers (null: null)."""
    for c in columns:
        of = ids.select(F.col(CARD).alias("__card"), F.col(ID).alias("__id"))
        df = df.join(of, F.col(c) == F.col("__card"), "left").withColumn(c, F.col("__id")).drop("__card", "__id")
    return df


def with_cards(df: DataFrame, ids: DataFrame, column: str = CARD) -> DataFrame:
    """``df`` with the numbers of ``column`` replaced by their cards (null: null)."""
    of = ids.select(F.col(CARD).alias("__card"), F.col(ID).alias("__id"))
    return df.join(of, F.col(column) == F.col("__id"), "left").withColumn(column, F.col("__card")).drop("__card", "__id")


def neighbour_lists(pairs: DataFrame, path: str, longest: int = LIST) -> DataFrame:
    """``(a, b)`` with ``b`` the sorted array of neighbours of ``a``, from distinct pairs of
    numbers; several rows for a card of more than ``longest`` neighbours."""
    spark = pairs.sparkSession
    hubs = pairs.groupBy(F.col("a").alias("__hub")).count().filter(F.col("count") > longest).withColumn("__lists", F.ceil(F.col("count") / longest).cast("int"))
    n_hubs = write_counted(hubs.select("__hub", "__lists"), f"{path}/hubs")
    if n_hubs:
        hubs = spark.read.schema("__hub long, __lists int").parquet(f"{path}/hubs")
        if n_hubs <= broadcast_row_limit(spark):
            hubs = F.broadcast(hubs)
        pairs = pairs.join(hubs, F.col("a") == F.col("__hub"), "left")
        number = F.coalesce(F.pmod(F.xxhash64("b"), F.col("__lists")), F.lit(0))
    else:
        number = F.lit(0)
    lists = pairs.withColumn("__list", number.cast("int")).groupBy("a", "__list").agg(
        F.sort_array(F.collect_list("b")).alias("b"), F.max(F.col("b").isNull()).alias("__null"))
    null = F.array(F.lit(None).cast("long"))
    lists = lists.select("a", F.when(F.col("__null"), F.concat("b", null)).otherwise(F.col("b")).alias("b"))
    lists.sortWithinPartitions("a").write.mode("overwrite").options(**DELTA).parquet(f"{path}/lists")
    return spark.read.schema("a long, b array<long>").parquet(f"{path}/lists")


@dataclass
class Graph:
    """``ids`` (card, id), ``pairs`` (a, b: numbers, both directions, distinct, a not null)."""

    spark: SparkSession
    path: str
    ids: DataFrame
    pairs: DataFrame
    n_pairs: int


def encode(pairs: DataFrame, path: str, more: DataFrame | None = None) -> Graph:
    """The graph of ``pairs`` (a, b) of cards, both directions of each; ``more``
    (card) adds cards without a pair to the numbers."""
    spark = pairs.sparkSession
    # Written once, one way round: the history behind the pairs is read a single time.
    pairs.filter("b is null or a <= b").write.mode("overwrite").parquet(f"{path}/named")
    named = spark.read.schema("a string, b string").parquet(f"{path}/named")
    cards = named.select(F.explode(F.array("a", "b")).alias(CARD))
    if more is not None:
        cards = cards.unionAll(more.select(F.col(CARD).cast("string")))
    ids = number_cards(cards, path)
    there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = F.when(F.col("a") < F.col("b"), F.array(there, back)).otherwise(F.array(there))
    numbered = with_ids(named, ids, ["a", "b"]).select(F.inline(both))
    n_pairs = write_counted(numbered, f"{path}/pairs")
    delete_path(spark, f"{path}/named")
    return Graph(spark, path, ids, spark.read.schema("a long, b long").parquet(f"{path}/pairs"), n_pairs)
