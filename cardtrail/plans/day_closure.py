"""The closure kept up to date as days of transfers arrive.

A card's first round is its distance from the seeds, so new transfers can only lower it.
A day's update looks at its new pairs first: where one leads from a reached card to a card
that has no round yet or a later one, that card improves. The neighbours of improved cards
are then looked at in all pairs kept, and so on until nothing improves: work goes with
what changes, not with the history. After each day the rounds are those of a trace over
all rows so far (``stop="set"``, no bound on rounds).

Pairs are kept per day, rounds as one table per finished update; a manifest says which
updates are complete. A day given twice changes nothing; one that was interrupted is
done again from its start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CARD
from ..session import broadcast_row_limit, delete_path
from ..sinks import write_counted
from .closure import adjacency
from .manifest import Manifest

_PAIR = "a string, b string"
_DISTANCE = f"{CARD} string, d int"


class DayClosure:
    """``path`` is the folder of the state. ``seeds`` (card) start it; an existing state
    has its own."""

    def __init__(self, spark: SparkSession, path: str, seeds: DataFrame | None = None):
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, f"{path}/manifest")
        if "seeds" not in self.manifest.steps():
            if seeds is None:
                raise ValueError(f"{path} has no state yet: seeds are needed")
            distinct = seeds.filter(F.col(CARD).isNotNull()).select(F.col(CARD).cast("string").alias(CARD), F.lit(0).alias("d")).distinct()
            n = write_counted(distinct, f"{path}/rounds/0")
            self.manifest.done("seeds", cards=n)

    def _updates(self) -> dict[str, dict]:
        return {step.removeprefix("day-"): facts for step, facts in self.manifest.steps().items() if step.startswith("day-")}

    def _distances(self, version: int) -> DataFrame:
        return self.spark.read.schema(_DISTANCE).parquet(f"{self.path}/rounds/{version}")

    def _pairs(self, days) -> DataFrame:
        folders = [f"{self.path}/pairs/{day}" for day in days]
        return self.spark.read.schema(_PAIR).parquet(*folders) if folders else self.spark.createDataFrame([], _PAIR)

    def add(self, day: str, rows: DataFrame, src: str, dest: str) -> dict:
        """Take in the rows (filtered and trimmed) of a day; the numbers of its new pairs,
        of cards improved and of waves."""
        done = self._updates()
        if day in done:
            return done[day]
        version = max((f["version"] for f in done.values()), default=0)
        same = F.col("a").eqNullSafe(F.col("__a")) & F.col("b").eqNullSafe(F.col("__b"))
        kept = self._pairs(done).select(F.col("a").alias("__a"), F.col("b").alias("__b"))
        n_pairs = write_counted(adjacency(rows, src, dest, once=True).join(kept, same, "left_anti"), f"{self.path}/pairs/{day}")
        known = self._distances(version)
        pairs, probe = self._pairs([day]), known
        waves, improved, wave_path = 0, 0, f"{self.path}/waves"
        n_probe, had = None, known
        while True:
            found = self._improved(pairs, probe, n_probe, had)
            n_probe = write_counted(found, f"{wave_path}/{waves}")
            if not n_probe:
                break
            probe = self.spark.read.schema(_DISTANCE).parquet(f"{wave_path}/{waves}")
            waves += 1
            improved += n_probe
            # one scan of this update's waves, however many
            had = known.unionAll(self.spark.read.schema(_DISTANCE).parquet(*(f"{wave_path}/{w}" for w in range(waves))))
            pairs = self._pairs([*done, day])  # after the new pairs themselves
        new = version
        if waves:
            new = version + 1
            had.groupBy(CARD).agg(F.min("d").alias("d")).write.mode("overwrite").parquet(f"{self.path}/rounds/{new}")
        facts = {"version": new, "pairs": n_pairs, "improved": improved, "waves": waves}
        self.manifest.done(f"day-{day}", **facts)
        if waves and version:
            delete_path(self.spark, f"{self.path}/rounds/{version}")
        delete_path(self.spark, wave_path)
        return facts

    def _improved(self, pairs, probe, n_probe, had) -> DataFrame:
        """(card, d) of the neighbours of ``probe`` that ``had`` no distance or a greater one."""
        keys = probe.select(F.col(CARD).alias("__from"), "d")
        if n_probe is not None and n_probe <= broadcast_row_limit(self.spark):
            keys = F.broadcast(keys)
        near = pairs.join(keys, F.col("a") == F.col("__from")).select(F.col("b").alias(CARD), (F.col("d") + 1).alias("d"), F.lit(1).alias("__new"))
        tagged = near.unionAll(had.withColumn("__new", F.lit(0)))
        # one aggregation; a null end is a card that leads nowhere
        best = tagged.groupBy(CARD).agg(F.min(F.when(F.col("__new") == 1, F.col("d"))).alias("d"), F.min(F.when(F.col("__new") == 0, F.col("d"))).alias("__had"))
        return best.filter("d is not null and (__had is null or d < __had)").select(CARD, "d")

    def frontier(self) -> DataFrame:
        """``(card, round)`` of the cards reached: a trace's ``frontier``."""
        done = self._updates()
        distances = self._distances(max((f["version"] for f in done.values()), default=0))
        # a seed is reached in round 1 if it has a transfer at all
        own = self._pairs(done).select(F.col("a").alias("__a")).distinct()
        seeds = distances.filter("d = 0").join(own, F.col(CARD) == F.col("__a"), "left_semi")
        return distances.filter("d > 0").unionAll(seeds).select(CARD, F.greatest("d", F.lit(1)).alias("round"))
