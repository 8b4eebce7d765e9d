"""Pair amounts kept as sums by day and merged as transfers stream in.

Every micro-batch writes its own partial sums, by day and pair, to a folder named after the
batch; a batch that runs again after a failure replaces that folder. So each transfer
counts once however often its batch is retried. ``totals`` adds the partial sums up;
``compact`` replaces those of finished batches by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..constants import AMOUNT_COL, DATE_COL, IN_COL, OUT_COL
from ..operators import summary
from ..plans.manifest import Manifest
from ..session import delete_path

_SCHEMA = f"{DATE_COL} string, {IN_COL} string, {OUT_COL} string, amount decimal(38,10), n long, n_unreadable long"


class DaySums:
    """Partial sums below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifest = Manifest(spark, f"{path}/manifest")

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Put the sums of a batch of transfers in place of what the batch wrote before."""
        if batch_id <= self._compacted():
            return  # it is in the compacted sums
        value = summary.amount_value()
        lost = (F.trim(F.col(AMOUNT_COL)) != "") & value.isNull()
        sums = rows.groupBy(DATE_COL, IN_COL, OUT_COL).agg(
            F.sum(value).cast("decimal(38,10)").alias("amount"), F.count(value).alias("n"), F.count(F.when(lost, 1)).alias("n_unreadable"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        self.manifest.done(f"batch-{batch_id}")

    def _compacted(self) -> int:
        return self.manifest.steps().get("compacted", {}).get("upto", -1)

    def partial(self) -> DataFrame:
        """The partial sums of all finished batches."""
        steps = self.manifest.steps()
        upto = steps.get("compacted", {}).get("upto", -1)
        batches = [int(s.removeprefix("batch-")) for s in steps if s.startswith("batch-")]
        folders = [f"{self.path}/batches/{b}" for b in sorted(batches) if b > upto]
        read = self.spark.read.schema(_SCHEMA)
        found = read.parquet(*folders) if folders else self.spark.createDataFrame([], _SCHEMA)
        return found.unionByName(read.parquet(f"{self.path}/compacted/{upto}")) if upto >= 0 else found

    def days(self) -> DataFrame:
        """(pdate, in, out, amount, n, n_unreadable), one row per day and pair."""
        return self.partial().groupBy(DATE_COL, IN_COL, OUT_COL).agg(*(F.sum(c).cast(t).alias(c) for c, t in (("amount", "decimal(38,10)"), ("n", "long"), ("n_unreadable", "long"))))

    def totals(self) -> DataFrame:
        """(in, out, amount) over all days."""
        return self.partial().groupBy(IN_COL, OUT_COL).agg(F.sum("amount").cast("decimal(38,10)").alias("amount"))

    def compact(self) -> None:
        """One table of day sums in place of the batches finished so far."""
        upto = max((int(s.removeprefix("batch-")) for s in self.manifest.steps() if s.startswith("batch-")), default=-1)
        before = self._compacted()
        if upto <= before:
            return
        self.days().write.mode("overwrite").partitionBy(DATE_COL).parquet(f"{self.path}/compacted/{upto}")
        self.manifest.done("compacted", upto=upto)
        for b in range(before + 1, upto + 1):
            delete_path(self.spark, f"{self.path}/batches/{b}")
        if before >= 0:
            delete_path(self.spark, f"{self.path}/compacted/{before}")


def sum_stream(spark: SparkSession, source: str, schema: T.StructType, sums: DaySums, checkpoint: str,
               keep=None, max_files: int | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Merge the files that arrive at ``source`` into ``sums`` until all there are are in.
    ``keep``: a condition on the rows. Progress is kept at ``checkpoint``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(source)
    if keep is not None:
        stream = stream.filter(keep)
    return (stream.writeStream.foreachBatch(sums.merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
