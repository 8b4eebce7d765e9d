"""An inverted index of a history folder: which files hold rows of a card.

A list of a few cards matches a few rows of a history of many files, yet a semi join reads
all of them. The index holds (card, day, file) once per card and file, for every account
column, dealt into hash buckets of the card and sorted by it; a lookup reads the list's
buckets only and gives the files worth reading. An extract then reads these and the files
that the index doesn't know, or knows in another state: new days are found before they are
indexed, and the rows are always those of a scan of the whole folder.

``update`` indexes what it doesn't know yet. Index rows are written before the files are
put on record as covered, so an update that fails can only leave rows that are written
again, which cost a file read at most. A lookup that names more than ``max_files`` files
is no use; the extract then scans the folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CARD, DATE_COL, IN_COL, OUT_COL, PRI_COL
from ..functions import predicates as P
from ..operators import semi
from ..session import broadcast_row_limit

_COVERED = "file string, length long, modified timestamp"
LEGS = (IN_COL, OUT_COL, PRI_COL)


def _plain(path):
    """A file's name, written the same way by the lister and the reader."""
    return F.regexp_replace(path, "^file:/+", "file:/")


class CardIndex:
    """The index at ``path`` of the Parquet files below ``history``, whose columns are those
    of ``schema`` (with the partition column ``pdate``, if the folder has one)."""

    def __init__(self, spark: SparkSession, history: str, path: str, schema: T.StructType,
                 legs: Sequence[str] = LEGS, buckets: int = 64, max_files: int = 10_000):
        self.spark, self.history, self.path, self.schema = spark, history, path, schema
        self.legs, self.buckets, self.max_files = list(legs), buckets, max_files

    def _read(self, files: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("basePath", self.history)
        return reader.parquet(*files) if files is not None else reader.parquet(self.history)

    def _stored(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def listing(self) -> DataFrame:
        """(file, length, modified) of the history's files; no file is opened."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.history))
        return files.select(_plain(F.col("path")).alias("file"), "length", F.col("modificationTime").alias("modified"))

    def unknown(self) -> DataFrame:
        """(file, length, modified) of the files that the index doesn't cover as they are."""
        return self.listing().join(self._stored("covered", _COVERED), ["file", "length", "modified"], "left_anti")

    def update(self, batch_files: int = 1000) -> int:
        """Index the files that it doesn't cover; how many these were."""
        n, rest = 0, self.unknown().orderBy("file")
        while True:
            batch = rest.limit(batch_files).collect()  # names of at most batch_files files
            if not batch:
                return n
            n += len(batch)
            rows = self._read([r["file"] for r in batch])
            day = F.col(DATE_COL).cast("string") if DATE_COL in self.schema.names else F.lit(None).cast("string")
            entries = rows.select(F.explode(F.array_distinct(F.array(*self.legs))).alias(CARD), day.alias("day"), _plain(F.col("_metadata.file_path")).alias("file"))
            entries = entries.filter(F.col(CARD).isNotNull()).distinct().withColumn("bucket", self._bucket(CARD))
            # a card in every file has one entry a file: dealt by file too
            (entries.repartition("bucket", F.pmod(F.xxhash64("file"), F.lit(8))).sortWithinPartitions("bucket", CARD)
             .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/entries"))
            self.spark.createDataFrame(batch, _COVERED).write.mode("append").parquet(f"{self.path}/covered")
            rest = self.unknown().orderBy("file")

    def _bucket(self, card: str):
        return F.pmod(F.xxhash64(card), F.lit(self.buckets)).cast("int")

    def files(self, cards: DataFrame, known_rows: int | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
        """(file) of the files that hold rows of the cards, by the index."""
        entries = self._stored("entries", f"{CARD} string, day string, file string, bucket int")
        if begin is not None or end is not None:
            window = F.lit(True) if begin is None else F.col("day") >= begin
            window = window if end is None else window & (F.col("day") <= end)
            entries = entries.filter(F.col("day").isNull() | window)
        # the condition always holds; with one, the planner lets the list's buckets prune folders
        keys = cards.select(F.col(CARD).alias("__card"), self._bucket(CARD).alias("__bucket")).filter("__bucket >= 0")
        if known_rows is not None and known_rows <= broadcast_row_limit(self.spark):
            keys = F.broadcast(keys)
        same = (F.col("bucket") == F.col("__bucket")) & (F.col(CARD) == F.col("__card"))
        return entries.join(keys, same, "left_semi").select("file").distinct()

    def rows(self, cards: DataFrame, known_rows: int | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
        """The history's rows of the (closed) window from the files worth reading: all rows of
        the cards, and others."""
        listed = self.listing()
        new = self.unknown().select("file")
        indexed = self.files(cards, known_rows, begin, end).join(listed, "file", "left_semi")
        wanted = [r["file"] for r in new.union(indexed).distinct().limit(self.max_files + 1).collect()]
        if not wanted:
            return self._read().limit(0)
        history = self._read(wanted if len(wanted) <= self.max_files else None)
        return history if begin is None and end is None else history.filter(P.date_window(begin, end))

    def extract(self, cards: DataFrame, known_rows: int | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
        """The bag of rows listed by any leg, as ``semi.legs_extract`` of the whole window."""
        return semi.legs_extract(self.rows(cards, known_rows, begin, end), cards, self.legs, known_rows)
