"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cardtrail.session import delete_path, scratch_path

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once per SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_cardtrail_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="cardtrail-py-"), "cardtrail.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._cardtrail_shipped = True


#: Bytes of a batch that become one pandas frame; Python strings take several times that.
FRAME_BYTES = 8 << 20


def frame(batch: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """A batch as pandas; a column of whole numbers with nulls stays one of whole numbers
    (as plain pandas it becomes floats, which change numbers above 2^53)."""
    kinds = {f.type: pd.Series(dtype="Int64").dtype for f, c in zip(batch.schema, batch.columns) if pa.types.is_integer(f.type) and c.null_count}
    return batch.to_pandas(types_mapper=kinds.get)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInPandas`` with this package importable in the tasks, and with nullable
    whole numbers kept exact on the way in and out."""
    ship(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def small(batches):
        for batch in batches:  # as many rows at a time as hold about FRAME_BYTES
            rows = max(1, batch.num_rows * FRAME_BYTES // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, rows):
                yield frame(batch.slice(a, rows))

    def exact(batches):
        for pdf in run(small(batches)):
            yield pa.RecordBatch.from_pandas(pdf, schema=out, preserve_index=False)

    return df.mapInArrow(exact, schema)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage.

    ``cut`` writes a DataFrame as Parquet and reads it back, so that later stages
    recover from lost executors without recomputing it; ``drop`` deletes the tables
    named, for those that no returned DataFrame reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))


def slices(texts: list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``most`` characters each, whole texts only."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
