"""The transaction history: a table or Parquet folder of string columns,
normally partitioned by ``pdate`` (``yyyyMMdd``)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..constants import DATE_COL
from ..functions import predicates as P


def history_schema(names: Iterable[str]) -> T.StructType:
    """All-string, nullable schema for the given column names, in order.

    The history's columns are declared by its owner; pass them in rather than
    hard-coding them here.
    """
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def read_history(spark: SparkSession, source: str, begin: str | None = None,
                 end: str | None = None, end_inclusive: bool = True,
                 fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """History rows, optionally restricted to a ``pdate`` window.

    ``source`` is a table name (``fmt="table"``) or a path. The window compares
    strings, so it becomes partition pruning on a ``pdate``-partitioned table
    and a pushed filter otherwise; columns not selected later are pruned by
    Catalyst. A path read without ``schema`` infers a ``pdate`` partition as a
    number; it is turned back into the string it is (pruning still applies,
    the filter references only the partition column).
    """
    if fmt == "table":
        df = spark.table(source)
    else:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load(source)
    if DATE_COL in df.columns and df.schema[DATE_COL].dataType != T.StringType():
        df = df.withColumn(DATE_COL, df[DATE_COL].cast("string"))
    if begin is not None or end is not None:
        df = df.filter(P.date_window(begin, end, end_inclusive))
    return df


def names_from_text(text: str) -> list[str]:
    """Column names of a list separated by commas or white space, in order."""
    names = text.replace(",", " ").split()
    if len(set(names)) != len(names):
        raise ValueError("a column is named twice")
    return names


def register_history(spark: SparkSession, name: str, path: str, names: Iterable[str],
                     fmt: str = "parquet") -> DataFrame:
    """An external catalog table over a folder tree ``path/pdate=yyyyMMdd/...``.

    All columns are strings as declared, ``pdate`` is the partition column. The folders
    found are recovered as partitions into the catalog, so a window opens only its days and
    lists no others; after new days arrive, call it again. Dropping the table leaves the
    files."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{n}` STRING" for n in [*(n for n in names if n != DATE_COL), DATE_COL])
        spark.sql(f"CREATE TABLE {name} ({columns}) USING {fmt} PARTITIONED BY (`{DATE_COL}`) LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
