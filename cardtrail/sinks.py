"""Outputs: tables, saved row text, tab-delimited exports, per-round folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions.text import parse_row_text, row_text


def write_counted(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write ``df`` as Parquet and return its row count, observed during the
    write (one job, no second scan)."""
    obs = Observation()
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return int(obs.get["n"])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None) -> None:
    """``INSERT OVERWRITE``-style write of a whole result."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_table(df: DataFrame, name: str, overwrite: bool = True) -> None:
    """``INSERT OVERWRITE`` (or ``INSERT INTO``) a catalog table. An existing table
    keeps its columns, format and partitions, and takes the columns of ``df`` by
    position; one that doesn't exist is created from ``df``."""
    if df.sparkSession.catalog.tableExists(name):
        df.write.insertInto(name, overwrite=overwrite)
    else:
        df.write.saveAsTable(name)


def replace_partitions(df: DataFrame, target: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """``INSERT OVERWRITE ... PARTITION`` with dynamic partitions: the partitions that
    ``df`` has rows of are replaced, all others stay.

    ``target`` is a catalog table (``partition_by`` None; columns by position, the
    partition columns last) or a folder. The rows are written beside the data first; each
    partition is published by one rename when the whole job has ended well, so a failed job
    leaves everything as it was."""
    if partition_by is None:
        conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")  # an insert takes it from the session only
        try:
            df.write.insertInto(target, overwrite=True)
        finally:
            conf.set(key, before)
    else:
        df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(target)


def write_row_text(df: DataFrame, path: str, columns: list[str] | None = None,
                   mode: str = "error") -> None:
    """One ``[v1,v2,...]`` line per row (null as ``null``); by default fails if
    ``path`` exists, like saving an RDD as text."""
    df.select(row_text(df, columns).alias("value")).write.mode(mode).text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite",
                    null_value: str = "\\N") -> None:
    """A delimited text table as Hive reads it: no quotes, null as ``\\N``. Such a
    file can't hold a value with the separator or a line break in it (or the text
    of the null marker): the write fails on one rather than shift columns."""
    def cell(c):
        text = F.col(f"`{c}`").cast("string")
        wrong = text.contains(sep) | text.contains("\n") | text.contains("\r") | (text == null_value)
        return F.when(wrong, F.raise_error(F.concat(F.lit(f"column {c} can't be written delimited: "), text))
                      ).otherwise(F.coalesce(text, F.lit(null_value)))
    df.select(F.concat_ws(sep, *[cell(c) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def read_row_text(spark, path: str, columns) -> DataFrame:
    """The rows of what ``write_row_text`` wrote, with ``status`` (see ``parse_row_text``)."""
    return parse_row_text(spark.read.text(path), columns)


def read_delimited(spark, path: str, names: list[str], sep: str = "\t", null_value: str = "\\N") -> DataFrame:
    """A table that ``write_delimited`` wrote, all columns strings."""
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    cell = lambda i: F.when(parts[i] != null_value, parts[i])
    return spark.read.text(path).select(*[cell(i).alias(n) for i, n in enumerate(names)])


def write_rounds(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Per-round outputs as one table partitioned by ``round``
    (``path/round=1``, ``path/round=2``, ...)."""
    write_table(df, path, mode, fmt, ["round"])


def ensure_table(spark, name: str, schema, fmt: str = "parquet") -> bool:
    """``CREATE TABLE IF NOT EXISTS``: create an empty catalog table with the
    given schema unless it exists; returns whether it was created."""
    if spark.catalog.tableExists(name):
        return False
    spark.catalog.createTable(name, source=fmt, schema=schema)
    return True


def drop_table(spark, name: str) -> None:
    """``DROP TABLE IF EXISTS``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
