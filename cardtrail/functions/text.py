"""Row rendering as ``[v1,v2,...]`` with null as ``null`` (the text form of a
saved row), and reading such lines back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    cols = columns or df.columns
    parts = F.array(*[F.col(c).cast("string") for c in cols])
    return F.concat(F.lit("["), F.array_join(parts, ",", "null"), F.lit("]"))


#: What a column's values may be made of, if nothing narrower is known.
ANY = r"[\s\S]"


def parse_row_text(lines: DataFrame, columns: Mapping[str, str], line: str = "value") -> DataFrame:
    """The rows of saved text lines: string columns ``columns`` and ``status``.

    A value may hold commas, so the commas alone don't say where it ends. ``columns`` maps
    each column, in order, to a pattern of one character of its values (``[0-9]``, ``ANY``);
    a line is cut so that every part is made of its column's characters. ``status`` is
    ``ok`` if there is exactly one such cut, ``ambiguous`` if there are several and
    ``broken`` if there is none; the columns are then null, so that no value lands in the
    wrong column unseen. ``null`` reads as null.

    All cuts of a line are ordered by the lengths of their parts. A match that takes as
    much as it can for each part from the left finds the last of them, one that takes as
    little as it can the first: there is one cut if these two are equal."""
    most = r"^\[" + ",".join(f"((?:{p})*)" for p in columns.values()) + r"\]$"
    least = r"^\[" + ",".join(f"((?:{p})*?)" for p in columns.values()) + r"\]$"
    text = F.col(line)
    parts = [F.struct(*(F.regexp_extract(text, pattern, i + 1).alias(c) for i, c in enumerate(columns))) for pattern in (most, least)]
    cut = lines.withColumns({"__fits": F.coalesce(text.rlike(most), F.lit(False)), "__most": parts[0], "__least": parts[1]})
    status = F.when(~F.col("__fits"), "broken").when(F.col("__most") != F.col("__least"), "ambiguous").otherwise("ok")
    cut = cut.withColumn("__status", status)
    value = lambda c: F.when((F.col("__status") == "ok") & (F.col("__most")[c] != "null"), F.col("__most")[c])
    return cut.select(*(value(c).alias(c) for c in columns), F.col("__status").alias("status"))
