"""Card lists: one-column DataFrames ``card: string``.

A list never passes through the driver as a Python collection, except when it
is given as one (a literal list or a comma-separated argument).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CARD


def cards_from_text(spark: SparkSession, path: str) -> DataFrame:
    """One card per line of a text file or folder; lines are kept as they are
    (duplicates included, as the seed count of the closure counts them)."""
    return spark.read.text(path).select(F.col("value").alias(CARD))


def cards_from_list(spark: SparkSession, cards: Iterable[str]) -> DataFrame:
    """A literal list, for small inputs such as command-line seeds."""
    return spark.createDataFrame([(c,) for c in cards], f"{CARD} string")


def cards_from_arg(spark: SparkSession, arg: str, sep: str = ",") -> DataFrame:
    """Seeds given as one separated string (``a,b,c``). Empty parts at the end are
    dropped, those between stay (``a,,b,`` is ``a``, an empty card, ``b``)."""
    parts = arg.split(sep)
    while parts and not parts[-1]:
        parts.pop()
    return cards_from_list(spark, parts)


def append_cards(cards: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a list to a stored one (the ``load data ... into table`` step)."""
    cards.select(CARD).write.mode("append").format(fmt).save(path)
