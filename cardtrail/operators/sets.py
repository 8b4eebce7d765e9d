"""Endpoint bags and sets: the cards at either end of a set of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CARD


def endpoint_bag(df: DataFrame, cols: Sequence[str], name: str = CARD) -> DataFrame:
    """``UNION ALL`` of the columns, in one scan; nulls are kept."""
    return df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias(name))


def endpoint_set(df: DataFrame, cols: Sequence[str], name: str = CARD) -> DataFrame:
    """Distinct endpoints (one null kept). One aggregation with a map-side
    partial step, instead of a distinct per column, a union and a distinct."""
    return endpoint_bag(df, cols, name).distinct()
