"""Aggregations: pair amounts, the edge list, distinct counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import AMOUNT_COL, CARD, IN_COL, OUT_COL


#: Amounts: exact, with ten decimals and 28 digits before them, also for the sum.
AMOUNT_TYPE = "decimal(38,10)"


def amount_value(col: str = AMOUNT_COL, amount_type: str = AMOUNT_TYPE):
    """An amount string as an exact number; null if it isn't one that fits
    ``amount_type`` without loss (see ``unreadable_amounts``)."""
    value = F.col(col).try_cast(amount_type)
    scale = re.fullmatch(r"\s*(?:decimal\(\s*\d+\s*,\s*(\d+)\s*\)|(?:big|small|tiny)?int|long|integer)\s*", amount_type, re.I)
    if scale is None:
        return value  # a type without a fixed number of decimals
    decimals = F.length(F.regexp_extract(F.trim(F.col(col)), r"\.(\d*?)0*$", 1))
    power = F.col(col).rlike("[eE]")  # 1e-12 would read as 0
    same = F.when(power, F.col(col).try_cast("double") == value.cast("double")).otherwise(decimals <= int(scale[1] or 0))
    return F.when(same, value)


def unreadable_amounts(df: DataFrame, amount: str = AMOUNT_COL, amount_type: str = AMOUNT_TYPE,
                       name: str = "n_unreadable") -> DataFrame:
    """How many amounts a sum leaves out because they can't be read exactly as
    ``amount_type``; null and blank amounts don't count."""
    lost = (F.trim(F.col(amount)) != "") & amount_value(amount, amount_type).isNull()
    return df.agg(F.count(F.when(lost, 1)).alias(name))


def plain_amount(col: str):
    """A decimal as text without trailing zeros."""
    text = F.col(col).cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def pair_amount(df: DataFrame, in_col: str = IN_COL, out_col: str = OUT_COL,
                amount: str = AMOUNT_COL, name: str = "amount",
                amount_type: str = AMOUNT_TYPE) -> DataFrame:
    """``sum(amount)`` by (in, out), over the rows as given (a bag stays a bag);
    decimal(38, s) for a decimal type of scale s, else ``amount_type``.

    The partial aggregation runs map-side, so a hot pair is collapsed before
    the shuffle.
    """
    return (df.groupBy(in_col, out_col)
              .agg(F.sum(amount_value(amount, amount_type)).cast(_sum_type(amount_type)).alias(name)))


def _sum_type(amount_type: str) -> str:
    scale = re.fullmatch(r"\s*decimal\(\s*\d+\s*,\s*(\d+)\s*\)\s*", amount_type, re.I)
    return f"decimal(38,{scale[1]})" if scale else amount_type


def edge_list(df: DataFrame, src: str, dest: str) -> DataFrame:
    """Distinct (trim(src), trim(dest)) pairs, keeping the column names."""
    return df.select(F.trim(F.col(src)).alias(src), F.trim(F.col(dest)).alias(dest)).distinct()


def distinct_count(df: DataFrame, col: str = CARD, name: str = "n_cards") -> DataFrame:
    """``count(distinct col)``: null is not counted."""
    return df.agg(F.countDistinct(F.col(col)).alias(name))
