"""Transaction history over the driver's TPC-H-like test tables.

``lineitem`` joined to ``orders`` gives one transaction per line item, with the
string columns the tracing operators read. The mapping is fixed (FIXTURES.md
section 2) so that DuckDB can build the same rows for the oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism


def _s(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("string")


def _month_start(text: str) -> dt.date | None:
    """First day of the month of a ``yyyyMMdd`` bound, or None if it has no month.

    Bounds like ``20160931`` are not real dates; the month start still is, and
    every real day whose ``yyyyMMdd`` is >= the bound falls on or after it.
    """
    if len(text) != 8 or not text.isdigit():
        return None
    year, month = int(text[:4]), int(text[4:6])
    if not 1 <= month <= 12 or year < 1:
        return None
    return dt.date(year, month, 1)


def _next_month_start(text: str) -> dt.date | None:
    start = _month_start(text)
    if start is None:
        return None
    if start.month == 12:
        return dt.date(start.year + 1, 1, 1)
    return dt.date(start.year, start.month + 1, 1)


def transaction_view(spark: SparkSession, sf_dir: str, begin: str | None = None,
                     end: str | None = None) -> DataFrame:
    """The 14-column transaction view.

    ``begin``/``end`` (``yyyyMMdd`` strings) only add a *superset* range on
    ``l_shipdate`` that Parquet can push down; the exact ``pdate`` string
    predicate is the caller's (see ``functions.predicates``).
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lo = _month_start(begin) if begin else None
    hi = _next_month_start(end) if end else None
    if lo is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(lo).cast("timestamp_ntz"))
    if hi is not None:
        li = li.filter(F.col("l_shipdate") < F.lit(hi).cast("timestamp_ntz"))
    # The test files hold one row group each, so the scan is one task however
    # many cores there are. Spread the (pruned, filtered) rows by order key when
    # the scan has fewer splits than the session's parallelism; a table of many
    # files is left as it is. Hash, not round robin: deterministic on retry.
    cores = parallelism(spark)
    if cores is not None and li.rdd.getNumPartitions() < cores:
        li = li.repartition(cores, "l_orderkey")

    j = li.join(od, li["l_orderkey"] == od["o_orderkey"])
    flag = F.col("l_returnflag")
    line = F.col("l_linenumber")
    blank_or_null = F.when(line % 2 == 0, F.lit(""))
    cust = F.concat(F.lit("A"), _s("o_custkey"))
    return j.select(
        F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("pri_key"),
        F.when(flag == "R", "S33").when(flag == "A", "S25").otherwise("S22").alias("trans_id"),
        cust.alias("pri_acct_no_conv"),
        F.when(flag == "N", blank_or_null)
         .otherwise(F.concat(cust, F.when(line == 3, F.lit(" ")).otherwise(F.lit(""))))
         .alias("tfr_out_acct_no"),
        F.when(flag == "N", blank_or_null)
         .otherwise(F.concat(F.lit("A"), _s("l_partkey")))
         .alias("tfr_in_acct_no"),
        _s(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("trans_at"),
        F.concat(F.lpad(_s(F.col("l_orderkey") % 24), 2, "0"), F.lit("0000")).alias("loc_trans_tm"),
        F.concat(F.lit("I"), _s("l_suppkey")).alias("acpt_ins_id_cd"),
        F.col("l_linestatus").alias("trans_md"),
        F.when(F.col("l_tax") > 0.04, "1").otherwise("0").alias("cross_dist_in"),
        F.when(F.col("o_orderstatus") == "P", "05").otherwise("00").alias("resp_cd1"),
        F.when(line == 7, "20000").otherwise("10000").alias("cu_trans_st"),
        F.when(F.col("l_quantity") > 5, "1").otherwise("0").alias("sti_takeout_in"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("pdate"),
    )


# The same view as DuckDB SQL, for the oracle; it filters on ``pdate`` like the
# Spark side.
VIEW_SQL = """
SELECT
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS pri_key,
  CASE WHEN l_returnflag = 'R' THEN 'S33' WHEN l_returnflag = 'A' THEN 'S25' ELSE 'S22' END AS trans_id,
  'A' || CAST(o_custkey AS VARCHAR) AS pri_acct_no_conv,
  CASE WHEN l_returnflag = 'N' THEN (CASE WHEN l_linenumber % 2 = 0 THEN '' END)
       ELSE 'A' || CAST(o_custkey AS VARCHAR) || (CASE WHEN l_linenumber = 3 THEN ' ' ELSE '' END)
  END AS tfr_out_acct_no,
  CASE WHEN l_returnflag = 'N' THEN (CASE WHEN l_linenumber % 2 = 0 THEN '' END)
       ELSE 'A' || CAST(l_partkey AS VARCHAR)
  END AS tfr_in_acct_no,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS trans_at,
  lpad(CAST(l_orderkey % 24 AS VARCHAR), 2, '0') || '0000' AS loc_trans_tm,
  'I' || CAST(l_suppkey AS VARCHAR) AS acpt_ins_id_cd,
  l_linestatus AS trans_md,
  CASE WHEN l_tax > 0.04 THEN '1' ELSE '0' END AS cross_dist_in,
  CASE WHEN o_orderstatus = 'P' THEN '05' ELSE '00' END AS resp_cd1,
  CASE WHEN l_linenumber = 7 THEN '20000' ELSE '10000' END AS cu_trans_st,
  CASE WHEN l_quantity > 5 THEN '1' ELSE '0' END AS sti_takeout_in,
  strftime(l_shipdate, '%Y%m%d') AS pdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
