"""A hub account holding a third of all rows: with broadcasts disabled the
joins shuffle, and AQE splits the hub's partition (the plan says ``skew=true``)
while results stay whole."""

from pyspark.sql import functions as F

from cardtrail.operators import semi
from cardtrail.sources.cards import cards_from_list

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "cardtrail.broadcast.maxRows": "0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, fn):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _rows(spark, n=30000):
    # Every third row pays into the hub; the rest into distinct accounts.
    ids = spark.range(n)
    dest = F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(
        F.concat(F.lit("c"), F.col("id").cast("string")))
    return ids.select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("tfr_out_acct_no"),
                      dest.alias("tfr_in_acct_no"), F.col("id"))


def test_semi_join_splits_hub_partition(spark):
    def run():
        rows = _rows(spark)
        cards = cards_from_list(spark, ["hub", "c1", "c2", "p7"])
        out = semi.semi_join(rows, cards, "tfr_in_acct_no")
        n = len(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
        return n, plan
    n, plan = _with_conf(spark, run)
    assert n == 10000 + 2
    assert "skew=true" in plan


def test_touching_legs_split_hub_partition(spark):
    def run():
        rows = _rows(spark)
        cards = cards_from_list(spark, ["hub", "p7"])
        out = semi.touching(rows, cards, ["tfr_in_acct_no", "tfr_out_acct_no"])
        n = len(out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
        return n, plan
    n, plan = _with_conf(spark, run)
    # hub rows (10000) plus p7 rows that do not go to the hub: ids = 7 mod 50 and not 0 mod 3.
    want = 10000 + sum(1 for i in range(30000) if i % 50 == 7 and i % 3 != 0)
    assert n == want
    assert "skew=true" in plan
