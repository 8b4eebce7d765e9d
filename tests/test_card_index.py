"""The card index: only the files worth reading are read, and no row is missed."""

import shutil

import pytest
from pyspark.sql import functions as F

from cardtrail import queries as Q
from cardtrail.operators import semi
from cardtrail.session import scratch_path
from cardtrail.sources.card_index import LEGS, CardIndex
from cardtrail.sources.cards import cards_from_list

from .conftest import SF001


@pytest.fixture
def tree(spark):
    path = scratch_path(spark, "test-indexed")
    rows = [(f"p{i % 40}", f"o{i % 25}" if i % 3 else None, f"i{i % 30}" if i % 4 else "", str(i), f"199701{i % 20 + 1:02d}") for i in range(400)]
    names = ["pri_acct_no_conv", "tfr_out_acct_no", "tfr_in_acct_no", "trans_at", "pdate"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    df.repartition("pdate").write.partitionBy("pdate").parquet(path)
    return path, df


def bag(df):
    return sorted(map(str, df.collect()))


def days_read(df):
    return {r["f"].rsplit("pdate=", 1)[1].split("/")[0] for r in df.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}


def test_only_files_of_the_cards_are_read(spark, tree):
    path, df = tree
    index = CardIndex(spark, path, path + "-index", df.schema, buckets=4)
    assert index.update() == 20 and index.update() == 0
    cards = cards_from_list(spark, ["p3", "o7", "nobody", ""])
    want = semi.legs_extract(df, cards, LEGS, 4).select(*df.columns)
    assert bag(index.extract(cards, 4).select(*df.columns)) == bag(want)
    few = cards_from_list(spark, ["p3"])
    assert days_read(index.rows(few, 1)) == {r["pdate"] for r in df.where("pri_acct_no_conv = 'p3'").collect()} and len(days_read(index.rows(few, 1))) < 5
    assert index.extract(cards_from_list(spark, ["nobody"]), 1).count() == 0
    late = index.extract(cards, 4, begin="19970110", end="19970115").select(*df.columns)
    assert bag(late) == bag(want.where("pdate between '19970110' and '19970115'"))


def test_unindexed_changed_and_deleted_files(spark, tree):
    path, df = tree
    index = CardIndex(spark, path, path + "-index", df.schema)
    cards = cards_from_list(spark, ["p3", "new"])
    want = bag(semi.legs_extract(df, cards, LEGS, 2).select(*df.columns))
    assert bag(index.extract(cards, 2).select(*df.columns)) == want  # no index yet: all files are unknown
    assert index.update(batch_files=7) == 20
    more = spark.createDataFrame([("new", None, None, "1", "19970105"), ("p3", None, None, "2", "19970131")], df.schema)
    more.write.mode("append").partitionBy("pdate").parquet(path)
    both = df.unionAll(more)
    want = bag(semi.legs_extract(both, cards, LEGS, 2).select(*df.columns))
    assert bag(index.extract(cards, 2).select(*df.columns)) == want
    assert index.update() == 2 and bag(index.extract(cards, 2).select(*df.columns)) == want
    shutil.rmtree(path.removeprefix("file:") + "/pdate=19970105")
    assert bag(index.extract(cards, 2).select(*df.columns)) == bag(semi.legs_extract(both.where("pdate <> '19970105'"), cards, LEGS, 2).select(*df.columns))


def test_a_list_of_too_many_files_scans_the_folder(spark, tree):
    path, df = tree
    index = CardIndex(spark, path, path + "-index", df.schema, max_files=3)
    index.update()
    cards = df.select(F.col("pri_acct_no_conv").alias("card")).distinct()
    assert bag(index.extract(cards).select(*df.columns)) == bag(semi.legs_extract(df, cards, LEGS).select(*df.columns))
    assert len(days_read(index.rows(cards))) == 20


def test_a_lookup_reads_only_its_buckets(spark, tree):
    path, df = tree
    index = CardIndex(spark, path, path + "-index", df.schema, buckets=16)
    index.update()
    found = index.files(cards_from_list(spark, ["p3"]), 1)
    found.collect()
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_the_extract_of_ten_cards_opens_few_files(spark):
    path = Q._history_tree(spark, SF001)
    view = Q._closed(spark, SF001)
    index = CardIndex(spark, path, path + "-index", view.schema)
    n = index.update()
    cards = Q._cards(spark)
    opened = index.rows(cards, 10).inputFiles()
    assert len(opened) == index.files(cards, 10).count() < n / 2
    assert index.extract(cards, 10).count() == 30
