"""State kept as days arrive, partition-wise writes, the registered history, text read back."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cardtrail import sinks
from cardtrail.constants import AMOUNT_COL, DATE_COL, IN_COL, OUT_COL
from cardtrail.functions.text import ANY, parse_row_text, row_text
from cardtrail.jobs import SearchArgs
from cardtrail.operators import summary
from cardtrail.plans import closure, day_closure
from cardtrail.plans.day_closure import DayClosure
from cardtrail.session import scratch_path
from cardtrail.sources.cards import cards_from_arg, cards_from_list
from cardtrail.sources.history import names_from_text, register_history
from cardtrail.streaming.day_sums import DaySums, sum_stream

EDGES = "s string, d string"


def first_rounds(spark, edges, seeds):
    rows = spark.createDataFrame(edges, EDGES)
    return sorted(map(str, closure.trace(rows, cards_from_list(spark, seeds), "s", "d", stop="set").frontier.collect()))


def test_closure_day_by_day_equals_the_whole_run(spark):
    rng = random.Random(4)
    cards = [f"c{i}" for i in range(14)] + ["", None]
    days = [[(rng.choice(cards), rng.choice(cards)) for _ in range(rng.randint(0, 6))] for _ in range(4)]
    seeds = ["c0", "c1", "nobody"]
    state = DayClosure(spark, scratch_path(spark, "test-days"), cards_from_list(spark, seeds + ["c0", None]))
    for n, day in enumerate(days):
        facts = state.add(f"199701{n + 1:02d}", spark.createDataFrame(day, EDGES), "s", "d")
        assert state.add(f"199701{n + 1:02d}", spark.createDataFrame([("x", "c0")], EDGES), "s", "d") == facts  # given twice
        so_far = [e for d in days[:n + 1] for e in d]
        if n != 1:
            assert sorted(map(str, state.frontier().collect())) == first_rounds(spark, so_far, seeds)


def test_a_later_day_shortens_ways(spark):
    path = scratch_path(spark, "test-shorter")
    state = DayClosure(spark, path, cards_from_list(spark, ["a"]))
    state.add("1", spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", None)], EDGES), "s", "d")
    facts = state.add("2", spark.createDataFrame([("a", "d"), ("a", "b"), ("z", "e")], EDGES), "s", "d")
    assert facts["pairs"] == 4  # a-d and z-e, both ways
    again = DayClosure(spark, path)  # the state is all in its folder
    got = {r["card"]: r["round"] for r in again.frontier().collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 1, "e": 2, None: 3, "z": 3}


def test_a_wave_reads_the_waves_before_it_in_one_scan(spark, monkeypatch):
    scans, write = [], day_closure.write_counted

    def notes(df, path, mode="overwrite"):
        if "/waves/" in path:
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return write(df, path, mode)

    monkeypatch.setattr(day_closure, "write_counted", notes)
    state = DayClosure(spark, scratch_path(spark, "test-waves"), cards_from_list(spark, ["c0"]))
    facts = state.add("1", spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(6)], EDGES), "s", "d")
    assert facts["waves"] == 6 and len(scans) == 7 and max(scans) == 4  # pairs, probe, known, waves


def test_an_interrupted_day_is_done_again(spark, monkeypatch):
    state = DayClosure(spark, scratch_path(spark, "test-broken"), cards_from_list(spark, ["a"]))
    state.add("1", spark.createDataFrame([("a", "b")], EDGES), "s", "d")
    day, write = spark.createDataFrame([("b", "c"), ("c", "d"), ("d", "e")], EDGES), day_closure.write_counted

    def fails(df, path, mode="overwrite"):
        if path.endswith("waves/1"):
            raise RuntimeError("lost")
        return write(df, path, mode)

    monkeypatch.setattr(day_closure, "write_counted", fails)
    with pytest.raises(RuntimeError):
        state.add("2", day, "s", "d")
    assert {r["card"] for r in state.frontier().collect()} == {"a", "b"}
    monkeypatch.setattr(day_closure, "write_counted", write)
    state.add("2", day, "s", "d")
    assert {(r["card"], r["round"]) for r in state.frontier().collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}


TRANSFERS = f"{DATE_COL} string, {IN_COL} string, {OUT_COL} string, {AMOUNT_COL} string"


def totals(sums):
    return {(r[IN_COL], r[OUT_COL]): r["amount"] and str(r["amount"].normalize()) for r in sums.totals().collect()}


def test_replayed_batches_change_nothing(spark):
    sums = DaySums(spark, scratch_path(spark, "test-sums"))
    assert totals(sums) == {}
    one = spark.createDataFrame([("d1", "a", "b", "1.5"), ("d1", "a", "b", "0.00001"), ("d2", "a", "b", "2"), ("d1", None, "b", "x")], TRANSFERS)
    two = spark.createDataFrame([("d2", "a", "b", "3"), ("d2", "c", "b", "1")], TRANSFERS)
    for batch, rows in ((0, one), (1, two), (0, one), (1, two)):
        sums.merge(rows, batch)
    want = {("a", "b"): "6.50001", ("c", "b"): "1", (None, "b"): None}
    assert totals(sums) == want
    assert {(r[DATE_COL], r[IN_COL], r["n"], r["n_unreadable"]) for r in sums.days().collect()} == {("d1", "a", 2, 0), ("d2", "a", 2, 0), ("d2", "c", 1, 0), ("d1", None, 0, 1)}
    sums.compact()
    sums.merge(two, 1)  # replayed after the compaction
    assert totals(sums) == want
    sums.merge(spark.createDataFrame([("d3", "c", "b", "1")], TRANSFERS), 2)
    sums.compact()
    assert totals(sums) == want | {("c", "b"): "2"}


def test_a_failed_batch_counts_once(spark):
    source, state, progress = (scratch_path(spark, n) for n in ("test-in", "test-state", "test-progress"))
    rows = spark.createDataFrame([(f"d{i % 3}", "a", "b", "1") for i in range(30)], TRANSFERS)
    rows.repartition(3).write.parquet(source)

    class Fails(DaySums):
        def merge(self, batch, batch_id):
            super().merge(batch, batch_id)
            if batch_id == 1:
                raise RuntimeError("lost after the sums were written")

    with pytest.raises(Exception, match="lost"):
        sum_stream(spark, source, rows.schema, Fails(spark, state), progress, max_files=1).awaitTermination()
    sums = DaySums(spark, state)
    sum_stream(spark, source, rows.schema, sums, progress, max_files=1).awaitTermination()
    assert totals(sums) == {("a", "b"): "3E+1"}


def test_only_the_partitions_written_are_replaced(spark):
    path = scratch_path(spark, "test-partitions")
    old = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "card string, pdate string")
    sinks.replace_partitions(old, path, ["pdate"])
    sinks.replace_partitions(spark.createDataFrame([("x", "d1"), ("y", "d3")], old.schema), path, ["pdate"])
    rows = lambda: {tuple(r) for r in spark.read.schema(old.schema).parquet(path).collect()}
    assert rows() == {("x", "d1"), ("c", "d2"), ("y", "d3")}
    bad = spark.createDataFrame([("n", "d2")] * 5, old.schema).withColumn("card", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_partitions(bad, path, ["pdate"])
    assert rows() == {("x", "d1"), ("c", "d2"), ("y", "d3")}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_registered_history_opens_only_its_days(spark):
    path = scratch_path(spark, "test-tree")
    rows = [(f"a{i}", f"199701{i % 20 + 1:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "pri_acct_no_conv string, pdate string")
    df.where("pdate < '19970111'").write.partitionBy("pdate").parquet(path)
    table = register_history(spark, "ct_test_tree", path, ["pri_acct_no_conv", "never_written", "pdate"])
    assert table.dtypes == [("pri_acct_no_conv", "string"), ("never_written", "string"), ("pdate", "string")]
    df.where("pdate >= '19970111'").write.mode("append").partitionBy("pdate").parquet(path)
    assert spark.table("ct_test_tree").count() == 30  # new days aren't in the catalog yet
    table = register_history(spark, "ct_test_tree", path, [])
    days = table.filter("pdate >= '19970109' AND pdate <= '19970112'")
    assert days.count() == 12 and days.where("never_written is not null").count() == 0
    assert len({f.rsplit("pdate=", 1)[1].split("/")[0] for f in days.select("pri_acct_no_conv").inputFiles()}) >= 4
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pdate" in plan and "19970112" in plan
    read = days.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].rsplit("pdate=", 1)[1].split("/")[0] for r in read} == {"19970109", "19970110", "19970111", "19970112"}
    sinks.drop_table(spark, "ct_test_tree")
    assert os.path.isdir(path.removeprefix("file:"))


def test_names_of_the_extract():
    text = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "FIXTURES.md")).read()
    names = names_from_text(text.split("## 6.")[1].split("```")[1])
    assert len(names) == 256 and names[0] == "pri_key" and {IN_COL, OUT_COL, AMOUNT_COL} <= set(names)
    with pytest.raises(ValueError):
        names_from_text("a, b a")


def test_declared_extract_table(spark):
    text = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "FIXTURES.md")).read()
    names = names_from_text(text.split("## 6.")[1].split("```")[1])
    path = scratch_path(spark, "test-wide")
    spark.createDataFrame([("k", "d1")], "pri_key string, pdate string").write.partitionBy("pdate").parquet(path)
    register_history(spark, "ct_test_wide", path, names)
    described = [(r["col_name"], r["data_type"]) for r in spark.sql("DESCRIBE ct_test_wide").collect()]
    described = described[:next(i for i, (n, _) in enumerate(described) if n.startswith("#"))]
    assert described == [(n, "string") for n in names if n != DATE_COL] + [(DATE_COL, "string")]
    assert spark.table("ct_test_wide").select("pri_key", "trans_at").collect() == [("k", None)]
    sinks.drop_table(spark, "ct_test_wide")


def parsed(spark, lines, columns):
    return [tuple(r) for r in parse_row_text(spark.createDataFrame([(x,) for x in lines], "value string"), columns).collect()]


def test_lines_with_one_cut(spark):
    columns = {"card": "[a-z0-9]", "note": ANY, "amount": "[0-9]"}
    lines = ["[a1,any, text,with commas,12]", "[,,]", "[null,null,null]", "[a,line\nbreak,1]", "[a,b]", "a,b,1", "[a,b,x]", None]
    got = parsed(spark, lines, columns)
    assert got == [("a1", "any, text,with commas", "12", "ok"), ("", "", "", "ok"), (None, None, None, "broken"), ("a", "line\nbreak", "1", "ok"),
                   (None, None, None, "broken"), (None, None, None, "broken"), (None, None, None, "broken"), (None, None, None, "broken")]
    assert parsed(spark, ["[null,null,null]"], {c: f"{p}|null" for c, p in columns.items()}) == [(None, None, None, "ok")]


def test_lines_with_several_cuts_are_told(spark):
    two = {"x": "[a-z,]", "y": "[a-z,]"}
    assert parsed(spark, ["[a,b]", "[a,b,c]", "[a,,b]", "[,]"], two) == [("a", "b", "ok"), (None, None, "ambiguous"), (None, None, "ambiguous"), ("", "", "ok")]


def test_every_cut_is_counted(spark):
    rng = random.Random(2)
    kinds = {"x": "[ab,]", "y": "[a1]", "z": "[b,1]"}

    def cuts(body, left):
        if len(left) == 1:
            return int(all(c in left[0] for c in body))
        return sum(cuts(body[i + 1:], left[1:]) for i, c in enumerate(body) if c == "," and all(k in left[0] for k in body[:i]))

    lines = ["".join(rng.choices("ab1,,", k=rng.randint(2, 9))) for _ in range(300)]
    got = parsed(spark, [f"[{x}]" for x in lines], kinds)
    for body, row in zip(lines, got):
        n = cuts(body, ["ab,", "a1", "b,1"])
        assert row[3] == ("broken" if n == 0 else "ok" if n == 1 else "ambiguous"), body
        if n == 1:
            assert ",".join(row[:3]) == body


def test_text_of_rows_reads_back(spark):
    rows = [("a", None, "1"), ("", "x, y", "22"), (None, "", "")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    path = scratch_path(spark, "test-text")
    df.select(row_text(df).alias("value")).write.text(path)
    back = sinks.read_row_text(spark, path, {"p": "[a-z]|null", "q": "[a-z, ]|null", "r": "[0-9]"})
    assert sorted(map(str, back.drop("status").collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("text, want", [
    ("0.00001", "0.00001"), ("12345678901234567890123456.5", "12345678901234567890123456.5"), (" 7 ", "7"), ("-1.50", "-1.5"), ("1e2", "100"),
    ("0.0000000001", "1E-10"), ("0.00000000001", None), ("0.0000000000000000000001", None), ("1.0000000000000000000000", "1"), ("1e-12", None),
    ("99999999999999999999999999999", None), ("x", None), ("", None), (None, None)])
def test_amounts_are_exact_or_counted(spark, text, want):
    df = spark.createDataFrame([("a", "b", text)], f"{IN_COL} string, {OUT_COL} string, {AMOUNT_COL} string")
    got = summary.pair_amount(df).first()["amount"]
    assert (got if got is None else str(got.normalize())) == (want if want != "100" else "1E+2")
    assert summary.unreadable_amounts(df).first()["n_unreadable"] == (want is None and bool((text or "").strip()))


def test_arguments(spark):
    args = SearchArgs.parse(["1", "2", "t", "s", "d", "a,,b,,"])
    assert [r["card"] for r in cards_from_arg(spark, args.seeds).collect()] == ["a", "", "b"]
