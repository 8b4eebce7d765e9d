import pytest
from pyspark.sql import functions as F

from cardtrail.llm import mixing
from cardtrail.llm.queries import op3_mixing

from .helpers import SF001, documents, words


def targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check(docs, rows, slack):
    size = {}
    for r in docs:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    want = targets(size)
    by_id = {r["doc_id"]: r for r in docs}
    taken = dict.fromkeys(size, 0)
    for r in rows:
        d = by_id[r["doc_id"]]
        assert r["size"] == len(words(d["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[d["source"]] and r["target"] == pytest.approx(want[d["source"]])
        taken[d["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= slack


def test_whole_table(spark):
    rows = op3_mixing(spark, SF001).collect()
    assert len(rows) == 1000
    check(spark.read.parquet(f"{SF001}/documents.parquet").collect(), rows, slack=80)
    assert sorted(rows) == sorted(op3_mixing(spark, SF001).collect())


def test_awkward_rows(spark):
    docs = documents(spark, clash=True)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(docs.collect(), rows, slack=32)
    assert mixing.mix(documents(spark, [])).count() == 0
    nothing = mixing.mix(documents(spark, [(1, None, None, "a", None), (2, "", None, "b", 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2


def test_documents_of_the_mix_hold_the_words_taken(spark):
    docs = documents(spark, clash=True)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"]) and r["size"] == "clash"
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    want = {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("n, size", [(200, 5), (400, 10)])
def test_small_source_of_short_documents_in_a_large_table(spark, n, size):
    """About 400 hash ranges: a range holds one or two of the source's documents."""
    docs = spark.range(102_400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("source"),
        F.when(F.col("id") < n, F.repeat(F.lit("w "), size)).otherwise(F.repeat(F.lit("w "), 20)).alias("text"))
    rows = mixing.mix(docs).where("source = 'a'").collect()
    assert len(rows) == n and {r["target"] for r in rows} == {2.0 * n * size}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 2 * n * size) <= 16


@pytest.mark.parametrize("shards, quotas, want", [
    ([10, 10, 30], [1, 1, 3], [16, 16, 48]),                    # nothing cut
    ([5, 40, 40], [1, 4, 4], [10, 70, 64]),                     # 6 cut, to the shard of the next quotient
    ([2, 2, 2, 60], [1, 1, 1, 3], [4, 4, 4, 84]),               # 36 cut: a block, then the rest
    ([2, 2, 2, 9, 30], [1, 1, 1, 0, 3], [4, 4, 4, 18, 60]),     # 36 cut, room for 30
    ([4, 4], [1, 1], [8, 8]),                                   # no room left
])
def test_what_limits_cut_off_goes_to_other_shards(spark, shards, quotas, want):
    parts = spark.createDataFrame([("k", i, s, q) for i, (s, q) in enumerate(zip(shards, quotas))], "_key string, _shard long, _shard_size long, quota long")
    got = {r["_shard"]: r["_give"] for r in mixing._reshared(parts, 2, 16).collect()}
    total = min(16 * sum(quotas), 2 * sum(shards))
    assert sum(got.values()) == total and all(got[i] <= 2 * s for i, s in enumerate(shards))
    assert [got[i] for i in range(len(shards))] == want


def sainte_lague(votes, seats):
    won = {p: 0 for p in votes}
    for _ in range(seats):
        best = min(votes, key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return won


@pytest.mark.parametrize("votes, seats", [
    ({1: 100.0, 2: 50.0, 3: 1.0}, 15), ({1: 10.0, 2: 10.0, 3: 10.0}, 7), ({1: 1000.0, **{i: 1.0 for i in range(2, 40)}}, 25),
    ({1: 0.0, 2: 5.0}, 3), ({1: 7.0}, 4), ({1: 3.0, 2: 2.0}, 0)])
def test_apportionment_by_highest_quotients(spark, votes, seats):
    parties = spark.createDataFrame([(0, p, v, seats) for p, v in votes.items()], "g int, party int, votes double, seats long")
    got = {r["party"]: r["quota"] for r in mixing.apportion(parties, ["g"], "votes", "seats", "party").collect()}
    assert got == sainte_lague(votes, seats)


def test_plan_is_native(spark):
    plan = op3_mixing(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
