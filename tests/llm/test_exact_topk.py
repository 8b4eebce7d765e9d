import duckdb
import numpy as np
from pyspark.sql import functions as F

from cardtrail.llm import exact_topk
from cardtrail.llm.queries import ORACLE_SQL, op8_exact_topk

from .helpers import SF001

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k):
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    out = set()
    for q in v:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])}
    return out


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.004]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-0.001, 1.0]), (50, [0.5, 0.5])]
    odd = [(4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("score", F.lit("clash")).withColumn("lot", F.lit("clash"))
    got = {tuple(r) for r in exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), k=3).collect()}
    assert got == brute(rows, 3)
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0
    only = spark.createDataFrame([(0, [1.0])], VECTORS)
    assert exact_topk.exact_topk(only, only).count() == 0


def test_ties_many_tiles_and_great_numbers(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 4)) / 256.0
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = {tuple(r) for r in exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), block_rows=3, shard_rows=16, salts=3, fan=4).collect()}
    assert got == brute(rows, 5)
    rows = [(0, [1e7, 1e7 + 1 / 256]), (1, [1e6, 1.0]), (2, [1e6, 1.0 + 1 / 256]), (3, [-1e6, 5.0])]
    df = spark.createDataFrame(rows, VECTORS)
    assert {tuple(r) for r in exact_topk.exact_topk(df, df.where("vec_id = 0")).collect()} == brute(rows, 5)


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF001}/embeddings.parquet'")
    assert {tuple(r) for r in op8_exact_topk(spark, SF001).collect()} == set(con.execute(ORACLE_SQL["op8_exact_topk"]).fetchall())


def test_components_beyond_the_range(spark):
    rows = [(0, [1.7e308, 1.0]), (1, [1.7e308, 0.0]), (2, [-1.7e308, 0.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r["vec_id"], r["score"]) for r in exact_topk.exact_topk(df, df.where("vec_id = 0"), k=3).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 65536), (2, -2**63)]
