"""Exact top-k by integer inner product: tiled matrix products.

Vectors are packed, where they lie, into shards: rows that hold a matrix of up to
``shard_rows`` vectors. Queries are packed the same way into blocks. Every (block, shard)
pair is a tile: one matrix product, a partial selection of the best k per query, and k
rows per query out. Per-query lists are then merged as a tree: within ``fan`` groups of
shards, then over the groups. Tiles meet in a join on (lot of blocks, salt): shards are
copied once per lot of ``block_rows`` queries, never per query, and the salt spreads a
lot's shards over tasks. A task works on one tile at a time.

Components are floor(256 * x), computed in double precision (beyond its range: the largest
double). The product runs in doubles
while every possible sum stays below 2^53 and in Python integers beyond (scores outside
the long range are clamped to it); either way ranks are exact. Vectors that are null or
hold null or non-finite components take no part; vectors are compared within their
length only. A vec_id with several rows counts once, with its least vector by array
order; rows without vec_id are left out. With fewer candidates than k all are returned;
an empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cardtrail.llm.common import map_batches

LARGEST = np.finfo(np.float64).max
PACKED = "block long, dim int, ids array<long>, matrix binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the vectors that take part, one per vec_id."""
    x = F.col("embedding").cast("array<double>")
    return (vectors.select("vec_id", x.alias("embedding"))
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Matrices of up to ``rows`` vectors of one length, from the rows of each task."""

    def run(batches):
        number = 0
        for pdf in batches:
            dims = pdf["embedding"].map(len)
            for dim, part in pdf.groupby(dims):
                for a in range(0, len(part), rows):
                    piece = part.iloc[a:a + rows]
                    with np.errstate(over="ignore"):
                        matrix = np.floor(np.stack(piece["embedding"].to_numpy()) * 256.0) if dim else np.zeros((len(piece), 0))
                    matrix = np.clip(matrix, -LARGEST, LARGEST)
                    yield pd.DataFrame({"block": [number], "dim": [int(dim)], "ids": [piece["vec_id"].to_numpy()],
                                        "matrix": [matrix.astype(np.float64).tobytes()]})
                    number += 1

    return map_batches(vectors, run, PACKED)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b, as long."""
    bound = a.shape[1] * (np.abs(a).max(initial=0) * np.abs(b).max(initial=0))
    if bound < 2.0 ** 52:
        return (a @ b.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    most = (1 << 63) - 1
    return np.array([[max(-most - 1, min(most, sum(x * y for x, y in zip(r, s)))) for s in exact[1]] for r in exact[0]], dtype=np.int64)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each row of ``scores``: partial selection, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    own = ids[None, :] == query_ids[:, None]
    kth = min(k + 1, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - kth, axis=1)[:, scores.shape[1] - kth]
    r, c = np.nonzero((scores >= least[:, None]) & ~own)
    by = np.lexsort((c, ~scores[r, c], r))
    r, c = r[by], c[by]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    rows, cols = r[nth < k], c[nth < k]
    return query_ids[rows], ids[cols], scores[rows, cols]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 2048,
               shard_rows: int = 2048, fan: int = 16, salts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best vectors of each query vector, the
    query's own id excepted."""
    candidates, asked = usable(vectors), usable(queries)
    lots = max(1, -(-asked.count() // block_rows))
    salts = salts or max(16, vectors.count() // (4 * shard_rows))  # a few shards of each lot in a task
    hashed = F.xxhash64("ids")
    shards = pack(candidates, shard_rows).select(
        "dim", F.col("ids").alias("c_ids"), F.col("matrix").alias("c_matrix"), hashed.alias("shard"),
        F.pmod(hashed, F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    blocks = pack(asked, block_rows).select(
        "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.pmod(hashed, F.lit(lots)).cast("int").alias("lot"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    tiles = shards.join(blocks.hint("shuffle_hash"), ["dim", "lot", "salt"])

    def product(batches):
        for pdf in batches:
            for dim, shard, c_ids, c_matrix, q_ids, q_matrix in zip(pdf["dim"], pdf["shard"], pdf["c_ids"], pdf["c_matrix"], pdf["q_ids"], pdf["q_matrix"]):
                q = np.frombuffer(q_matrix).reshape(-1, dim) if dim else np.zeros((len(q_ids), 0))
                c = np.frombuffer(c_matrix).reshape(-1, dim) if dim else np.zeros((len(c_ids), 0))
                query, vec, score = _best(np.asarray(q_ids), np.asarray(c_ids), _product(q, c), k)
                yield pd.DataFrame({"query_id": query, "vec_id": vec, "score": score, "part": np.full(len(query), shard % fan)})

    found = map_batches(tiles, product, "query_id long, vec_id long, score long, part long")
    order = [F.col("score").desc(), F.col("vec_id")]
    part = Window.partitionBy("query_id", "part").orderBy(*order)
    found = found.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
