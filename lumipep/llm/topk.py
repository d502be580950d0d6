"""Exact top-k search: tiles of queries and shards, partial selection in each tile, tree merge of the top lists.

Vectors are dealt to shards and queries to blocks by a row number, so equal vectors or ids never meet in one
place. A tile is one query block against one shard: an integer matrix product in the narrowest type that
holds it exactly. Only a tile's k best of each query leave it; the lists of FANOUT shards at a time are then
merged, level by level, each query's lists alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Most vectors in a shard and in a query block: what one tile holds in memory. Fewer in small inputs, to have tiles for all cores.
SHARD, BLOCK = 131_072, 16_384
LEAST, TILES_WANTED = 1024, 64
FANOUT = 16
LIST = "q_row long, query_id long, vec_id long, score long"


def quantised(df: DataFrame, scale: int, vector: str, id_col: str) -> DataFrame:
    """row, vec_id, v (array<bigint> of floor(scale * x)); without vectors that are null or hold null, NaN or infinite values."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    # The type of one component is enough to widen exactly: float to double.
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return df.filter(F.col(vector).isNotNull() & ~bad & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: in float32, float64 or Python integers, as the size of the values needs."""
    peak = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if peak < 2**24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if peak < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.asarray(a.astype(object) @ b.T.astype(object)).astype(np.int64)  # OverflowError beyond a long


def best_of_tile(q_row, q_id, q, s_id, s, k: int, rows: int = 256) -> dict[str, np.ndarray]:
    """Each query's k highest scores in this tile, ties to the smaller id; candidates with the query's own id are left out."""
    out = []
    for at in range(0, len(q), rows):
        qi, qid, qr = q[at : at + rows], q_id[at : at + rows], q_row[at : at + rows]
        scores = product(qi, s)
        own = qid[:, None] == s_id[None, :]
        scores[own] = np.iinfo(np.int64).min
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            i, j = np.nonzero((scores >= least[:, None]) & ~own)
        else:
            i, j = np.nonzero(~own)
        top = scores[i, j]
        order = np.lexsort((s_id[j], -top, i))
        i, j, top = i[order], j[order], top[order]
        first = np.r_[0, np.flatnonzero(np.diff(i)) + 1] if len(i) else np.zeros(0, int)
        nth = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        take = nth < k
        out.append((qr[i[take]], qid[i[take]], s_id[j[take]], top[take]))
    names = [c.split()[0] for c in LIST.split(", ")]
    return dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {n: np.zeros(0, np.int64) for n in names}


def exact_topk(
    df: DataFrame, k: int, is_query, scale: int = 256, vector: str = "embedding", id_col: str = "vec_id", shard: int = SHARD, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query row with all other vectors.

    is_query: a condition on id_col. Ties go to the smaller vec_id. Vectors or ids that are null, and vectors
    with null or non-finite components, take no part; an empty vector scores 0. Vectors are only compared with
    vectors of the same length. Rows that repeat an id are each candidates, never of a query with that id;
    repeated query rows each give their own list. Fewer candidates than k give shorter lists; no rows, none.
    """
    base = quantised(df, scale, vector, id_col)
    n = base.select(F.count(F.lit(1)).alias("n"), F.count_if(is_query(F.col("vec_id"))).alias("q")).first()
    size = min(shard, max(LEAST, math.ceil(n["n"] / TILES_WANTED)))
    shards, blocks = max(1, math.ceil(n["n"] / size)), max(1, math.ceil(n["q"] / block))
    deal = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    s = base.select("vec_id", "v", F.size("v").alias("dim"), deal(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = base.filter(is_query(F.col("vec_id"))).select("row", "vec_id", "v", F.size("v").alias("dim"), deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def tile(key, left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = lambda t, c: t[c].to_numpy().astype(np.int64)
        rows = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        found = best_of_tile(numbers(left, "row"), numbers(left, "vec_id"), rows(left), numbers(right, "vec_id"), rows(right), k) if left.num_rows and right.num_rows else best_of_tile(*[np.zeros(0, np.int64)] * 5, k)
        found = {**found, "shard": np.full(len(found["score"]), key[0].as_py(), np.int32)}
        return pa.table(found)

    lists = q.groupBy("shard", "block", "dim").cogroup(s.groupBy("shard", "block", "dim")).applyInArrow(tile, LIST + ", shard int")
    lists = stage(lists, "tiles")
    while True:
        shards = math.ceil(shards / FANOUT)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FANOUT).cast("int"))
        entry = F.struct((-F.col("score")).alias("neg"), F.col("vec_id").alias("vec_id"))
        merged = lists.groupBy("q_row", "query_id", "shard").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
        if shards <= 1:
            break
        lists = merged.select("q_row", "query_id", "shard", F.explode("top").alias("t")).select("q_row", "query_id", F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).alias("score"), "shard")
    return merged.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).alias("score"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), 5, lambda c: c % 50 == 0)


SQL = {
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op9_exact_topk": op9_exact_topk}
