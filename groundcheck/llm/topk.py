"""Exact top-k search by tiled matrix products.

The project keeps no vectors of its own, so the operator is general: any table with an id and a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage

_TOP = "array<struct<neg:bigint,id:bigint>>"
_LONG = 2**63 - 1


def _prepared(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    x = F.col(vector)
    wide = F.transform(x, lambda v: v.cast("double"))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.filter(F.col(key).isNotNull() & x.isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), F.transform(wide, lambda v: F.floor(v * scale)).alias("x"))


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros."""
    column = table.column("x").combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else by Python integers held to a long."""
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    bound = width * float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0))
    if bound < 2**52:
        return q.astype(np.float64) @ c.astype(np.float64).T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -_LONG + 1, _LONG)


def _tile(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], _matrix(rows)[order]
        q, own, number = _matrix(queries), queries.column("id").to_numpy(), queries.column("query").to_numpy()
        neg, best, ends, found = [], [], [0], []
        for a in range(0, len(q) if len(ids) else 0, 256):
            scores = _products(q[a:a + 256], c)
            for i, row in enumerate(scores):
                keep = np.flatnonzero(ids != own[a + i])
                row = row[keep]
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    at = np.flatnonzero(row >= least)
                    keep, row = keep[at], row[at]
                # candidates are in the order of their ids, so equal scores keep the smaller id first
                at = np.argsort(-row, kind="stable")[:k]
                neg += [-int(s) for s in row[at]]
                best += ids[keep[at]].tolist()
                ends.append(len(neg))
                found.append(a + i)
        shard = rows.column("shard")[0].as_py() if len(ids) else 0
        top = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(neg, pa.int64()), pa.array(best, pa.int64())], ["neg", "id"]))
        return pa.table({"query": pa.array(number[found], pa.int64()), "query_id": pa.array(own[found], pa.int64()),
                         "part": pa.array([shard] * len(found), pa.int64()), "top": top})

    return run


def top_matches(queries: DataFrame, vectors: DataFrame, key: str = "item_id", vector: str = "vector", k: int = 20,
                scale: int = 64, query_block: int = 2048, shard_rows: int = 16384, fan_in: int = 16) -> DataFrame:
    """The ``k`` vectors of highest integer inner product for every query, exactly.

    Components count as ``floor(scale * x)``.  Queries are cut in blocks and vectors in shards of bounded
    size; each pair of block and shard is one tile, whose product is taken by matrix multiplication and
    reduced to ``k`` rows per query before it leaves the task.  The lists of a query's tiles are merged
    as a tree, ``fan_in`` at a time.

    Returns ``query_id, rank (from 1), match_id, score``; equal scores go to the smaller ``match_id``.

    * rows with a null key, a null vector, or a null, infinite or NaN component take no part;
    * vectors of other lengths count as filled with zeros; an empty vector scores 0;
    * a query's own key is never its match; of rows that repeat a key each is a query and a candidate;
    * fewer than ``k`` candidates give fewer rows, empty tables none; scores are held to the long range.
    """
    q = cut_lineage(_prepared(queries, key, vector, scale))
    c = cut_lineage(_prepared(vectors, key, vector, scale))
    blocks = max(1, -(-q.count() // query_block))
    shards = max(1, -(-c.count() // shard_rows))
    # row numbers of a stored table: even, whatever keys repeat
    q = q.withColumn("query", F.monotonically_increasing_id()).select(
        "id", "x", "query", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    c = c.withColumn("row", F.monotonically_increasing_id()).select(
        "id", "x", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    tops = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInArrow(
        _tile(k), f"query long, query_id long, part long, top {_TOP}")
    parts = shards
    while parts > 1:
        parts = -(-parts // fan_in)
        tops = (tops.groupBy("query", "query_id", F.floor(F.col("part") / fan_in).alias("part"))
                .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
    return tops.select("query_id", F.posexplode("top").alias("at", "m")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("m.id").alias("match_id"),
        (-F.col("m.neg")).alias("score"))
