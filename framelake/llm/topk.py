"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become integers floor(scale * x). Candidates and queries are dealt into blocks of bounded size by hash; every
query block meets every candidate block once (a stated query set against all rows, in blocks). A block sorts its
candidates once per dimension. A query reads the lists it has a nonzero weight for from their better end, in growing
steps, scores what it meets for the first time, and stops as soon as no unseen candidate can reach its k-th score: the
bound is the score of an imaginary row made of the last values read. Each block gives k rows a query; a second
aggregation keeps the k best. Results are exact, ties go to the smaller id. ``scored`` tells how many candidates a query
scored: few where some components dominate, all where vectors spread evenly over many dimensions.

Defined cases: vectors that are null or hold a null or non-finite component take no part; of different lengths, the
missing components count as 0; a candidate with the query's own id is the query's own row; rows that repeat another id
are candidates of their own; fewer than k candidates give fewer rows; an empty table gives an empty result. Scores
must stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 1 << 13, 1 << 14


def best_in_block(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (ids, scores) of one query in one block and how many it scored. lists: per dimension, rows in ascending order of x."""
    n = len(x)
    seen = ids == own
    scored = 0
    dims = np.flatnonzero(q)
    best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
    up, down = dims[q[dims] < 0], dims[q[dims] > 0]
    depth, step = 0, max(8, n // 256)
    while depth < n:
        end = min(n, depth + step)
        if len(dims):
            met = np.zeros(n, bool)
            met[lists[up, depth:end].ravel()] = True
            met[lists[down, n - end : n - depth].ravel()] = True
            new = np.flatnonzero(met & ~seen)
        else:
            end, new = n, np.flatnonzero(~seen)
        seen[new] = True
        scored += len(new)
        s, i = x[new] @ q, ids[new]
        if len(best_s) == k:
            some = s >= best_s[-1]
            s, i = s[some], i[some]
        s, i = np.concatenate([best_s, s]), np.concatenate([best_i, i])
        order = np.lexsort((i, -s))[:k]
        best_s, best_i = s[order], i[order]
        if len(dims) and end < n and len(best_s) == k:
            last = np.empty(len(q))
            last[up], last[down] = x[lists[up, end - 1], up], x[lists[down, n - end], down]
            if best_s[-1] > last[dims] @ q[dims] or seen.all():
                break
        depth, step = end, step * 2
    return best_i, best_s, scored


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def _block(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            width = max(left["v"].map(len).max(), right["cv"].map(len).max())
            q, x = _matrix(left["v"], width), _matrix(right["cv"], width)
            ids = right["cid"].to_numpy()
            lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
            for own, row in zip(left["id"].to_numpy(), q, strict=True):
                i, s, scored = best_in_block(x, ids, lists, row, own, k)
                # a block's count goes with its first row, so that it is added once
                parts.append(pd.DataFrame({"query_id": own, "vec_id": i, "score": s.astype(np.int64), "scored": [scored, *[0] * (len(i) - 1)][: len(i)]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []})

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, candidates: int = CANDIDATES, queries: int = QUERIES, with_scored: bool = False) -> DataFrame:
    """Per query its k best other rows: query_id, rank, vec_id, score, and with_scored how many candidates the query scored."""
    v = F.col(f"`{vector_col}`")
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.filter(finite & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"), is_query.alias("q"))
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    cb, qb = max(1, -(-n // candidates)), max(1, -(-(m or 0) // queries))
    mine = lambda blocks, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.filter("q").select("id", "v", mine(qb, 1).alias("qb"), every(cb).alias("cb"))
    # the two sides must not share columns: they come from one table
    right = rows.select(F.col("id").alias("cid"), F.col("v").alias("cv"), mine(cb, 2).alias("right_cb"), every(qb).alias("right_qb"))
    parts = left.groupBy("qb", "cb").cogroup(right.groupBy("right_qb", "right_cb")).applyInPandas(_block(k), "query_id long, vec_id long, score long, scored long")
    mine_ = Window.partitionBy("query_id")
    if with_scored:
        parts = parts.withColumn("scored", F.sum("scored").over(mine_))
    rank = F.row_number().over(mine_.orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *(["scored"] if with_scored else []))
