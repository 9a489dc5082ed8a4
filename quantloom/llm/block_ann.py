"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 by row; the stated query set is dealt in blocks against blocks of all rows. A tile's int8 product gives
every inner product with an error bound from the quantisation residuals; pairs whose upper bound reaches the k-th largest lower bound
are recomputed in double precision, and each tile hands on its k best per query from a heap.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different length are never compared.
Rows that repeat a vec_id are each candidates; a query never finds rows of its own id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
K = 20


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.coalesce((F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.where(F.col("vec_id").isNotNull() & ok).select("vec_id", v.cast("array<double>").alias("v"))


def quantise(x: np.ndarray):
    """int8 rows, scale, norm of the quantised row, norm of the residual."""
    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile(qid, q, cid, c, k):
    """The k best (query, candidate, score) per query within one tile."""
    qi, qs, qn, qe = quantise(q)
    ci, cs, cn, ce = quantise(c)
    kind = np.float32 if q.shape[1] <= 1024 else np.float64  # products of int8 add up exactly
    near = (qi.astype(kind) @ ci.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    slack = qn[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :]
    slack = slack * (1 + 1e-6) + 1e-6 * qn[:, None] * cn[None, :]
    own = qid[:, None] == cid[None, :]
    low = np.where(own, -np.inf, near - slack)
    high = np.where(own, -np.inf, near + slack)
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero((high[i] >= floor[i]) & ~own[i])
        exact = (c[alive] * q[i]).sum(1)
        for s, j in heapq.nsmallest(k, zip((-exact).tolist(), cid[alive].tolist())):
            out.append((int(qid[i]), j, -s))
    return out


def search(queries: DataFrame, rows: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and embedding."""
    q, c = usable(queries), usable(rows)
    nq, nc = (max(1, -(-d.count() // block_rows)) for d in (q, c))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt), F.hash("v")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", block(nq, 1)).withColumn("cb", every(nc))
    c = c.withColumn("cb", block(nc, 2)).withColumn("qb", every(nq))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            ld, rd = left["v"].map(len).to_numpy(), right["v"].map(len).to_numpy()
            for d in np.intersect1d(ld, rd):
                a, b = left[ld == d], right[rd == d]
                b_id, b_v = b["vec_id"].to_numpy(), np.stack(b["v"].to_numpy())
                for lo in range(0, len(a), 512):
                    s = a.iloc[lo : lo + 512]
                    found += tile(s["vec_id"].to_numpy(), np.stack(s["v"].to_numpy()), b_id, b_v, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    tiles = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
