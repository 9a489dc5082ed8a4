"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good (from `labels`). P(grade > k) = sigmoid(w.x - t_k) with shared weights w over hashed words and
ordered thresholds t_0 < t_1. The model is fitted on at most `sample` labelled rows, the first by a hash of doc_id (a documented
bound); scoring covers every document whole.

Null or empty text: features of zero, so the score follows from the thresholds. Labels that are null take no part in fitting; an empty set of
labels gives zero weights. A doc_id with several grades takes the least, one with several texts the first of them in fitting. Repeated
rows are scored each. Other columns take no part.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD_RE, ascii_lower

DIM = 1 << 15
SAMPLE = 4000
STEPS = 300
GRADES = 3
MIN_TAIL = 0.5


def features(text: str):
    """Indices and weights: words and single characters by log count, unit length."""
    idx, n = np.unique([zlib.crc32(w.encode()) % DIM for w in re.findall(WORD_RE, text) + [f" {c}" for c in set(text)]], return_counts=True)
    x = np.log1p(n.astype(np.float64))
    return idx.astype(np.int32), (x / (np.sqrt((x * x).sum()) or 1.0)) if len(x) else x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(rows, steps: int = STEPS, rate: float = 0.5, penalty: float = 1e-4):
    """Weights and thresholds by AdaGrad on the likelihood of P(grade) = P(> grade - 1) - P(> grade)."""
    w, t = np.zeros(DIM), np.array([-1.0, 1.0])
    if not rows:
        return w, t
    ix = np.concatenate([r[0] for r in rows]).astype(np.int64)
    xv = np.concatenate([r[1] for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    g = np.array([r[2] for r in rows])
    gw, gt = np.full(DIM, 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        z = np.bincount(at, xv * w[ix], len(rows))
        up = sigmoid(z[:, None] - t[None, :])
        edge = np.concatenate([np.ones((len(g), 1)), up, np.zeros((len(g), 1))], 1)
        slope = edge * (1 - edge)
        i = np.arange(len(g))
        p = np.maximum(edge[i, g] - edge[i, g + 1], 1e-9)
        dz = (slope[i, g] - slope[i, g + 1]) / p / len(g)
        dt = np.array([(np.where(g == k, slope[:, k + 1], 0) - np.where(g == k + 1, slope[:, k + 1], 0)) @ (1 / p) / len(g) for k in (0, 1)])
        dw = np.bincount(ix, xv * dz[at], DIM) - penalty * w
        gw, gt = gw + dw * dw, gt + dt * dt
        w, t = w + rate * dw / np.sqrt(gw), t + 0.1 * dt / np.sqrt(gt)
        t = np.array([t[0], max(t[1], t[0] + 1e-3)])
    return w, t


def graded(labels: DataFrame) -> DataFrame:
    ok = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return labels.where(ok).select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality").cast("int")).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE):
    one = grades.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = rows.select("grade", ascii_lower(F.coalesce("text", F.lit(""))).alias("t")).orderBy("t", "grade")

    def run(batches):
        for b in batches:
            f = [features(t) for t in b["t"]]
            yield pd.DataFrame({"i": [x[0] for x in f], "x": [x[1] for x in f], "grade": b["grade"].tolist()})

    got = rows.mapInPandas(run, "i array<int>, x array<double>, grade int").collect()
    return fit([(np.array(r["i"], np.int64), np.array(r["x"]), r["grade"]) for r in got])


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, expected_grade, p_top (tail probability of the best grade), selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lean = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("t"))

    @F.pandas_udf("low double, top double")
    def tails(text: pd.Series) -> pd.DataFrame:
        w, t = shared.value
        z = np.array([w[i] @ x for i, x in map(features, text)], np.float64)
        return pd.DataFrame({"low": sigmoid(z - t[0]), "top": sigmoid(z - t[1])})

    s = lean.withColumn("p", tails("t"))
    return s.select("doc_id", (F.col("p.low") + F.col("p.top")).alias("expected_grade"), F.col("p.top").alias("p_top"), (F.col("p.top") >= MIN_TAIL).alias("selected"))
