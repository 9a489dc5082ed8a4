"""SimHash near-duplicates by anchor points of a covering code.

The anchors are the codewords of two [23,12] Golay codes laid over 46 of the 64 bits. The code is perfect with radius 3, so each half
has exactly one codeword within 3: a fingerprint's home is that pair. Fingerprints x and y that differ in at most 2 bits differ in e1
and e2 of the two halves with e1 + e2 <= 2, so y lies within 3 + e1 and 3 + e2 of the home of x. Every fingerprint is replicated to
those anchors, about 61, and is compared there with the fingerprints at home. No link is lost and nothing is capped.

Texts with equal fingerprints are one node. Components are found by alternating star contraction over the links, written to the
shared folder each round. Null or wordless text: fingerprint zero, linked like any other. Repeated rows share their component; a
null doc_id is never the smallest unless alone.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import WORD_RE, ascii_lower, forget, materialise, salted_left_join

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Fixed value: generator polynomial of the [23,12] Golay code.
GOLAY = 0b101011100011
HALF = (1 << 23) - 1
CHUNK = 1 << 16


def fingerprint(text: str, size: int = SHINGLE) -> int:
    import xxhash

    ws = re.findall(WORD_RE, text)
    if not ws:
        return 0
    grams = (" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))
    n, counts, buf = 0, np.zeros(64, np.int64), []

    def add():
        bits = np.unpackbits(np.array(buf, np.uint64).view(np.uint8).reshape(len(buf), 8), axis=1, bitorder="little")
        return bits.sum(0, dtype=np.int64)

    for g in grams:
        buf.append(xxhash.xxh64_intdigest(g, SEED))
        if len(buf) == CHUNK:
            counts, n, buf = counts + add(), n + len(buf), []
    if buf:
        counts, n = counts + add(), n + len(buf)
    value = int(sum(1 << b for b in range(64) if 2 * counts[b] > n))
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs plus fp long."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in text], dtype="int64")

    return docs.withColumn("fp", fp(ascii_lower(F.coalesce("text", F.lit("")))))


def codewords() -> np.ndarray:
    """The 4096 codewords, by shifting and adding the generator."""
    words = np.zeros(1, np.int64)
    for i in range(12):
        words = np.concatenate([words, words ^ (GOLAY << i)])
    return np.sort(words)


def near_codewords(part: np.ndarray, code: np.ndarray):
    """Per value of 23 bits: distances to all codewords."""
    return np.bitwise_count(part[:, None] ^ code[None, :]).astype(np.uint8)


def replicas(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """fp, anchor, home for every anchor within covering radius plus threshold."""

    def run(batches):
        code = codewords()
        for b in batches:
            for lo in range(0, len(b), 512):
                fp = b["fp"].to_numpy()[lo : lo + 512].astype(np.int64)
                d1, d2 = near_codewords(fp & HALF, code), near_codewords((fp >> 23) & HALF, code)
                e1, e2 = np.maximum(d1, 3) - 3, np.maximum(d2, 3) - 3
                r1, c1 = np.nonzero(e1 <= bits)
                r2, c2 = np.nonzero(e2 <= bits)
                starts, ends = np.searchsorted(r2, r1, "left"), np.searchsorted(r2, r1, "right")
                k = ends - starts
                left = np.repeat(np.arange(len(r1)), k)
                right = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts, k)
                x, y = e1[r1[left], c1[left]], e2[r2[right], c2[right]]
                ok = x + y <= bits
                left, right, home = left[ok], right[ok], (x + y == 0)[ok]
                yield pd.DataFrame({"fp": fp[r1[left]], "anchor": c1[left] * 4096 + c2[right], "home": home})

    return fps.select("fp").mapInPandas(run, "fp long, anchor int, home boolean")


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """u, v: pairs u < v of distinct fingerprints within `bits`."""
    reps = materialise(replicas(fps, bits))
    home, away = reps.where("home").select("anchor", F.col("fp").alias("v")), reps.select("anchor", F.col("fp").alias("u"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    pairs = away.join(home, (away["anchor"] == home["anchor"]) & (F.col("u") != F.col("v")) & near)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def settled(star: DataFrame) -> bool:
    """Whether edges (a, b), a > b, are stars: every a has one b, which is no a itself and so the smallest node reachable."""
    ends = star.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(star.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) of every node with an edge; edges are (u, v). The rounds end at the first stars, so none only confirms them."""
    star = materialise(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    for _ in range(max_rounds):
        if settled(star):
            break
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_left_join(both.where("b > a"), low, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct())
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_left_join(large, mins, ["a"], F.col("b"))
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(mins.select("a", F.col("m").alias("b")))
        new = materialise(new.where("a <> b").distinct())
        forget(star), forget(large)
        star = new
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).union(star.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    ids = materialise(fingerprints(docs.select("doc_id", "text"), size).select("doc_id", "fp"))
    fps = materialise(ids.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(links(fps, bits))
    of = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    out = of.join(least, "root").select("fp", "component_id")
    return salted_left_join(ids, out, ["fp"], F.col("doc_id"))
