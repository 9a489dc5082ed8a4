"""Components of texts that op8 links by their fingerprints, or whose sets of word shingles have Jaccard similarity 0.8 or more.

SimHash counts repeats: texts that share most of their length are linked by fingerprints within 2 bits, though their sets may differ. But Jaccard 0.8
lies around 10 of 64 bits, which anchors can't carry, so sets are joined beside by a prefix filter: in one order of all shingles, two sets of Jaccard
0.8 share one of the first n - ceil(0.8 n) + 1 of each. Shingles that are frequent in a sample come last in that order, which changes the cost and
never the result.

Round 1 compares each text with the first holder of its prefix shingles, so a large group of copies collapses at linear cost. Round 2 compares the
pairs that share a prefix shingle early enough and are in one component neither by fingerprints nor by round 1. Every pair of these rounds is
confirmed by the exact Jaccard of the two sets (of 64-bit shingle hashes) before it is a link. Most candidates are no pairs, so marks of the sets
meet first, a bitmap each, and drop those that can't reach 0.8 whatever the texts are. Only then texts move to their pairs, not their sets,
which are larger; a text with many partners is dealt over tasks, and a shingle with many holders meets itself block by block.

Texts of the same words, ASCII case aside, are one node; wordless and null texts are one node.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import simhash
from quantloom.llm.common import SPACE_RE, WORD_RE, ascii_lower, forget, materialise, salted_left_join

SIZE = 5
SAMPLE_TEXTS = 2_500
#: So many shingles of the sample, the most frequent ones, have a place in the order; others count as rare.
ORDERED = 1_000_000
#: Holders of a shingle that meet in one task, and partners that one copy of a text meets.
BLOCK = 1_024
PARTNERS = 256
#: Bits of the largest bitmap of marks; larger sets only pass to the exact check more often.
MARKS = 1 << 15
#: Sampled shingles seen this often are moved behind the rare ones.
OFTEN = 3
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run."""
    import xxhash

    ws = re.findall(WORD_RE, text)
    if not ws:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    k = min(size, len(ws))
    m = len(ws) - k + 1
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out = out * PRIME + h[i : i + m]
    out = (out ^ (out >> np.uint64(29))) * MIX
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def plain(text: Column) -> Column:
    """The words of a text joined by a blank, A-Z in lower case; equal to what `words` gives, but in one pass, and fast for ASCII texts."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(ascii_lower(t))
    return F.trim(F.regexp_replace(low, SPACE_RE + "+", " "))


def with_node(docs: DataFrame) -> DataFrame:
    """docs plus node long, equal for texts of the same words."""
    return docs.withColumn("node", F.xxhash64(plain(F.col("text"))))


def frequent(texts: DataFrame, size: int = SIZE):
    """Sorted shingles that a bounded sample of the texts holds often, and their counts."""
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, n))) < SAMPLE_TEXTS).dropDuplicates(["node"])

    @F.pandas_udf("array<long>")
    def grams(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size) for t in text], dtype=object)

    seen = some.select(F.explode(grams("text")).alias("g")).groupBy("g").count().where(F.col("count") >= OFTEN)
    c = seen.orderBy(F.desc("count"), "g").limit(ORDERED).orderBy("g").toArrow()  # sorted by tasks, and no row of it is an object in the driver
    return c["g"].to_numpy(), c["count"].to_numpy()


def prefixes(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """token, node, n, at (place in the one order): a row per prefix shingle of each text; a task passes over the texts that it has just seen."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, size))

    def run(batches):
        often, counts = shared.value
        seen_nodes: set = set()
        for b in batches:
            tokens, nodes, sizes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for node, text in zip(b["node"], b["text"]):
                if node in seen_nodes:
                    continue
                seen_nodes.add(node)
                g = shingles(text, size)
                n = len(g)
                if not n:
                    continue
                seen = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    seen = np.where(often[at] == g, counts[at], 0)
                p = n - (4 * n + 4) // 5 + 1
                tokens.append(g[np.lexsort((g, seen))[:p]])
                nodes.append(np.full(p, node))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if len(seen_nodes) > 200_000:
                seen_nodes.clear()
            yield pd.DataFrame({"token": np.concatenate(tokens), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "at": np.concatenate(places)})

    return texts.mapInPandas(run, "token long, node long, n int, at int")


def shared(post: DataFrame) -> DataFrame:
    """The rows of shingles that several texts hold, plus lead: the first holder and its n. One shuffle by shingle."""
    w = Window.partitionBy("token")
    rows = post.withColumn("lead", F.min(F.struct("node", "n")).over(w)).withColumn("most", F.max("node").over(w))
    return rows.where(F.col("lead.node") != F.col("most")).drop("most").distinct()


def marks(g: np.ndarray) -> bytes:
    """A bitmap of at least four bits per shingle of a set, as far as MARKS allows; its size is a power of two."""
    m = min(MARKS, max(64, 1 << (4 * len(g) - 1).bit_length())) if len(g) else 64
    bits = np.zeros(m, np.uint8)
    bits[g.view(np.uint64) & np.uint64(m - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_reach(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """Whether sets of these marks and sizes can have Jaccard 0.8: each mark that the other set lacks is a shingle that it lacks."""
    k = min(len(a), len(b))
    x, y = (np.bitwise_or.reduce(np.frombuffer(s, np.uint8).reshape(-1, k)) for s in (a, b))
    common = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return 9 * common >= 4 * (n_a + n_b)


def marked(held: DataFrame, size: int = SIZE) -> DataFrame:
    """held plus n and marks of each text's set."""

    @F.pandas_udf("n int, marks binary")
    def of(text: pd.Series) -> pd.DataFrame:
        sets = (shingles(t, size) for t in text)
        return pd.DataFrame([(len(g), marks(g)) for g in sets], columns=["n", "marks"])

    return held.withColumn("of", of("text")).select(*held.columns, "of.*")


def met(pairs: DataFrame, held: DataFrame, *what: str) -> DataFrame:
    """u, v, and the columns `what` of both as c_u and c_v; what u holds is dealt over tasks if it has many partners."""
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).alias("deals"))
    dealt = salted_left_join(pairs, degree, ["u"], F.col("v")).select("u", "v", F.pmod(F.xxhash64("v"), "deals").alias("deal"))
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in what]]
    first = held.join(degree.withColumnRenamed("u", "node"), "node")
    first = first.select(*side("u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    return dealt.join(held.select(*side("v")), "v").join(first, ["u", "deal"]).drop("deal")


def possible(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (u, v) whose marks leave Jaccard 0.8 possible; held is node, n, marks."""

    def run(batches):
        for rows in batches:
            ok = np.fromiter(map(may_reach, rows["marks_u"], rows["n_u"], rows["marks_v"], rows["n_v"]), bool, len(rows))
            yield rows.loc[ok, ["u", "v"]]

    return met(pairs, held, "n", "marks").mapInPandas(run, "u long, v long")


def confirmed(pairs: DataFrame, held: DataFrame, size: int = SIZE) -> DataFrame:
    """The pairs (u, v) whose sets have Jaccard 0.8 or more; held is node, text. Only the texts of some pair are moved."""

    def run(batches):
        last, mine = None, None
        for rows in batches:
            ok = np.zeros(len(rows), bool)
            for i, (u, a, b) in enumerate(zip(rows["u"], rows["text_u"], rows["text_v"])):
                if u != last:
                    last, mine = u, shingles(a, size)
                other = shingles(b, size)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                ok[i] = 9 * common >= 4 * (len(mine) + len(other))
            yield rows.loc[ok, ["u", "v"]]

    return met(pairs, held, "text").mapInPandas(run, "u long, v long")


def linked(candidates: DataFrame, held: DataFrame, size: int = SIZE) -> DataFrame:
    """The candidates (u, v) that are links, written; held is node, text, n, marks."""
    pairs = materialise(candidates)
    left = materialise(possible(pairs, held))
    out = materialise(confirmed(left, held, size))
    forget(pairs), forget(left)
    return out


def fingerprint_links(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """u, v: op8's links of the texts, from equal fingerprints to the first of their texts, and between the first texts of fingerprints within `bits`."""

    @F.pandas_udf("long")
    def print_of(text: pd.Series) -> pd.Series:
        return pd.Series([simhash.fingerprint(t, size) for t in text], dtype="int64")

    fps = materialise(texts.select("node", print_of("text").alias("fp")).distinct())
    first = materialise(fps.groupBy("fp").agg(F.min("node").alias("first")))
    same = salted_left_join(fps, first, ["fp"], F.col("node")).where("first < node").select(F.col("first").alias("u"), F.col("node").alias("v"))
    a, b = first.select(F.col("fp").alias("u"), F.col("first").alias("x")), first.select(F.col("fp").alias("v"), F.col("first").alias("y"))
    near = simhash.links(first.select("fp"), bits).join(a, "u").join(b, "v").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    out = materialise(same.union(near))
    forget(fps), forget(first)
    return out


def first_candidates(post: DataFrame) -> DataFrame:
    """u, v: each text with the first holder of its prefix shingles."""
    sized = (5 * F.col("n") >= 4 * F.col("lead.n")) & (5 * F.col("lead.n") >= 4 * F.col("n"))
    held = post.where((F.col("lead.node") < F.col("node")) & sized)
    return held.select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct()


def other_candidates(post: DataFrame, comp: DataFrame) -> DataFrame:
    """u, v: pairs of different components that share prefix shingles, as far as place and count leave Jaccard 0.8 possible.

    The sets share nothing before their first common shingle, so at that place both must still hold enough; what stands behind the last
    such shingle bounds the rest.
    """
    named = salted_left_join(post.select("token", "node", "n", "at"), comp, ["node"], F.col("token")).withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("holders")).where("lo <> hi")
    mixed = mixed.select("token", F.ceil(F.col("holders") / BLOCK).alias("blocks"))
    named = materialise(salted_left_join(named, mixed, ["token"], F.col("node")).where("blocks is not null"))
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "root")]
    a, b = named.select("token", own.alias("i"), every.alias("j"), *side("u")), named.select("token", every.alias("i"), own.alias("j"), *side("v"))
    need, left = 4 * (F.col("n_u") + F.col("n_v")), lambda at: F.least(F.col("n_u") - F.col(f"{at}_u"), F.col("n_v") - F.col(f"{at}_v"))
    pairs = a.join(b, ["token", "i", "j"]).where((F.col("node_u") < F.col("node_v")) & (F.col("root_u") != F.col("root_v")) & (9 * left("at") >= need))
    found = pairs.groupBy("node_u", "node_v", "n_u", "n_v").agg(F.count("*").alias("c"), F.max("at_u").alias("last_u"), F.max("at_v").alias("last_v"))
    return found.where(9 * (F.col("c") + left("last") - 1) >= need).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))


def near_duplicates(docs: DataFrame, size: int = SIZE, bits: int = simhash.MAX_BITS) -> DataFrame:
    """docs plus node and root, equal for the rows of a component."""
    named = with_node(docs)
    texts = named.select("node", plain(F.col("text")).alias("text"))
    post = materialise(shared(prefixes(texts, size)))
    # Sets that reach Jaccard 0.8 share a prefix shingle, so only the texts in post can be linked.
    need = post.select("node").distinct()
    held = materialise(marked(texts.join(need, "node", "left_semi").dropDuplicates(["node"]), size), "zstd")
    alike = fingerprint_links(texts, size, bits)
    one = linked(first_candidates(post), held, size)
    two = linked(other_candidates(post, simhash.components(alike.union(one))), held, size)
    for table in (post, held):
        forget(table)
    comp = materialise(simhash.components(alike.union(one).union(two)))
    for table in (alike, one, two):
        forget(table)
    return salted_left_join(named, comp, ["node"], F.xxhash64("doc_id")).withColumn("root", F.coalesce("root", "node"))
