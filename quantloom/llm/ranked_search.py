"""Ranked lexical search of all documents for each item of a query set, by best positions in impact lists.

Documents are tokenised once and kept as (doc_id, n, terms, counts) for the items' terms only; document frequencies are counted from that
table. Each task then builds shards of bounded size: a list of postings per term, highest impact first, and the same postings by document
for direct access. The Best Position Algorithm reads the lists of an item in steps. Every document met is looked up in all the item's lists
at once, which gives its whole score and marks its positions as seen; the best position of a list is the end of its unbroken run of seen
positions. No unseen document can score more than the sum of the impacts there, so a shard stops when its k-th score is above that sum
(equal is not enough, since ties go to the smaller doc_id). The shards' best k are merged by Spark, k rows an item and shard.

Items are dealt into blocks of at most about BLOCK_BYTES of terms, and each block passes over the documents, so what is broadcast is
bounded however many items there are.

Null and empty texts have no terms and count nowhere. Rows that repeat a doc_id are documents of their own; a null doc_id comes last among
equal scores. Rows of one item_id are one item of all their terms; an item without terms, or an empty table of documents, gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower, materialise

TOP = 50
BLOCK_BYTES = 32 << 20
#: A shard ends after so many postings, or so many documents.
SHARD_POSTINGS, SHARD_DOCS = 4_000_000, 200_000
#: Positions read of each list in the first step; each further step doubles the depth.
STEP = 64
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _byte(c: int) -> int:
    """Lower-case A-Z; digits, a-z and all bytes of characters beyond ASCII stay; the rest are blanks."""
    if 65 <= c <= 90:
        return c + 32
    return c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32


BYTES = bytes(map(_byte, range(256)))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each distinct term of an item once."""
    terms = F.explode(F.split(ascii_lower(F.col("text")), BREAKS)).alias("term")
    return items.select("item_id", terms).where("term <> ''").distinct()


def _lists(values: list[np.ndarray], dtype) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype), *values])))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms of the text), terms, counts: a row for each document with a term; only terms of the vocabulary are listed."""
    ids = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches):
        at = ids.value
        for b in batches:
            keep, size, terms, counts = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ws = tokens(text)
                if not ws:
                    continue
                c = Counter(ws)
                hit = [(at[w], n) for w, n in c.items() if w in at]
                keep.append(i), size.append(len(ws))
                terms.append(np.array([t for t, _ in hit], np.int32)), counts.append(np.array([n for _, n in hit], np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()).take(pa.array(keep, pa.int32())), pa.array(size, pa.int64()), _lists(terms, np.int32), _lists(counts, np.int32)],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Shard:
    """Impact lists of some documents, and the same postings by document. Slots number the documents by doc_id, null last."""

    def __init__(self, ids, n, sizes, terms, counts, weights, docs, length):
        order = np.lexsort((ids, ids == _NULL))  # _NULL stands for a null doc_id
        self.ids, place = ids[order], np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        m = 50 + (50 * n * docs) // length
        row = np.repeat(np.arange(len(ids)), sizes)
        tf = counts.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        slot = place[row]
        by = np.lexsort((slot, -impact, terms))
        self.docs, self.impacts = slot[by], impact[by]
        self.starts = np.searchsorted(terms[by], np.arange(len(weights) + 1))
        # By document: the place of each of its postings in the lists.
        back = np.argsort(self.docs, kind="stable")
        self.places, self.place_terms = back, terms[by][back]
        self.rows = np.searchsorted(self.docs[back], np.arange(len(ids) + 1))
        self.which = np.full(len(weights), -1, np.int64)
        self.seen_at = np.zeros(len(by), bool)
        self.seen = np.zeros(len(ids), bool)

    def direct(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings that the documents have in the item's lists, and which of the documents each belongs to."""
        lo, size = self.rows[new], self.rows[new + 1] - self.rows[new]
        owner = np.repeat(np.arange(len(new)), size)
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        ours = self.which[self.place_terms[flat]] >= 0
        return self.places[flat[ours]], owner[ours]

    def top(self, item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best slots for the item's terms, and their scores: highest first, then the smaller slot."""
        lo, hi = self.starts[item], self.starts[item + 1]
        item, lo, hi = item[hi > lo], lo[hi > lo], hi[hi > lo]
        best, found, scores, depth, step = lo.copy(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        self.which[item] = 0
        touched = []
        while True:
            read = [self.docs[a + depth : min(a + depth + step, b)] for a, b in zip(lo, hi) if a + depth < b]
            new = np.unique(np.concatenate(read)) if read else np.zeros(0, np.int64)
            new = new[~self.seen[new]]
            self.seen[new] = True
            places, owner = self.direct(new)
            self.seen_at[places] = True
            touched.append(places)
            # Sums stay below 2^53, so that they are exact in doubles.
            got = np.bincount(owner, self.impacts[places], len(new)).astype(np.int64)
            found, scores = np.concatenate([found, new]), np.concatenate([scores, got])
            order = np.lexsort((found, -scores))[:k]
            found, scores = found[order], scores[order]
            depth, step = depth + step, depth + step
            for i in range(len(item)):
                ahead = self.seen_at[best[i] : hi[i]]
                best[i] = hi[i] if ahead.all() else best[i] + int(ahead.argmin())
            open_ = best < hi
            bound = int(self.impacts[np.maximum(best[open_] - 1, lo[open_])].sum())
            if not open_.any() or (len(scores) == k and scores[-1] > bound):
                break
        self.which[item] = -1
        for places in touched:
            self.seen_at[places] = False
            self.seen[self.docs[places]] = False
        good = scores > 0
        return found[good], scores[good]


_NULL = np.iinfo(np.int64).min


def _shards(batches):
    """Rows of `postings`, gathered up to the bound of a shard."""
    held, rows, n = [], 0, 0
    for b in batches:
        held.append(b), (rows := rows + b.num_rows), (n := n + len(b.column("terms").flatten()))
        if n >= SHARD_POSTINGS or rows >= SHARD_DOCS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, n = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def best_documents(post: DataFrame, items: list[np.ndarray], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """item (number), doc_id, score: the k best of each shard, by best positions."""
    given = post.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = given.value
        for t in _shards(batches):
            ids = t.column("doc_id")
            flat = lambda c: np.concatenate([np.zeros(0, np.int32), *[x.flatten().to_numpy(zero_copy_only=False) for x in t.column(c).chunks]])
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in t.column("terms").chunks])
            shard = Shard(ids.fill_null(int(_NULL)).to_numpy(), t.column("n").to_numpy(), sizes, flat("terms"), flat("counts"), weights, docs, length)
            out = [shard.top(item, k) for item in items]
            who = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s, _ in out])
            slots = np.concatenate([s for s, _ in out])
            found = shard.ids[slots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(found, mask=found == _NULL), pa.array(np.concatenate([x for _, x in out]), pa.int64())], ["item", "doc_id", "score"]
            )

    return post.mapInArrow(run, "item int, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0."""
    spark = items.sparkSession
    pairs = materialise(item_terms(items))
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    parts = []
    for b in range(blocks):
        held = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select(F.col("item_id").cast("long"), "term").toArrow().to_pydict()
        ids = list(dict.fromkeys(held["item_id"]))
        number, vocabulary = {x: i for i, x in enumerate(ids)}, sorted(set(held["term"]))
        if not vocabulary:
            continue
        at = {t: i for i, t in enumerate(vocabulary)}
        terms: list[list[int]] = [[] for _ in ids]
        for x, t in zip(held["item_id"], held["term"]):
            terms[number[x]].append(at[t])
        post = materialise(postings(docs, vocabulary))
        n, length = post.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        counted = post.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()
        df[counted["t"].to_numpy()] = counted["count"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        best = best_documents(post, [np.array(sorted(t), np.int64) for t in terms], weights, n, length, k)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
