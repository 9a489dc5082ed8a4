"""Language-model scoring with an Elias-Fano n-gram trie of words and word pairs.

Tokens are 64-bit hashes of words, made by Spark. Each task sorts and adds up the pairs of some two million tokens at a time and packs
them by shard; a shard is a range of context hashes, so that its contexts' counts are whole, and one shuffle brings its packs together.
Contexts that a sample shows to be hot are cut once more by ranges of the successor's hash. Words are numbered by the order of their
hashes. The first level holds per word its hash, count and quantised backoff weight; the second level holds, per shard, the pointers of
its contexts and the successors' numbers, made monotone by a running base per context, both as Elias-Fano sequences, and the discounted
probabilities as 16-bit codes on a log scale. Files are memory-mapped by the scoring tasks, opened when first asked for, so they stay in
the page cache; a lookup searches the successors of its context only.

p(w | u) = (c(u,w) - D)/c(u) + D T(u)/c(u) p(w), p(w) = (c(w) + 0.1)/(N + 0.1 (V + 1)); a text starts in the end token's context.

Words are equal where their 64-bit hashes are. Null or empty text: one end token. Repeated rows count and score each. An empty training
set gives the uniform p over one unknown. Other columns of the documents take no part.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import ascii_lower, posix, shared_dir, words

DISCOUNT = 0.75
ADD = 0.1
END = "\n"  # never a word, since words hold no white space
#: Codes of the quantiser cover log10 values from -LOG_RANGE to 0.
LOG_RANGE = 12.0
SHARDS = 8
SHARD_BYTES = 16 << 20
BATCH_TOKENS = 2_000_000
SAMPLE_DOCS = 10_000
CHUNK = 1 << 18
OPEN_FILES = 4096
_ONES = np.array([[i for i in range(8) if b >> i & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)
_U, _BYTES = np.uint64, np.uint64(0x0101010101010101)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(np.maximum(p, 1e-300)) / LOG_RANGE, 0, 1) * 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-LOG_RANGE * code.astype(np.float64) / 65535)


class EliasFano:
    """A monotone sequence: low bits as they are, high parts in unary with a running count of ones per byte."""

    def __init__(self, n: int, bits: int, low, high, ones):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.words = high.view(np.uint64)

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        n, top = len(x), int(x[-1]) + 1 if len(x) else 1
        bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
        low = (x & ((1 << bits) - 1)).astype(kind)
        at = (x >> bits) + np.arange(n)
        flags = np.zeros(-(-(int(at[-1]) + 1 if n else 1) // 64) * 64, np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little")
        per = np.bitwise_count(high).reshape(-1, 8).sum(1)
        ones = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
        return cls(n, bits, low, high, ones)

    def save(self, stem: str) -> None:
        for part in ("low", "high", "ones"):
            save(f"{stem}.{part}.npy", getattr(self, part))

    @classmethod
    def open(cls, stem: str, n: int, bits: int) -> EliasFano:
        return cls(n, bits, *(mapped(f"{stem}.{p}.npy") for p in ("low", "high", "ones")))

    def _select(self, words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th one within 64-bit words, through the running counts of their bytes."""
        per = np.bitwise_count(words.view(np.uint8)).view(np.uint64) * _BYTES
        r = r.astype(np.uint64)
        byte = np.bitwise_count(((r * _BYTES | _BYTES << _U(7)) - per) & _BYTES << _U(7)).astype(np.uint64)
        left = r - (((per << _U(8)) >> (byte << _U(3))) & _U(255))
        return (byte << _U(3)).astype(np.int64) + _ONES[((words >> (byte << _U(3))) & _U(255)).astype(np.int64), left.astype(np.int64)]

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + self._select(self.words[word], i - self.ones[word])
        return ((at - i) << self.bits) | self.low[i].astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero."""
        lo, hi = np.zeros(len(k), np.int64), np.full(len(k), len(self.ones), np.int64)
        while (hi - lo > 1).any():  # zeros before a word are 64 times its number, less the ones before it
            mid = (lo + hi) >> 1
            less = mid * 64 - self.ones[mid] <= k
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return lo * 64 + self._select(~self.words[lo], k - (lo * 64 - self.ones[lo]))

    def find(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of value in [lo, hi), or -1: the zeros around its high part bound the few candidates, whose low bits are searched."""
        found = np.full(len(value), -1, np.int64)
        if not self.n:
            return found
        last = int(self.get(np.array([self.n - 1]))[0]) >> self.bits
        ok = np.flatnonzero((lo < hi) & (value >= 0) & (value >> self.bits <= last))
        value, high = value[ok], value[ok] >> self.bits
        lo = np.maximum(lo[ok], np.where(high > 0, self._zero(np.maximum(high, 1) - 1) + 1 - high, 0))
        hi = end = np.minimum(hi[ok], np.where(high < last, self._zero(np.minimum(high, max(last - 1, 0))) - high, self.n))
        low = value & ((1 << self.bits) - 1)
        while len(more := np.flatnonzero(lo < hi)):
            mid = (lo[more] + hi[more]) >> 1
            less = self.low[mid].astype(np.int64) < low[more]
            lo[more[less]] = mid[less] + 1
            hi = hi.copy() if hi is end else hi
            hi[more[~less]] = mid[~less]
        here = np.flatnonzero(lo < end)
        hit = here[self.low[lo[here]].astype(np.int64) == low[here]]
        found[ok[hit]] = lo[hit]
        return found


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def hashes(text):
    """array<long>: the hashes of a text's tokens, ending with the end token's."""
    return F.transform(F.concat(words(ascii_lower(text)), F.array(F.lit(END))), lambda w: F.xxhash64(w))


def end_hash() -> np.uint64:
    import xxhash

    return _U(xxhash.xxh64_intdigest(END, 42))


def part(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of unsigned 64-bit values holds h."""
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


class Layout:
    """Shards of pairs: `shards` ranges of contexts, then the pieces of every hot context."""

    def __init__(self, shards: int, hot: dict[int, int]):
        self.shards = shards
        self.hot = np.array(sorted(hot), np.uint64)
        self.pieces = np.array([hot[int(h)] for h in self.hot], np.int64)
        self.first = shards + np.cumsum(self.pieces) - self.pieces
        self.count = shards + int(self.pieces.sum())

    def place(self, h: np.ndarray):
        """Index among the hot ones, -1 for others."""
        if not len(self.hot):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        return np.where(self.hot[at] == h, at, -1)

    def shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at = self.place(u)
        out = part(u, self.shards)
        k = np.flatnonzero(at >= 0)
        out[k] = self.first[at[k]] + ((w[k] >> _U(32)) * self.pieces[at[k]].astype(np.uint64) >> _U(32)).astype(np.int64)
        return out


def layout(texts: DataFrame) -> Layout:
    """Shards by the bytes of the texts; hot contexts from a hashed sample, which moves work and never a result."""
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(SHARDS, size // SHARD_BYTES + 1)
    some = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows))) < SAMPLE_DOCS)
    counts = some.select(F.explode(hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 1
    hot = counts.where((F.col("n") >= 100) & (F.col("n") * 2 * shards > total)).collect()
    return Layout(shards, {r["h"] % (1 << 64): 2 * r["n"] * shards // total + 1 for r in hot})


def runs(u: np.ndarray, w: np.ndarray, n: np.ndarray):
    """Equal pairs added up, sorted by (u, w)."""
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])) if len(u) else np.zeros(0, np.int64)
    return u[new], w[new], np.add.reduceat(n, new) if len(u) else n


def pack(u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[int, bytes]:
    """Sorted pairs as one compressed block: contexts, their run lengths, successors, counts."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    raw = np.array([len(u), len(first)], np.int64).tobytes() + u[first].tobytes() + w.tobytes() + np.diff(np.append(first, len(u))).astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, data: bytes):
    raw = pa.decompress(data, size, codec="zstd", asbytes=True)
    pairs, contexts = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = 16
    u = np.frombuffer(raw, np.uint64, contexts, at)
    w = np.frombuffer(raw, np.uint64, pairs, at := at + 8 * contexts)
    length = np.frombuffer(raw, np.uint32, contexts, at := at + 8 * pairs)
    return np.repeat(u, length), w, np.frombuffer(raw, np.uint32, pairs, at + 4 * contexts).astype(np.int64)


def packed_pairs(texts: DataFrame, plan: Layout) -> DataFrame:
    """shard, size, data: the pairs of each task, added up over BATCH_TOKENS tokens and packed by shard."""

    def run(batches):
        end, held, count = end_hash(), [], 0

        def add():
            u, w = (np.concatenate([p[i] for p in held]) for i in (0, 1))
            u, w, n = runs(u, w, np.ones(len(u), np.int64))
            shard = plan.shard(u, w)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(plan.count + 1))
            for s in np.flatnonzero(np.diff(cut)):
                at = order[cut[s] : cut[s + 1]]
                size, data = pack(u[at], w[at], n[at])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "size": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

        for b in batches:
            hs = b.column("h")
            flat, at = hs.flatten().to_numpy().view(np.uint64), hs.offsets.to_numpy()
            at = at - at[0]
            before = np.concatenate([[end], flat[:-1]]).astype(np.uint64)
            before[at[:-1]] = end
            for lo in range(0, len(flat), BATCH_TOKENS):
                held.append((before[lo : lo + BATCH_TOKENS], flat[lo : lo + BATCH_TOKENS]))
                count += len(held[-1][0])
                if count >= BATCH_TOKENS:
                    yield from add()
                    held, count = [], 0
        if held:
            yield from add()

    return texts.select(hashes(F.col("text")).alias("h")).mapInArrow(run, "shard int, size long, data binary")


def save(path: str, x: np.ndarray) -> None:
    """Through a name of its own, so that a repeated task never leaves half a file."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "wb") as f:
        np.save(f, x)
    os.replace(tmp, path)


def _write_shards(root: str, plan: Layout, discount: float):
    """The pairs of each shard, and the first level of the words of its range; one row of description per shard."""

    def close(s, blocks):
        u, w, n = runs(*(np.concatenate(x) for x in zip(*blocks)))
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        c, t = np.add.reduceat(n, first), np.diff(np.append(first, len(u)))
        save(f"{root}/p{s}.w.npy", w)
        save(f"{root}/p{s}.n.npy", n)
        save(f"{root}/p{s}.t.npy", t)
        if s < plan.shards:
            for name, x in (("hash", u[first]), ("count", c), ("gamma", quantise(discount * t / c))):
                save(f"{root}/v{s}.{name}.npy", x)
        row = {"shard": [s], "contexts": [len(first)], "pairs": [len(u)], "count": [int(c.sum())]}
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in row.items()})

    def run(batches):
        held, blocks = None, []
        for b in batches:
            for s, size, data in zip(*(b.column(c).to_pylist() for c in ("shard", "size", "data"))):
                if s != held:
                    if blocks:
                        yield close(held, blocks)
                    held, blocks = s, []
                blocks.append(unpack(size, data))
        if blocks:
            yield close(held, blocks)

    return run


@functools.lru_cache(OPEN_FILES)
def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


class Vocabulary:
    """The first level: one part per range of hashes, memory-mapped, and the few hot words."""

    def __init__(self, root: str, meta: dict):
        self.root, self.plan, self.base, self.size = root, meta["plan"], np.array(meta["base"], np.int64), np.array(meta["size"], np.int64)
        self.hot_base, self.hot_count, self.hot_gamma = meta["distinct"] - len(self.plan.hot), np.array(meta["hot_count"], np.int64), np.array(meta["hot_gamma"])

    def look(self, h: np.ndarray):
        """ids (-1 if unknown), counts, backoff weights."""
        ids, n, g = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.ones(len(h))
        which = part(h, self.plan.shards)
        for k in np.unique(which):
            if not self.size[k]:
                continue
            hs, ns, gs = (mapped(f"{self.root}/v{k}.{x}.npy") for x in ("hash", "count", "gamma"))
            at = np.flatnonzero(which == k)
            i = np.minimum(np.searchsorted(hs, h[at]), len(hs) - 1)
            ok = hs[i] == h[at]
            at, i = at[ok], i[ok]
            ids[at], n[at], g[at] = i + self.base[k], ns[i], restore(gs[i])
        hot = self.plan.place(h)
        at = np.flatnonzero(hot >= 0)
        ids[at], n[at], g[at] = self.hot_base + hot[at], self.hot_count[hot[at]], self.hot_gamma[hot[at]]
        return ids, n, g


class Trie:
    def __init__(self, root: str, meta: dict):
        self.root, self.meta, self.plan, self.words = root, meta, meta["plan"], Vocabulary(root, meta)
        self.total, self.distinct = meta["total"], meta["distinct"]

    def unigram(self, n: np.ndarray) -> np.ndarray:
        return (n + ADD) / (self.total + ADD * (self.distinct + 1))

    def bigram(self, hu: np.ndarray, hw: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The discounted part for pairs, given as hashes and as ids; 0 where unseen."""
        out = np.zeros(len(u))
        which = np.where((u >= 0) & (w >= 0), self.plan.shard(hu, hw), -1)
        for k in np.unique(which[which >= 0]):
            s = self.meta["shards"].get(int(k))
            if s is None:
                continue
            at = np.flatnonzero(which == k)
            ptr, suc = (EliasFano.open(f"{self.root}/s{k}.{x}", n, bits) for x, n, bits in (("ptr", s["contexts"] + 1, s["ptr_bits"]), ("suc", s["n"], s["suc_bits"])))
            prob = mapped(f"{self.root}/s{k}.prob.npy")
            ctx = u[at] - s["u0"]
            each, back = np.unique(ctx, return_inverse=True)
            i = suc.find(ctx * self.distinct + w[at], ptr.get(each)[back], ptr.get(each + 1)[back])
            out[at[i >= 0]] = restore(prob[i[i >= 0]])
        return out


def _write_level(root: str, meta: dict, discount: float):
    """The second level of each shard, from its pairs and the numbers of the words."""

    def run(batches):
        known = Vocabulary(root, meta)
        for b in batches:
            for s in b.column("shard").to_pylist():
                w, n, t = (np.load(f"{root}/p{s}.{x}.npy") for x in "wnt")
                hot = s - meta["plan"].shards
                if hot < 0:
                    u0, c = meta["base"][s], np.add.reduceat(n, np.cumsum(t) - t)
                else:
                    i = int(np.searchsorted(meta["plan"].first, s, "right")) - 1
                    u0, c = known.hot_base + i, np.array([meta["hot_count"][i]])
                ctx = np.repeat(np.arange(len(t)), t)
                key = ctx * meta["distinct"] + known.look(w)[0]
                order = np.argsort(key, kind="stable")
                ptr, suc = EliasFano.build(np.concatenate([[0], np.cumsum(t)])), EliasFano.build(key[order])
                for name, e in (("ptr", ptr), ("suc", suc)):
                    e.save(f"{root}/s{s}.{name}")
                save(f"{root}/s{s}.prob.npy", quantise(((n - discount) / c[ctx])[order]))
                row = {"shard": s, "n": len(w), "u0": u0, "contexts": len(t), "ptr_bits": ptr.bits, "suc_bits": suc.bits}
                yield pa.RecordBatch.from_pydict({k: pa.array([int(v)], pa.int64()) for k, v in row.items()})

    return run


def build(texts: DataFrame, discount: float = DISCOUNT) -> tuple[str, dict]:
    """Write both levels under the shared folder from doc_id and text; returns the folder and the small description of its shards."""
    spark = texts.sparkSession
    plan = layout(texts)
    root = posix(shared_dir(spark))
    os.makedirs(root, exist_ok=True)
    packs = packed_pairs(texts, plan).repartition(plan.count, "shard").sortWithinPartitions("shard")
    made = packs.mapInArrow(_write_shards(root, plan, discount), "shard long, contexts long, pairs long, count long").collect()
    rows = {r["shard"]: r for r in made}
    size = [rows[s]["contexts"] if s in rows else 0 for s in range(plan.shards)]
    at = [range(f, f + p) for f, p in zip(plan.first.tolist(), plan.pieces.tolist())]
    hot_count = [sum(rows[s]["count"] for s in r if s in rows) for r in at]
    hot_types = [sum(rows[s]["pairs"] for s in r if s in rows) for r in at]
    meta = {
        "plan": plan, "size": size, "base": (np.cumsum(size) - np.array(size)).tolist(),
        "distinct": sum(size) + len(at), "total": sum(r["count"] for r in made), "hot_count": hot_count,
        "hot_gamma": [discount * t / c for t, c in zip(hot_types, hot_count)],
    }
    names = spark.createDataFrame([(s,) for s in sorted(rows)], "shard long").repartition(max(1, len(rows)))
    level = names.mapInArrow(_write_level(root, meta, discount), "shard long, n long, u0 long, contexts long, ptr_bits long, suc_bits long")
    meta["shards"] = {r["shard"]: r.asDict() for r in level.collect()}
    for s in rows:
        for x in "wnt":
            os.remove(f"{root}/p{s}.{x}.npy")
    return root, meta


def score_tokens(hs: np.ndarray, at: np.ndarray, trie: Trie) -> dict:
    """n_known, base_score, score per text; `at` bounds the texts in hs. CHUNK tokens are looked up together."""
    n = len(at) - 1
    end, text = end_hash(), np.repeat(np.arange(n), np.diff(at))
    before = np.concatenate([[end], hs[:-1]]).astype(np.uint64)
    before[at[:-1]] = end
    n_known, base, score = (np.zeros(n) for _ in range(3))
    for lo in range(0, len(hs), CHUNK):
        a, b, of = before[lo : lo + CHUNK], hs[lo : lo + CHUNK], text[lo : lo + CHUNK]
        each, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        ids, c, g = trie.words.look(each)
        ia, ib = inv[: len(a)], inv[len(a) :]
        pairs, back = np.unique(ia * len(each) + ib, return_inverse=True)
        x, y = pairs // len(each), pairs % len(each)
        one = trie.unigram(c)
        p = (trie.bigram(each[x], each[y], ids[x], ids[y]) + g[x] * one[y])[back]
        for total, value in ((n_known, c[ib] > 0), (base, np.log10(one[ib])), (score, np.log10(p))):
            total += np.bincount(of, value, n)
    return {"n_known": n_known.astype(np.int64), "base_score": base, "score": score}


def score_documents(docs: DataFrame, train=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; `train` is a condition, else not held out."""
    training = docs.where(~held_out() if train is None else train).select("doc_id", "text")
    root, meta = build(training)

    def run(batches):
        trie = Trie(root, meta)
        for b in batches:
            hs = b.column("h")
            at = hs.offsets.to_numpy().astype(np.int64)
            out = score_tokens(hs.flatten().to_numpy().view(np.uint64), at - at[0], trie)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[c]) for c in ("n_known", "base_score", "score")), pa.array(np.diff(at))], ["doc_id", "n_known", "base_score", "score", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", hashes(F.col("text")).alias("h"))
    scored = tokens.mapInArrow(run, f"doc_id {kind}, n_known long, base_score double, score double, n_tokens long")
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(meta["total"]).cast("long").alias("train_tokens"), "base_score", "score")
