import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import apportion, block_ann, bpe_table, chat_format, line_dedup, lm_trie, ordinal, quality_rules, queries, simhash, warc_norm

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = ("a line that many documents share, word for word 123\n" * 3 + "tail ") * 40


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and a column with a clashing name."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 9), (3, LONG, "en", "a", 9), (None, "x y\nz", "en", None, 1)]
    rows += [(10 + i, "\t".join(["Shared words here"] * 20) + f"\n{'the same long boilerplate line of many documents'}", "en", "b", 5) for i in range(6)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts(spark, texts):
    got = by_id(queries.op2_line_rules(spark, SF))
    for doc_id, text, _ in texts:
        text = text or ""
        ws, at = WORD.findall(text), defaultdict(list)
        for i in range(len(ws) - 2):
            at[tuple(ws[i : i + 3])].append(i)
        hit = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws)) and not (r.base_failed and r.kept)


def test_lm_base_and_gain(spark, texts):
    got, train = by_id(queries.op1_lm_trie(spark, SF)), Counter()
    toks = {d: [w.translate(LOWER) for w in WORD.findall(t or "")] + ["\n"] for d, t, _ in texts}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in toks}
    pairs, types = Counter(), defaultdict(set)
    for d, ts in toks.items():
        if not held[d]:
            train.update(ts)
            for u, w in zip(["\n"] + ts, ts):
                pairs[u, w] += 1
                types[u].add(w)
    n, v = sum(train.values()), len(train)
    one = lambda w: (train[w] + 0.1) / (n + 0.1 * (v + 1))
    gain = 0.0
    for d, ts in toks.items():
        r = got[d]
        base = sum(math.log10(one(w)) for w in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ts), sum(train[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        full = 0.0
        for u, w in zip(["\n"] + ts, ts):
            p = one(w) if not train[u] else max(pairs[u, w] - 0.75, 0) / train[u] + 0.75 * len(types[u]) / train[u] * one(w)
            full += math.log10(p)
        assert r.score == pytest.approx(full, abs=1e-3 * len(ts))
        gain += (r.score - r.base_score) * held[d]
    assert gain > 0


def test_elias_fano():
    x = np.sort(np.random.default_rng(1).integers(0, 10**9, 5000))
    e = lm_trie.EliasFano.build(x)
    assert (e.get(np.arange(len(x))) == x).all()
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(x))
    assert (x[e.find(x, lo, hi)] == x).all() and e.find(np.array([-5]), lo[:1], hi[:1])[0] == -1


def test_chat_digests(spark):
    import duckdb

    turns = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall():
        turns[c].append((t, r, x or ""))
    turns[-7] = [(0, "user", chat_format.INJECTION), (1, "assistant", chat_format.INJECTION)]
    got = {r["conv_id"]: r for r in queries.op3_chat_prefix(spark, SF).collect()}
    assert got.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(x for _, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows) and got[c].loss_chars == len(loss)
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()


def test_chat_spans_and_escapes(spark):
    rows = [(1, 0, "user", "a <|end|> & b"), (1, 1, "assistant", "&lt;x<y"), (1, 70, "assistant", None), (None, None, None, None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat_format.chunks(conv).where("conv_id = 1").orderBy("chunk").collect()
    full = "".join(p["formatted"] for p in parts)
    spans = chat_format.examples(conv).orderBy("turn").collect()
    assert [chat_format.unescape(full[s.target_start : s.target_end]) for s in spans] == ["&lt;x<y", ""]
    assert chat_format.read_back(chat_format.chunks(conv)).count() == 2


@pytest.mark.parametrize("head", [bpe_table.HEAD_WORDS, 5, 0])
def test_bpe_equals_library(spark, texts, odd, head, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_table, "HEAD_WORDS", head)
    monkeypatch.setattr(bpe_table, "BLOCK_BYTES", 1 << 16)
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    extra = "Ünï<|endoftext|>don't  \x1c\x85 İΣ σ 12ab é ́x"
    marks = "we'll, 3.14, A.B. é,, x̸ ≮ a;̸ no<|endoftext|>. l'été!? 'S, ΑΣ. \u3000ab,\u3000c.\n.d, ñ.\x0b...,x"
    rows = [(d, t, "", "", 0) for d, t, _ in texts[:60]] + [(-1, extra, "", "", 0), (-2, None, "", "", 0), (-3, marks, "", "", 0), (-4, marks, "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    once = bpe_table.encode(df, path, keep_text=True, with_decoded=True)
    assert once.columns == [*df.columns, "ids", "decoded"]
    out = bpe_table.decode(once.withColumnRenamed("decoded", "first"), path)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.first == r.decoded == tok.decode(want, skip_special_tokens=False)
    clash = odd.withColumnRenamed("lang", "ids").withColumnRenamed("n_chars", "block")
    assert bpe_table.encode(clash, path).count() == odd.count()


def test_ordinal_accuracy(spark):
    import duckdb

    labels = {d: (q, t) for d, q, t in duckdb.sql(f"select * from '/root/testdata/sf0.01/labels.parquet'").fetchall()}
    sf = "/root/testdata/sf0.01"
    docs, grades = queries.read(spark, sf, "documents"), ordinal.graded(queries.read(spark, sf, "labels"))
    model = ordinal.train(docs, grades.where("doc_id % 3 <> 0"))
    rows = [(r.expected_grade, labels[r.doc_id]) for r in ordinal.score(docs, model).collect() if r.doc_id in labels and r.doc_id % 3 == 0]
    good, bad = [s for s, l in rows if l == (1, 0)], [s for s, l in rows if l != (1, 0)]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert model[1][0] < model[1][1] and auc > 0.8, auc


def test_warc_edges(spark):
    big = "é" * 80
    rows = [(3, "u", big), (1, "u\nx", big), (2, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", "a\r\n\r\nb" * 30)]
    got = {r.page_id: r for r in warc_norm.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[3].payload_bytes == 160 and got[1].record_type == "response"
    assert got[5].record_type == "response" and got[2].payload_bytes == 0 and got[6].payload_bytes == 180
    assert got[3].payload_digest == hashlib.sha256(big.encode()).hexdigest()


def test_line_dedup_brute(spark, odd):
    got = line_dedup.drop_shared_lines(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None and 10 <= r.doc_id < 15:
            assert r.n_dropped == 2 and r.kept_text == ""
        else:
            assert r.n_dropped == 0 and r.kept_text == (r.text or "")


def test_simhash_brute(spark, texts):
    import xxhash

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_anchor(spark, SF).collect()}
    fps = {}
    for d, t, _ in texts:
        ws = WORD.findall((t or "").translate(LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def test_simhash_links_complete(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 30)]
    vals = {0, -1}
    for x in base:
        vals.add(x)
        for _ in range(12):
            i, j = rng.integers(0, 63, 2)
            vals.add(x ^ (1 << int(i)) ^ (1 << int(j)))
    vals = sorted(vals)
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in vals], "fp long")).collect()}
    want = {(a, b) for i, b in enumerate(vals) for a in vals[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_mix_targets(spark, texts):
    rows = queries.op9_sainte_lague(spark, SF).collect()
    source = {d: s for d, _, s in texts}
    size = Counter()
    for r in rows:
        size[source[r.doc_id]] += r.size
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(size, key=lambda s: (s is None, s))
    left, weights, target = float(sum(size.values())), {s: 1 + i % 3 for i, s in enumerate(names)}, {}
    while weights:
        level = left / sum(weights.values())
        over = [s for s, w in weights.items() if level * w > 3 * size[s]]
        for s in over or list(weights):
            target[s] = float(3 * size[s]) if over else level * weights[s]
            if over:
                left -= target[s]
            del weights[s]
    taken = Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.03, abs=20)


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (20, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in block_ann.search(v.where("vec_id % 20 = 0"), v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 0.5)]


def test_odd_rows_everywhere(spark, odd):
    n = odd.count()
    assert quality_rules.judge(odd).count() == n and lm_trie.score_documents(odd).count() == n
    assert apportion.mix(odd).count() == n and simhash.near_duplicates(odd).count() == n
    assert quality_rules.clean(odd).columns == odd.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality_rules.judge(none).count() == 0 and line_dedup.drop_shared_lines(none).count() == 0
    assert lm_trie.score_documents(none).count() == 0 and apportion.mix(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    assert bpe_table.encode(none, queries.tokenizer_path()).count() == 0
    assert warc_norm.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_ann.search(v, v).count() == 0
    assert chat_format.read_back(chat_format.chunks(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    n = queries.read(spark, SF, "documents").count()
    assert 0.3 * n < out.count() <= n
