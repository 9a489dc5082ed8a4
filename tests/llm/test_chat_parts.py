import hashlib

from pyspark.sql import functions as F

from quantloom.llm import chat_format

CONV = "conv_id long, turn long, role string, text string"


def test_loss_comes_from_spans(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a <b"), (None, 5, "assistant", "&c"), (2**53 + 1, None, "assistant", None)]
    parts = chat_format.chunks(spark.createDataFrame(rows, CONV))
    back = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    assert {c: (r.loss_chars, r.n_examples) for c, r in back.items()} == {1: (4, 1), None: (2, 1), 2**53 + 1: (0, 1)}
    bare = chat_format.read_back(parts.withColumn("spans", F.filter("spans", lambda x: F.lit(False)))).collect()
    assert all(r.loss_chars == 0 and r.loss_sha256 == hashlib.sha256().hexdigest() for r in bare)


def test_masked_examples(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"<{t}") for t in range(150)]
    got = chat_format.masked_examples(chat_format.chunks(spark.createDataFrame(rows, CONV))).collect()
    assert len(got) == 75
    for r in got:
        assert chat_format.unescape(r.input[r.mask_start : r.mask_end]) == f"<{r.turn}" and r.input.startswith("<|user|>&lt;0<|end|>")
        assert chat_format.TURN_RE.findall(r.input)[-1] == ("assistant", f"&lt;{r.turn}") and len(chat_format.TURN_RE.findall(r.input)) == r.turn + 1


def test_parts_stay_bounded(spark):
    rows = [(1, None, "assistant", "x" * 500 + str(i)) for i in range(3000)]
    parts = chat_format.chunks(spark.createDataFrame(rows, CONV))
    assert max(len(r.formatted) for r in parts.collect()) <= chat_format.PART_CHARS
    texts = sorted(r[3] for r in rows)
    (back,) = chat_format.read_back(parts).collect()
    assert back.n_turns == 3000 and back.loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()


def test_query_reads_its_examples(spark, monkeypatch):
    """Each example is a row with its context's length; op3's loss follows that length."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"<{t}" * 90) for t in range(200)]
    parts = chat_format.chunks(spark.createDataFrame(rows, CONV))
    out = [r for r in chat_format.expanded(parts).collect()]
    whole = "".join(r.formatted for r in out if r.formatted is not None)
    examples = [r for r in out if r.formatted is None]
    assert [r.turn for r in examples] == list(range(1, 200, 2)) and len(whole) > 2 * chat_format.PART_CHARS
    for r in examples:
        full = whole[: r.context_chars] + r.completion
        assert whole.startswith(full) and len(chat_format.TURN_RE.findall(whole[: r.context_chars])) == r.turn
        assert chat_format.unescape(full[r.mask_start : r.mask_end]) == f"<{r.turn}" * 90
    first = chat_format.read_back(parts).first()
    real = chat_format.expanded
    monkeypatch.setattr(chat_format, "expanded", lambda f: real(f).withColumn("context_chars", F.col("context_chars") + 1))
    assert chat_format.read_back(parts).first().loss_sha256 != first.loss_sha256
