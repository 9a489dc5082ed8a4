"""Very long texts in linear time, and tables whose columns have the names that operators use inside."""

import time

import pytest

from quantloom.llm import apportion, bpe_table, line_dedup, lm_trie, ordinal, quality_rules, simhash, warc_norm
from quantloom.llm.queries import tokenizer_path

CLASH = "_row _drop _text _d _t _th _p _k _h _s stats lined failing row node root fp h n size take taken target seg pos bucket block token count id word words _salt salt key".split()


@pytest.mark.parametrize("name", ["one word", "many lines"])
def test_quality_is_linear(spark, name):
    """10 MB of one word, and 200,000 lines of which every other one fails."""
    text = "x" * 10_000_000 if name == "one word" else "A good line of text.\n| | |\n" * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    quality_rules.judge(df.limit(0)).collect()
    start = time.perf_counter()
    row = quality_rules.judge(df).first()
    assert time.perf_counter() - start < 30
    assert row.clean_text == (text if name == "one word" else "\n".join(["A good line of text."] * 100_000 + [""]))
    assert row.n_words == (1 if name == "one word" else 800_000) and row.base_failed


@pytest.fixture(scope="module")
def clashing(spark):
    shared = "the same long boilerplate line of many documents"
    rows = [(i, f"{shared}\nText {i} has words of its own.", "a" if i % 2 else None, 0.5) for i in range(6)] + [(None, None, None, 1.0), (7, "", "b", None)]
    return spark.createDataFrame([(*r, *["kept"] * len(CLASH)) for r in rows], "doc_id long, text string, source string, quality double, " + ", ".join(f"{c} string" for c in CLASH))


OPERATORS = {
    "quality": quality_rules.judge,
    "clean": lambda d: quality_rules.clean(d, max_loss=1.0),
    "lines": line_dedup.drop_shared_lines,
    "simhash": simhash.near_duplicates,
    "mix": apportion.mix,
    "mixed": apportion.mixed_documents,
    "scores": lm_trie.score_documents,
    "bpe": lambda d: bpe_table.encode(d, tokenizer_path(), with_decoded=True),
    "archive": lambda d: warc_norm.archive_round_trip(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(clashing, name):
    got = OPERATORS[name](clashing)
    rows = got.collect()
    n = clashing.count()
    assert len(rows) == n if name not in ("clean", "mixed") else len(rows) <= 3 * n
    passed = [c for c in got.columns if c in CLASH and dict(got.dtypes)[c] == "string"]
    assert all(r[c] == "kept" for r in rows for c in passed)
