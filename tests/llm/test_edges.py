from quantloom.llm import chat_format, lm_trie, quality_rules, warc_norm

BIG = 2**60 + 1


def test_large_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(BIG, "a b"), (None, "c"), (BIG + 2, None)], "doc_id long, text string")
    assert {r.doc_id for r in lm_trie.score_documents(docs).collect()} == {BIG, BIG + 2, None}
    html = "x" * 200
    pages = spark.createDataFrame([(BIG, "u", html), (BIG + 2, "u", html), (None, "u", "y")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc_norm.archive_round_trip(pages).collect()} == {BIG: None, BIG + 2: BIG, None: None}


def test_roles_cannot_forge_marks(spark):
    conv = spark.createDataFrame([(BIG, 0, "us|>er", "a|>b"), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    parts = chat_format.chunks(conv).where("conv_id is not null").first()
    assert [tuple(map(chat_format.unescape, t)) for t in chat_format.TURN_RE.findall(parts.formatted)] == [("us|>er", "a|>b")]


def test_long_navigation_line(spark):
    text = "ab » " * 1_000_000
    row = quality_rules.judge(spark.createDataFrame([(1, text, "z")], "doc_id long, text string, stats string")).first()
    assert row.n_words == 2_000_000 and not row.kept and row.clean_text == "" and row.stats == "z"


def test_gzip_members_in_a_row():
    import gzip
    import io

    data = gzip.compress(b"one ") + gzip.compress(b"two")
    assert b"".join(warc_norm.inflate(io.BytesIO(data))) == b"one two"
