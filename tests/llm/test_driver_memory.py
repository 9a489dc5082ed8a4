import random

import pyarrow as pa
import tokenizers
from pyspark.sql.classic.dataframe import DataFrame

from quantloom.llm import bpe_table, shingle_join, simhash
from quantloom.llm.queries import tokenizer_path


def test_the_driver_holds_no_tokenizer(spark, monkeypatch):
    """Head words and pieces come from tasks; the ids are the tokenizer's own."""
    texts = ["one two two, three.", "two Two", "", None, "one [UNK] twö"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tok = bpe_table._tokenizer(tokenizer_path())
    monkeypatch.setattr(tokenizers, "Tokenizer", None)
    got = {r.doc_id: r for r in bpe_table.decode(bpe_table.encode(df, tokenizer_path()), tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tok.decode(ids, skip_special_tokens=False)
    head = bpe_table.head_table(df, tokenizer_path(), "text", 5)
    assert head.column("word").to_pylist()[:2] == ["two", "one"] and head.schema.field("ids").type == pa.list_(pa.int32())
    every = bpe_table.pieces(spark, tokenizer_path())
    assert [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())] == every.to_pylist()


def test_frequent_shingles_are_no_objects_in_the_driver(spark, monkeypatch):
    def refused(self):
        raise AssertionError("rows as objects")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(DataFrame, "collect", refused)
    r = random.Random(5)
    common = ["w%d" % r.randrange(10**6) for _ in range(40)]
    rows = [(i, " ".join([*common, "own%d" % i])) for i in range(7)]
    g, n = shingle_join.frequent(spark.createDataFrame(rows, "node long, text string"))
    assert g.tolist() == shingle_join.shingles(" ".join(common)).tolist() and set(n.tolist()) == {7}


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars need no round; a random graph, a path and a ring get the smallest node of each component."""
    writes, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, *a: writes.append(1) or write(df, *a))
    star = spark.createDataFrame([(5, 1), (1, 6), (7, 1), (9, 8), (8, 9), (4, 4)], "u long, v long")
    assert {tuple(r) for r in simhash.components(star).collect()} == {(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 8)}
    assert len(writes) == 1
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    rows = [tuple(x) for x in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
