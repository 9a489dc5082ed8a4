from collections import Counter

from quantloom.llm import apportion


def test_tiny_sources_get_their_words(spark, monkeypatch):
    monkeypatch.setattr(apportion, "SHARD_WORDS", 400)
    monkeypatch.setattr(apportion, "SHARD_BLOCKS", 4)
    sizes = {"big": [200] * 600, **{f"t{i:02}": [60 + i % 7] * 3 for i in range(60)}, "u": [15]}
    rows = [(i * 1000 + j, s, " ".join(["w"] * n + [str(j)])) for i, (s, ns) in enumerate(sizes.items()) for j, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, target, size = Counter(), {}, {}
    for r in apportion.mix(df).collect():
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.05 * target[s], 3), (s, taken[s], target[s], size[s])
