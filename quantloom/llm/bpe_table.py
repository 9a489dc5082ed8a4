"""BPE encoding by a table of distinct words, and decoding by an id-to-piece join.

Texts are split into words by Spark's tasks and every distinct word is encoded once by the tokenizer; ids go back by position.

- The head holds the words that a bounded, hashed sample of the texts repeats (at most HEAD_WORDS words of at most HEAD_BYTES bytes, so
  its size is bounded at any input size). It is encoded first and given to all tasks.
- Documents are dealt to blocks by a hash of the row, compressed, in one shuffle. The words of a block that the head lacks, the tail, go
  in packs to buckets by a hash of the word, where each distinct word is encoded once, and the packs go back with their ids to the blocks
  that hold them, where ids are put together by position.

Tasks hold words and ids as Arrow arrays and go through a block's texts a part of about PART_BYTES at a time.

Both ways always run; the sample changes their shares and never the ids. The number of blocks grows with the data, and a group of copies
is dealt over all of them; only rows equal in all columns share a block.

A cut between words is where the tokenizer's pre-tokenizer cuts anyway: at white space, and between a Latin letter or digit and the
marks that end a word. Its special tokens hold neither. Null or empty text: no ids, decoded to ''. Rows that repeat a doc_id are each
encoded. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from quantloom.llm.common import private

#: The characters with Unicode property White_Space.
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters before and marks after a cut that is not at white space: marks at the end of a word are a word of their own.
LETTER, MARKS = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", "[,.;:!?]"
HEAD_WORDS = 1 << 17
HEAD_BYTES = 256
SAMPLE_DOCS = 10_000
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and how many each text has."""
    marked = pc.replace_substring_regex(texts.fill_null(""), f"({LETTER})({MARKS}+)({WHITE}|$)", "\\1\n\\2\\3")
    lists = pc.split_pattern_regex(marked, f"{WHITE}+")
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    return words.filter(some), np.bincount(text.filter(some), minlength=len(texts))


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _encode(tok, words: pa.Array) -> pa.ListArray:
    parts = [pa.array([], pa.list_(pa.int32()))]
    for i in range(0, len(words), 2000):
        made = tok.encode_batch_fast(words.slice(i, 2000).to_pylist(), add_special_tokens=False)
        parts.append(pa.array([e.ids for e in made], pa.list_(pa.int32())))
    return pa.concat_arrays(parts)


def _taken(ids: pa.ListArray, words: pa.Array, of: pa.Array) -> pa.ListArray:
    """The ids of each of the words `of`; ids belong to `words`."""
    place = pc.index_in(of, words)
    if place.null_count:
        raise KeyError(of.filter(place.is_null())[0].as_py())
    return ids.take(place)


def _counts(batches):
    """word, n of each batch's texts."""
    for b in batches:
        for part in range(0, b.num_rows, 250):
            words = split_words(b.column("text").slice(part, 250))[0]
            c = words.value_counts()
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])


def _with_ids(path: str):
    """word, ids of each word."""

    def run(batches):
        tok = _tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), _encode(tok, b.column("word"))], ["word", "ids"])

    return run


def head_table(docs: DataFrame, path: str, text: str, rows: int) -> pa.Table:
    """word, ids of the words that the sample repeats, the most frequent first; at most HEAD_WORDS. A task encodes them, the driver holds no tokenizer."""
    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(max(1, rows))) < SAMPLE_DOCS).select(F.col(text).alias("text"))
    counts = some.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = counts.where((F.col("n") > 1) & (F.octet_length("word") <= HEAD_BYTES))
    words = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("word")
    head = words.mapInArrow(_with_ids(path), "word string, ids array<int>").toArrow()
    return head.cast(pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))]))


def squeeze(raw) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if len(raw) else b""


def expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _lines(data: bytes) -> pa.Array:
    """The words of a pack."""
    return pc.split_pattern(pa.array([expand(data)], pa.binary()).cast(pa.string()), "\n").flatten()


def _parts(texts: pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """The position of a part's first text, and its texts."""
    at, part, size = 0, [], 0
    for text in texts:
        part.append(expand(text.as_py()))
        size += len(part[-1])
        if size >= PART_BYTES:
            yield at, pa.array(part, pa.binary()).cast(pa.string())
            at, part, size = at + len(part), [], 0
    if part:
        yield at, pa.array(part, pa.binary()).cast(pa.string())


def _packed(batches):
    """block, row, text: the text compressed for the shuffle."""
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            text = [squeeze(t.as_buffer() or b"") for t in part.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("row"), pa.array(text, pa.binary())], ["block", "row", "text"])


def _tail_words(shared, buckets: int):
    """bucket, block, words: per bucket, the sorted distinct words of one block that the head lacks."""

    def run(t: pa.Table) -> pa.Table:
        head, tail = shared.value.column("word"), []
        for _, texts in _parts(t.column("text")):
            words = split_words(texts)[0].unique()
            tail.append(words.filter(pc.invert(pc.is_in(words, head))))
        words = pa.chunked_array(tail, pa.string()).unique()
        found: dict = {}
        for w in words.take(pc.array_sort_indices(words)).to_pylist():
            found.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
        block = t.column("block")[0].as_py()
        rows = {"bucket": list(found), "block": [block] * len(found), "words": [squeeze("\n".join(ws).encode()) for ws in found.values()]}
        return pa.table(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("words", pa.binary())]))

    return run


def _encoded_words(path: str):
    """block, words, ids from rows sorted by bucket: each distinct word of a bucket is encoded once.

    ids holds, per word, the number of its ids, and then all ids in three bytes each.
    """

    def run(batches):
        tok, held, rows = _tokenizer(path), None, []

        def close():
            lists = [_lines(x) for _, x in rows]
            words = pa.chunked_array(lists).unique()
            known, data = _encode(tok, words), []
            for ws in lists:
                ids = _taken(known, words, ws)
                lens, flat = np.diff(ids.offsets.to_numpy()).astype("<u4"), ids.flatten().to_numpy().astype("<u4")
                data.append(squeeze(lens.tobytes() + flat.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()))
            out = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["block", "words", "ids"])

        for b in batches:
            for bucket, block, words in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "words"))):
                if bucket != held and rows:
                    yield close()
                    rows = []
                held = bucket
                rows.append((block, words))
        if rows:
            yield close()

    return run


def _assembled(shared, with_text: bool):
    """row, ids (and decoded) of one block: ids by position, from the head and the block's tail words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        head, pieces = shared.value
        words, known = head.column("word").chunks, head.column("ids").chunks
        for pack, data in zip(right.column("words").to_pylist(), right.column("ids").to_pylist()) if right.num_rows else ():
            words.append(_lines(pack))
            n, data = len(words[-1]), expand(data)
            lens = np.frombuffer(data, "<u4", n)
            flat = np.frombuffer(data, np.uint8, offset=4 * n).reshape(-1, 3).astype(np.int32) @ np.array([1, 1 << 8, 1 << 16], np.int32)
            known.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat, pa.int32())))
        words, known = pa.concat_arrays([pa.array([], pa.string()), *words]), pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *known])
        out = []
        for at, texts in _parts(left.column("text")):
            found, counts = split_words(texts)
            got = _taken(known, words, found)
            until = got.offsets.take(pa.array(np.concatenate([[0], np.cumsum(counts)])))
            one = {"row": left.column("row").slice(at, len(texts)), "ids": pa.ListArray.from_arrays(until, got.flatten())}
            out.append(pa.table(one | ({"decoded": texts_of(one["ids"], pieces)} if with_text else {})))
        return pa.concat_tables(out)

    return run


def encode(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False, with_decoded: bool = False) -> DataFrame:
    """ids array<int> and the columns of docs, of which the text only if asked for (it would be shuffled once more).

    With `with_decoded` also decoded, made from the ids in the same task, as `decode` makes it in a pass of its own.
    """
    kept = [c for c in docs.columns if keep_text or c != text]
    out, back = private(docs.select(*kept), "ids", "decoded")
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = size // BLOCK_BYTES + 1
    head = head_table(docs, path, text, rows)
    send = docs.sparkSession.sparkContext.broadcast
    block = F.pmod(F.xxhash64(*docs.columns), F.lit(blocks)).cast("int").alias("block")
    row = F.struct(*kept).alias("row") if kept else F.struct(F.lit(0).alias("_")).alias("row")
    dealt = docs.select(block, row, F.col(text).alias("text"))
    row_type = StructField("row", dealt.schema["row"].dataType)
    types = [StructField("block", IntegerType()), row_type, StructField("text", BinaryType())]
    # Both readers of the blocks share this one shuffle.
    dealt = dealt.mapInArrow(_packed, StructType(types)).repartition("block")
    tail = dealt.groupBy("block").applyInArrow(_tail_words(send(head), blocks), "bucket int, block int, words binary")
    table = tail.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded_words(path), "block int, words binary, ids binary")
    made = [row_type, StructField("ids", ArrayType(IntegerType()))] + [StructField("decoded", StringType())] * with_decoded
    shared = send((head, pieces(docs.sparkSession, path) if with_decoded else None))
    both = dealt.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_assembled(shared, with_decoded), StructType(made))
    named = [F.col("ids").alias(out)] + [F.col("decoded").alias(back)] * with_decoded
    return both.select(*[F.col("row").getField(c).alias(c) for c in kept], *named)


def pieces(spark: SparkSession, path: str) -> pa.Array:
    """The id-to-piece table, ordered by id; a task reads it from the tokenizer."""

    def run(_):
        tok = _tokenizer(path)
        yield pa.RecordBatch.from_arrays([pa.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())], pa.string())], ["piece"])

    found = spark.range(1, numPartitions=1).mapInArrow(run, "piece string").toArrow().column("piece")
    return found.cast(pa.string()).combine_chunks()


def texts_of(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Ids joined to their pieces, many documents at once; pieces are joined by one blank (this tokenizer has no decoder)."""
    at = ids.offsets.to_numpy()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at - at[0]), pieces.take(ids.flatten())), " ")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded plus decoded. The id-to-piece table is bounded by the vocabulary, so every task holds it and takes pieces by id."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(encoded.sparkSession, path))

    @F.arrow_udf("string")
    def text_of(x: pa.Array) -> pa.Array:
        return texts_of(x, shared.value)

    return encoded.withColumn(private(encoded, "decoded")[0], text_of(ids))


def digest(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """encoded plus n_tokens and ids_sha256."""
    text = F.array_join(F.col(ids).cast("array<string>"), " ")
    return encoded.withColumn("n_tokens", F.size(ids).cast("long")).withColumn("ids_sha256", F.sha2(text, 256))
