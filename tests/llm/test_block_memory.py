import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from quantloom.llm import bpe_table
from quantloom.llm.queries import tokenizer_path


def test_words_end_at_white_space_and_marks():
    texts = ["a,b. c!? é,, x̸.", None, "", "　x\x85,,\x1c.\n\n7;", " "]
    words, counts = bpe_table.split_words(pa.array(texts, pa.string()))
    assert words.to_pylist() == ["a,b", ".", "c", "!?", "é", ",,", "x̸.", "x", ",,\x1c.", "7", ";"]
    assert counts.tolist() == [7, 0, 0, 4, 0]


def peak(step, *args):
    """MB of Python objects and of Arrow that a step takes, and its result."""
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    out = step(*args)
    mb = (tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held) / 1e6
    tracemalloc.stop()
    return mb, out


def test_a_block_takes_little_memory():
    """Words and ids of a block are no Python objects, its texts are split a part at a time, and its rows leave in parts."""
    r = random.Random(1)
    words = ["%x" % r.getrandbits(36) for _ in range(100_000)]
    texts = [" ".join(r.choices(words, k=1000)) + "." for _ in range(500)]
    path = tokenizer_path()
    tok = bpe_table._tokenizer(path)
    ids = [e.ids for e in tok.encode_batch(words[:20_000], add_special_tokens=False)]
    head = pa.table({"word": pa.array(words[:20_000]), "ids": pa.array(ids, pa.list_(pa.int32()))})
    pieces = pa.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())])
    rows = {"block": pa.array([0] * 500, pa.int32()), "row": [{"doc_id": i} for i in range(500)], "text": [bpe_table.squeeze(t.encode()) for t in texts]}
    block = pa.table(rows)
    mb, tail = peak(bpe_table._tail_words(SimpleNamespace(value=head), 10), block)
    assert mb < 20
    tail = tail.sort_by("bucket").combine_chunks().to_batches()
    encode = bpe_table._encoded_words(path)
    mb, known = peak(lambda: pa.Table.from_batches(encode(iter(tail))))
    assert mb < 20
    mb, out = peak(bpe_table._assembled(SimpleNamespace(value=(head, pieces)), True), block, known)
    assert mb - out.nbytes / 1e6 < 10
    assert out.column("ids").num_chunks > 3 and out.column("row").to_pylist() == block.column("row").to_pylist()
    for i in range(0, 500, 50):
        want = tok.encode(texts[i], add_special_tokens=False).ids
        assert out.column("ids")[i].as_py() == want and out.column("decoded")[i].as_py() == tok.decode(want, skip_special_tokens=False)
