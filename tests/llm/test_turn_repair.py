import hashlib
import re
from collections import defaultdict

import pytest

from quantloom.llm import turn_repair

WHOLE = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Least (cost, audit, repaired) over every edit, by trying all of them; rows are (role, text, fault)."""
    best = (10**9, "", [])

    def go(i, cost, audit, out):
        nonlocal best
        if cost > best[0] or len(out) > 2 * len(rows) + 2:
            return
        if i == len(rows) and WHOLE.fullmatch("".join(r[:1] for r, _ in out)):
            best = min(best, (cost, audit, out))
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + more + 3, audit + "R", [*out, (r, text)])
        if audit[-3:] != "III":
            for r in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*out, (r, "")])

    go(0, 0, "", [])
    return best


def plain(turns):
    """conv_id -> figures, from (conv_id, turn, role, text) rows."""
    convs, out = defaultdict(list), {}
    for c, t, r, x in turns:
        convs[c].append((t is not None, t or 0, " " if r is None else r, " " if x is None else x))
    for c, rows in convs.items():
        rows.sort()
        seen, faulty, count = set(), [], defaultdict(int)
        for _, _, r, x in rows:
            kept = x.strip(" \t\n\x0b\x0c\r")
            f = "blank" if not kept else "duplicate" if (r, x) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((r, x)), faulty.append((r, x, f))
            count[f] += 1
        cost, audit, left = search(faulty)
        nums = [t for given, t, *_ in rows if given]
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
        out[c] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def figures(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


CASES = [
    "s u a u a", "u u a", "a u", "s s u a", "u", "a a a", "u a s u a", "u a a u", "s", "s a u a", "x u a", "u x a", "u a u", "a", "u u u a a a", "s u u a u",
]


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_cheapest_edits_against_all_edits(spark, monkeypatch, bits):
    """Every way of cutting into segments gives the edits that a search over all of them finds; faults and ties included."""
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", bits)
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = []
    for c, case in enumerate(CASES):
        for t, r in enumerate(case.split()):
            rows += [(c, t * (1 + c % 2), names[r], f"Said {t}."), (100 + c, t, names[r], ["Same.", "open", "", "Said so!"][(t * 7 + c) % 4])]
    got = figures(turn_repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == plain(rows)


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, empty roles, large ids, clashing names."""
    big = 2**60 + 1
    rows = [(None, None, None, None), (None, 1, "user", "Ja."), (1, None, "user", "x."), (1, 3, "user", "x."), (1, 3, "user", "x."), (1, 9, None, "y"), (2, 1, "", "z."), (2, 2, "assistant", "z.")]
    rows += [(big, big + t, "user" if t % 2 == 0 else "assistant", "long words. " * 20_000 + str(t) + ".") for t in range(4)] + [(3, 0, "system", " \n")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, seg int, k string")
    assert figures(turn_repair.report(df)) == plain(rows)
    assert turn_repair.report(df.limit(0)).count() == 0
    none = figures(turn_repair.report(df.limit(0), df))
    assert set(none) == {None, 1, 2, 3, big} and set(none.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_long_conversation_of_equal_rows(spark):
    """Rows that repeat a row are counted before they are sorted, and a conversation may span many segments."""
    df = spark.range(60_000).selectExpr("7L as conv_id", "if(id < 30000, 5L, id) as turn", "if(id < 30000 or id % 2 = 0, 'user', 'assistant') as role", "if(id < 30000, 'Same.', concat('Said ', id, '.')) as text")
    assert turn_repair.ordered(df).count() == 30_001
    row = turn_repair.report(df).first()
    assert row.duplicate == 29_999 and row.cost == 4 * 29_999 + 3
    assert row.audit == "K" + "D" * 29_999 + "I" + "K" * 30_000


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(6) for t in range(40)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if f:
            want += [(c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)] * (1 + (f == 3))
    assert sorted(map(str, map(tuple, turn_repair.damage(df).collect()))) == sorted(map(str, want))
