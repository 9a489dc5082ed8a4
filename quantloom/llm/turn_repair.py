"""Repair of conversation structure by a generalised LR parse with weighted edits.

The role grammar is C -> (nothing) | B | s B, B -> P | B P, P -> u a, over role initials. Its LR automaton reads each conversation's rows in
order with a graph-structured stack: stacks share their tails, every edit (Keep, Rerole, Delete, Insert) branches, and branches whose stack
tops are equal merge into the one of least (cost, audit). Two audits of the same rows and cost can't be a proper prefix of one another, since
the longer one would hold more insertions, so that order survives whatever follows and merging loses nothing.

It also makes the parse associative, and no conversation has to fit one task: equal rows are counted before anything is sorted, rows are
range-partitioned in order and cut into segments of at most SEGMENT distinct rows, each segment is parsed from every stack top that it may
start with, and a fold over the segments of a conversation picks the path. Only that fold and a digest of the whole repaired text follow a
conversation in one task, as a stream: a digest needs its order, and the audit is one value of one row.

Faults: blank (no word character), duplicate (role and text seen earlier in the conversation), truncated (the last character that is no white
space is none of `.!?`); a row has its first one only. Null role and text are one space. A null turn comes first; rows of one turn go by role,
then text. A role whose initial is none of s, u, a can't be kept. A null conv_id is a conversation. Repeated rows are duplicates. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, materialise, salted_left_join

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a segment, as a power of two.
SEGMENT_BITS = 12
ROLES = {"u": "user", "a": "assistant"}
# The LR table of the role grammar. A state in REDUCE pops so many states and goes on by GOTO.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (5, "u"): 2, (2, "a"): 6}
REDUCE = {4: ("B", 1), 6: ("P", 2), 7: ("B", 2)}
GOTO = {(0, "P"): 4, (1, "P"): 4, (3, "P"): 7, (5, "P"): 7, (0, "B"): 3, (1, "B"): 5}
ACCEPT = (0, 3, 5)
#: Stacks with each top that can stand between two rows; a stack is (state, stack below). What lies below state 2 doesn't matter to what can follow.
BOTTOM = (0, None)
TOPS = {0: BOTTOM, 1: (1, BOTTOM), 2: (2, BOTTOM), 3: (3, BOTTOM), 5: (5, (1, BOTTOM))}


@functools.cache
def advance(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a role initial and all reductions; None where the grammar has no place for it."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        left, size = REDUCE[stack[0]]
        for _ in range(size):
            stack = stack[1]
        stack = (GOTO[stack[0], left], stack)
    return stack


def _offer(tops: dict, stack: tuple | None, cost: int, audit: str) -> bool:
    """Merge a branch into the branch of the same stack top: the smaller (cost, audit) stays."""
    if stack is None or ((held := tops.get(stack[0])) and held[:2] <= (cost, audit)):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def inserted(tops: dict) -> dict:
    """The branches plus all that insertions can make of them."""
    out, todo = dict(tops), list(tops.values())
    while todo:
        cost, audit, stack = todo.pop()
        for symbol in ROLES:
            new = advance(stack, symbol)
            if _offer(out, new, cost + INSERT, audit + "I"):
                todo.append(out[new[0]])
    return out


def parse_row(tops: dict, initial: str, must_go: bool, penalty: int) -> dict:
    out: dict = {}
    for cost, audit, stack in inserted(tops).values():
        _offer(out, stack, cost + DELETE, audit + "D")
        if not must_go:
            _offer(out, advance(stack, initial), cost + penalty, audit + "K")
            for symbol in ROLES:
                _offer(out, advance(stack, symbol), cost + penalty + REROLE, audit + "R")
    return out


def replay(audit: str, top: int, rows: list[tuple[str, str]]):
    """(role, text) of each row that an audit leaves, from a stack top on; the grammar leaves one role for each edit."""
    stack, at = TOPS[top], iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(at)
        if edit == "D":
            continue
        symbol = role[:1] if edit == "K" else next(x for x in ROLES if advance(stack, x))
        stack = advance(stack, symbol)
        yield role if edit == "K" else ROLES[symbol], text


def damage(turns: DataFrame) -> DataFrame:
    """A test's faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes `.!?`, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    new = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), copies.alias("copy")).drop("copy")


def ordered(turns: DataFrame) -> DataFrame:
    """k (conv_id as text, empty for null), turn, role, text, n, fault, pos, seg: distinct rows in order, written to the shared folder."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    k = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("k")
    rows = turns.select(k, F.col("turn").cast("long").alias("turn"), text("role"), text("text")).groupBy("k", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("a", F.xxhash64("role", "text")).withColumn("b", F.xxhash64(F.lit("second"), "role", "text"))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = rows.groupBy("k", "a", "b").agg(F.min(at).alias("first"), F.count("*").alias("held")).where("held > 1").drop("held")
    rows = salted_left_join(rows, firsts, ["k", "a", "b"], F.col("turn"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.coalesce(F.col("first") < at, F.lit(False)), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    keys = [F.col("k"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.select("k", "turn", "role", "text", "n", F.coalesce(fault, F.lit("")).alias("fault")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pos = F.monotonically_increasing_id()
    return materialise(rows.withColumn("pos", pos).withColumn("seg", F.shiftright("pos", SEGMENT_BITS)))


def _runs(batches, keys: list[str]):
    """(key values, rows as dicts) of each run of equal keys in a sorted stream; a run is gathered whole."""
    key, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            k = tuple(row[c] for c in keys)
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def _by_segment(rows: DataFrame) -> DataFrame:
    return rows.repartition("k", "seg").sortWithinPartitions("k", "seg", "pos")


_SEGMENT = "k string, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, starts array<int>, ends array<int>, costs array<long>, audits array<string>"


def segments(rows: DataFrame) -> DataFrame:
    """A row per segment: its counts, and the least (cost, audit) from each stack top to each."""
    legal = ("su", "ua", "au")

    def parsed(run: list[dict]) -> dict:
        out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": run[0]["role"][:1], "low": None, "high": None, "turns": 0}
        before, tops = None, {t: {t: (0, "", s)} for t, s in TOPS.items()}
        for r in run:
            initial, more = r["role"][:1], r["n"] - 1
            if r["fault"]:
                out[r["fault"]] += 1
            out["blank" if r["fault"] == "blank" else "duplicate"] += more
            out["illegal"] += more + (before is not None and before + initial not in legal)
            if r["turn"] is not None and r["turn"] != out["high"]:
                out["low"], out["high"], out["turns"] = r["turn"] if out["low"] is None else out["low"], r["turn"], out["turns"] + 1
            before, penalty = initial, TRUNCATED if r["fault"] == "truncated" else 0
            for t in tops:
                tops[t] = parse_row(tops[t], initial, r["fault"] in ("blank", "duplicate"), penalty)
                if more:
                    tops[t] = {e: (c + DELETE * more, a + "D" * more, s) for e, (c, a, s) in tops[t].items()}
        paths = [(s, e, c, a) for s, found in tops.items() for e, (c, a, _) in found.items()]
        return out | {"last": before} | dict(zip(("starts", "ends", "costs", "audits"), map(list, zip(*paths))))

    def run(batches):
        schema = None
        for (k, seg), held in _runs(batches, ["k", "seg"]):
            schema = schema or _arrow(_SEGMENT)
            yield pa.RecordBatch.from_pylist([{"k": k, "seg": seg} | parsed(held)], schema)

    return _by_segment(rows).mapInArrow(run, _SEGMENT)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


_CHOICE = "k string, seg long, start int, edits string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def choices(parts: DataFrame) -> DataFrame:
    """A row per segment: the stack top it starts with and its edits on the cheapest path; the last one of a conversation has the whole's figures."""

    def fold(k, held: list[dict]) -> list[dict]:
        tops, back, low, high, turns, illegal = {0: (0, "", BOTTOM)}, [], None, None, 0, 0
        for i, p in enumerate(held):
            new, via = {}, {}
            for s, e, c, a in zip(p["starts"], p["ends"], p["costs"], p["audits"]):
                if s in tops and _offer(new, TOPS[e], tops[s][0] + c, tops[s][1] + a):
                    via[e] = (s, a)
            tops = new
            back.append(via)
            illegal += p["illegal"] + (i > 0 and held[i - 1]["last"] + p["first"] not in ("su", "ua", "au"))
            if p["turns"]:
                turns += p["turns"] - (high is not None and high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
        cost, audit, end = min((*inserted(tops)[t][:2], t) for t in ACCEPT if t in inserted(tops))
        # Insertions behind the last row belong to its segment; they lead from the top that the rows end in.
        ended = next(t for t, x in tops.items() if audit.startswith(x[1]) and x[0] + INSERT * (len(audit) - len(x[1])) == cost and set(audit[len(x[1]) :]) <= {"I"})
        out, tail, top = [], audit[len(tops[ended][1]) :], ended
        for p, via in zip(reversed(held), reversed(back)):
            start, edits = via[top]
            out.append({"k": k, "seg": p["seg"], "start": start, "edits": edits + tail})
            tail, top = "", start
        total = lambda c: sum(p[c] for p in held)
        out[0] |= {"gaps": 0 if low is None else high - low + 1 - turns, "illegal": illegal, "cost": cost, "audit": audit} | {c: total(c) for c in ("blank", "duplicate", "truncated")}
        return out

    def run(batches):
        schema = None
        for (k,), held in _runs(batches, ["k"]):
            schema = schema or _arrow(_CHOICE)
            yield pa.RecordBatch.from_pylist(fold(k, held), schema)

    return parts.repartition("k").sortWithinPartitions("k", "seg").mapInArrow(run, _CHOICE)


def repaired_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """k, seg, no, role, text: the rows of the repaired conversations, in order of (seg, no)."""

    def run(batches):
        schema = pa.schema([("k", pa.string()), ("seg", pa.int64()), ("no", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        for (k, seg), held in _runs(batches, ["k", "seg"]):
            given = [x for r in held for x in [(r["role"], r["text"])] * r["n"]]
            left = replay(held[0]["edits"], held[0]["start"], given)
            yield pa.RecordBatch.from_pylist([{"k": k, "seg": seg, "no": i, "role": r, "text": t} for i, (r, t) in enumerate(left)], schema)

    joined = rows.select("k", "seg", "pos", "role", "text", "n").join(chosen.select("k", "seg", "start", "edits"), ["k", "seg"])
    return _by_segment(joined).mapInArrow(run, "k string, seg long, no long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """k, sha of `role:text`, newline-joined; a conversation is streamed in order."""

    def run(batches):
        schema, key, sha = pa.schema([("k", pa.string()), ("sha", pa.string())]), None, None
        done = lambda: pa.RecordBatch.from_pylist([{"k": key, "sha": sha.hexdigest()}], schema)
        for b in batches:
            for r in b.to_pylist():
                if r["k"] != key:
                    if sha:
                        yield done()
                    key, sha = r["k"], hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
        if sha:
            yield done()

    return repaired.repartition("k").sortWithinPartitions("k", "seg", "no").mapInArrow(run, "k string, sha string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The choices, a row per segment, and the repaired rows (both by k, the conv_id as text)."""
    rows = ordered(turns)
    chosen = materialise(choices(segments(rows)))
    return chosen, repaired_rows(rows, chosen)


def report(turns: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of `of` (default: of turns)."""
    chosen, repaired = repair(turns)
    whole = chosen.where("audit is not null").drop("seg", "start", "edits").join(digests(repaired), "k", "left")
    ids = (turns if of is None else of).select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("k", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    none = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    sha = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return ids.join(whole, "k", "left").select("conv_id", *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), sha)
