"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Documents are dealt to shards by a hash; a (source, shard) is laid out in seeded order and cut into blocks of equal words; a small
source has smaller blocks and fewer shards. In each
shard, blocks are allocated to sources by the highest quotients target / (2k + 1); a source's quota q over its n blocks takes every
block q div n times and q mod n blocks, chosen by a seeded permutation, once more. A document is taken as far as its blocks are.

Null text: size 0, nothing taken. The null source is one source, last. An empty table gives an empty result. Rows that repeat a
doc_id are dealt alike and taken each. Other columns take no part in `mix` and pass through `mixed_documents`. The number of shards follows from the total, so every group stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import materialise, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SHARD_WORDS = 2_000_000
SHARDS = 64
SHARD_BLOCKS = 1 << 14
#: A source has so many blocks in each of its shards, and in all if it has so many words.
CELL_BLOCKS = 128
SEED = 7
#: Fixed value: a prime over any count of blocks, to permute them.
PRIME = 2_147_483_647


def targets(totals: DataFrame) -> DataFrame:
    """source, source_size, target from (source, source_size): shares by weight, capped, the excess reshared.

    Sources in order of cap per weight: one is capped if its share of what the ones before leave exceeds its cap. One row per
    source, so a single window task holds as many rows as there are sources.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * float(MAX_EPOCHS))
    key = [F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source")]
    before = Window.partitionBy(F.lit(1)).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(1)).orderBy(*key).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("level", left / F.sum("w").over(after))
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)
    level = F.coalesce(free["level"], F.lit(float("inf")))
    return t.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs plus size, source_size, target, taken."""
    size = F.size(words(F.col("text"))).cast("long").alias("size")
    lean = materialise(docs.select("doc_id", "source", size, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")))  # texts are read once
    totals = lean.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = lean.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = total // SHARD_WORDS + SHARDS
    block = max(1, total // (shards * SHARD_BLOCKS))
    goal = targets(totals)

    # Small sources have smaller blocks and fewer shards, so that no cell rounds to nothing; their shards start at a seeded one.
    own = goal.withColumn("_block", F.greatest(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), F.floor(F.col("source_size") / CELL_BLOCKS))))
    own = own.withColumn("_spread", F.greatest(F.lit(1).cast("long"), F.least(F.lit(shards).cast("long"), F.floor(F.col("source_size") / (F.col("_block") * CELL_BLOCKS)))))
    own = own.select(F.col("source").alias("_src"), "source_size", "target", "_block", "_spread")
    lean = lean.join(own, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    lean = lean.withColumn("_g", F.pmod(F.pmod(F.xxhash64("doc_id", "_th", F.lit(seed)), F.col("_spread")) + F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(shards)), F.lit(shards)))
    inner = Window.partitionBy("source", "_g").orderBy(F.xxhash64(F.lit(seed), "_th", "doc_id"), "doc_id", "_th")
    lean = lean.withColumn("_to", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("source", "_g")
    lean = lean.withColumn("_all", F.sum("size").over(group))
    cells = lean.groupBy("source", "_g", "source_size", "target", "_block").agg(F.sum("size").alias("_words")).where("_words > 0")
    # A seat is one of the cell's _n blocks, so votes count blocks as well.
    cells = cells.withColumn("_n", F.ceil(F.col("_words") / F.col("_block"))).withColumn("_most", F.col("_n") * MAX_EPOCHS)
    cells = cells.withColumn("_vote", F.col("target") * F.col("_n") / F.col("source_size"))
    seats = cells.groupBy("_g").agg(F.round(F.sum("_vote")).alias("_seats"))
    # A cell bids for all the seats that it may take, so that no seat of its shard stays empty for want of a bid.
    bids = cells.select("source", "_g", "_vote", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)).alias("_k"))
    bids = bids.withColumn("_q", F.col("_vote") / (2 * F.col("_k") + 1))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_q"), F.col("source").isNull(), "source", "_k"))
    won = bids.withColumn("_r", rank).join(seats, "_g").where("_r <= _seats").groupBy("source", "_g").agg(F.count("*").alias("_quota"))
    won = won.select(F.col("source").alias("_s2"), F.col("_g").alias("_g2"), "_quota")

    one = lean.join(won, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_g") == F.col("_g2")), "left").drop("_s2", "_g2")
    one = one.withColumn("_n", F.greatest(F.ceil(F.col("_all") / F.col("_block")), F.lit(1).cast("long"))).withColumn("_quota", F.coalesce("_quota", F.lit(0)))
    one = one.withColumn("_from", F.col("_to") - F.col("size")).withColumn("_shift", F.xxhash64("source", "_g", F.lit(seed)))
    one = one.withColumn("_more", F.col("_quota") % F.col("_n")).withColumn("_turns", F.floor(F.col("_quota") / F.col("_n")))

    def part(b):
        chosen = F.pmod(b * F.pmod(F.lit(PRIME), F.col("_n")) + F.pmod(F.col("_shift"), F.col("_n")), F.col("_n")) < F.col("_more")
        words_in = F.least(F.col("_to"), (b + 1) * F.col("_block")) - F.greatest(F.col("_from"), b * F.col("_block"))
        return F.when(chosen, words_in).otherwise(F.lit(0).cast("long"))

    blocks = F.sequence(F.floor(F.col("_from") / F.col("_block")), F.floor((F.col("_to") - 1) / F.col("_block")))
    extra = F.aggregate(F.transform(blocks, part), F.lit(0).cast("long"), lambda a, x: a + x)
    one = one.withColumn("taken", F.when(F.col("size") == 0, 0).otherwise(F.col("_turns") * F.col("size") + extra).cast("long"))
    return one.select("doc_id", "source", "_th", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix in whole documents, in the columns of docs: each document as often as it is taken.

    A source's quota is what the mix takes of it. Every document is there quota div size times, and the first ones in seeded order
    once more, as far as their middle lies in the rest; so a source misses its quota by half a document at most. Rows of one doc_id
    and text go together.
    """
    m = materialise(mix(docs, seed))
    quota = m.groupBy("source").agg(F.sum("size").alias("_size"), F.sum("taken").alias("_quota")).where("_size > 0")  # a source without words takes nothing
    shards = m.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // SHARD_WORDS + SHARDS
    units = m.where("size > 0").groupBy("doc_id", "source", "_th").agg(F.sum("size").alias("_words"))
    h = F.xxhash64("doc_id", "_th", F.lit(seed + 1))
    units = materialise(units.withColumn("_g", F.pmod(h, F.lit(shards))))
    order = Window.partitionBy("source", "_g").orderBy(F.xxhash64(F.lit(seed + 1), "_th", "doc_id"), "doc_id", "_th")
    units = units.withColumn("_to", F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = units.groupBy("source", "_g").agg(F.sum("_words").alias("_w"))
    before = Window.partitionBy("source").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    cells = cells.join(quota.withColumnRenamed("source", "_q"), F.col("source").eqNullSafe(F.col("_q"))).select(
        F.col("source").alias("_s2"), F.col("_g").alias("_g2"), "_base", F.floor(F.col("_quota") / F.col("_size")).alias("_turns"), (F.col("_quota") % F.col("_size")).alias("_rest")
    )
    units = units.join(cells, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_g") == F.col("_g2")))
    more = (F.col("_base") + F.col("_to") - F.col("_words") / 2 <= F.col("_rest")).cast("int")
    units = units.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "_th", (F.col("_turns").cast("int") + more).alias("_copies")).where("_copies > 0")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    same = keyed["doc_id"].eqNullSafe(F.col("_d")) & keyed["source"].eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_th"))
    every = keyed.join(units, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return every.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
