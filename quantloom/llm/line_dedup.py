"""Dropping lines that many documents share, with DataFrame functions only.

Lines are exploded, normalised and hashed (two seeds, 128 bits); distinct documents are counted per hash after a first
aggregation by (hash, document); only positions to drop are joined back, by document, and the text is rebuilt by position.

A null or empty text is one empty line and stays so. Rows that repeat a doc_id count as one document; each row keeps its own
lines. The holder that keeps a line is the largest doc_id; a null doc_id never holds it unless all are null.
Other columns pass through, whatever their names; one that has the name of an output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import SPACE, ascii_lower, let, private

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 16


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text."""
    base = docs.select(F.col("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("_t")).withColumn("_th", F.xxhash64("_t"))
    lines = base.select("_d", "_th", F.posexplode(F.split("_t", "\n")).alias("_p", "_l"))
    lines = lines.select("_d", "_th", "_p", ascii_lower(F.trim(F.col("_l"), F.lit(SPACE))).alias("_k"))
    lines = lines.where(F.length("_k") >= min_chars)
    lines = lines.select("_d", "_th", "_p", F.xxhash64("_k").alias("_a"), F.xxhash64(F.lit("second"), "_k").alias("_b"))
    counts = lines.groupBy("_a", "_b", "_d").agg(F.lit(1).alias("_one")).groupBy("_a", "_b")
    shared = counts.agg(F.count("*").alias("_n"), F.max("_d").alias("_m")).where(F.col("_n") >= min_docs).drop("_n")
    shared = shared.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = lines.withColumn("_s", F.pmod(F.hash("_d", "_p"), F.lit(SALTS))).join(shared, ["_a", "_b", "_s"])
    hits = hits.where(~F.col("_d").eqNullSafe(F.col("_m")))
    row_, drop, text_ = private(docs, "_row", "_drop", "_text")
    drops = hits.groupBy("_d", "_th").agg(F.collect_set("_p").alias(drop))
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias(row_)  # the text travels once
    d = docs.select(row, "doc_id", F.col("text").alias(text_), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).alias("d")
    out = d.join(drops.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r._d")) & (F.col("d._h") == F.col("r._th")), "left").select(row_, text_, drop)
    text = F.coalesce(text_, F.lit(""))
    parts = F.split(text, "\n")

    def rebuilt(ls):
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)), "\n")

    made = {
        "n_lines": F.size(parts).cast("long"),
        "n_dropped": F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(drop).isNull(), text).otherwise(let(parts, rebuilt)),
    }
    kept = [F.col(text_).alias("text") if c == "text" else F.col(row_).getField(c).alias(c) for c in docs.columns if c not in made]
    return out.select(*kept, *[x.alias(n) for n, x in made.items()])
