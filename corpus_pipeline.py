"""The corpus pipeline: each stage is written to the shared folder and read back as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import apportion, bpe_table, line_dedup, quality_rules, shingle_join
from quantloom.llm.common import materialise, read, salted_left_join
from quantloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject: null and empty texts too. Equal rows are judged alike; other columns pass."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one holder. Null text becomes empty; every row stays; other columns pass."""
    row = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row")
    out = line_dedup.drop_shared_lines(docs.select("doc_id", "text", row))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by op8's fingerprints or by Jaccard 0.8, both of 5-word shingles, stays: the smallest doc_id, then the smallest text hash; null ids last.

    Wordless and null texts are one group. Rows that share a doc_id but no group all stay; of equal rows one stays. Other columns pass
    through, whatever their names. An empty table gives an empty one.
    """
    h = lambda *c: F.xxhash64(*[F.coalesce(x, F.lit("")) if x == "text" else F.col(x) for x in c])
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", h("text").alias("t"), h(*docs.columns).alias("h")).alias("r")
    found = shingle_join.near_duplicates(docs.select("doc_id", "text", order)).select("root", "r")
    least = materialise(found.groupBy("root").agg(F.min("r").alias("least")).select("least.t", "least.h").distinct())
    keyed = docs.select(F.struct(*docs.columns).alias("row"), h("text").alias("t"), h(*docs.columns).alias("h"))
    return keyed.join(least, ["t", "h"], "left_semi").dropDuplicates(["t", "h"]).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's quota, each as often as the mix takes it."""
    return apportion.mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null text has no tokens."""
    path = tokenizer_path()
    out = bpe_table.digest(bpe_table.encode(docs.select("doc_id", "source", "text"), path, with_decoded=True))
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("mixing", mixing), ("bpe", bpe)]

#: SQL has no BPE and no XXH64; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
