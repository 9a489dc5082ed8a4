"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files are deleted when it ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name under the cluster's shared folder (`spark.checkpoint.dir`); only a local master may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def posix(path: str) -> str:
    """The mounted path of a shared folder, for memory maps."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory maps need a mounted shared folder, not {path}")
    return path


def materialise(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = shared_dir(spark)
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if held is None else spark.conf.set(SHUFFLE_CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, n: int = 16) -> DataFrame:
    """Left join in which a hot key of `left` is dealt over n tasks; `right` must be one small row per key."""
    (s,) = private(left.select(*left.columns, *[F.lit(0).alias(c) for c in right.columns if c not in left.columns]), "_salt")
    a = left.withColumn(s, F.pmod(F.xxhash64(salt), F.lit(n)))
    b = right.withColumn(s, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return a.join(b, [*keys, s], "left").drop(s)
