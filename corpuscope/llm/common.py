"""Helpers that the operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh_path

#: The white space that separates words, in every operator of this folder.
SPACE = r"[\x20\x09-\x0D]"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes after which a batch of rows goes to Python.
BATCH_BYTES = 8 << 20


class Memory(dict):
    """What ``make`` gives for a key, remembered up to ``size`` bytes.

    Two halves: when the newer is full it takes the place of the older, and what was
    not asked for since goes. Long keys are never kept.
    """

    def __init__(self, make: Callable, size: int = 16 << 20, longest: int = 64):
        self.make, self.half, self.longest, self.used, self.older = make, size // 2, longest, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, str) or len(key) <= self.longest:
            cost = sys.getsizeof(key) + sys.getsizeof(value) + 100
            if self.used + cost > self.half:
                self.older, self.used = dict(self), 0
                self.clear()
            self.used += cost
            self[key] = value
        return value


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; the shuffle files
    behind it are dropped, so that the disk holds one step at a time."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded bytes, however long a text is."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, unchanged."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(docs: DataFrame) -> Column:
    """All columns as one, out of the way of other names; ``select("__doc.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(
    df: DataFrame, weight: Column, by: Sequence[Column], out: str, bucket: Column, within: Sequence[str] = ()
) -> DataFrame:
    """Sum of ``weight`` over the rows before, in the order of ``by`` (within ``within``).

    ``bucket`` rises with the order; rows meet by bucket only, never all rows of a
    ``within``, and each bucket starts from the sum over those before it.
    """
    keys = [*within, "__b"]
    rows = df.withColumn("__b", bucket).withColumn("__w", weight)
    sums = rows.groupBy(*keys).agg(F.sum("__w").alias("__s"))
    # Keys are compared as one struct, which takes nulls as equal.
    before = W.partitionBy(*within).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        F.struct(*keys).alias("__k"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start")
    )
    inside = W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("__in", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    joined = found.withColumn("__k", F.struct(*keys)).join(starts, "__k")
    return joined.withColumn(out, F.col("__in") + F.col("__start")).drop("__k", "__b", "__w", "__in", "__start")


def ordered_parts(df: DataFrame, by: Sequence[Column], name: str) -> DataFrame:
    """A stored table with ``part``, which rises with the order of ``by``."""
    ranged = df.repartitionByRange(parts(df.sparkSession), *by)
    return stored(ranged.withColumn("part", F.spark_partition_id().cast("long")), name)
