"""Listing blocks as a stream of landed files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_rows(batch: DataFrame, known: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Each key of the batch once, without the keys that are known already."""
    once = batch.dropDuplicates(list(keys))
    if known is None:
        return once
    seen = known.select(*[F.col(k).alias(f"__seen_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__seen_{k}")) for k in keys])
    return once.join(seen, same, "left_anti")


#: Ranges that a batch's keys are described by, and keys at either end that count one by one.
RANGES, ALONE = 32, 16


def in_ranges(known: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of ``known`` whose key lies in one of the ranges that the batch's keys fill.

    The ranges reach the files: a batch is stored in the order of its keys, so files and
    row groups outside them are not read. The ALONE smallest and largest keys are looked
    up one by one, so that a few documents that come late don't stretch a range to
    where they are; of more the last ones do, which reads more and is as right. Rows without a key are always in.
    """
    keys = batch.select(key).filter(F.col(key).isNotNull()).distinct()
    low = [r[0] for r in keys.orderBy(F.asc(key)).limit(ALONE).collect()]
    high = [r[0] for r in keys.orderBy(F.desc(key)).limit(ALONE).collect()]
    found = [F.col(key) == k for k in dict.fromkeys(low + high)]
    if len(low) == ALONE:
        middle = keys.filter((F.col(key) > low[-1]) & (F.col(key) < high[-1])).repartitionByRange(RANGES, key)
        ends = middle.groupBy(F.spark_partition_id()).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        found += [F.col(key).between(r.lo, r.hi) for r in ends]
    return known.filter(reduce(lambda a, b: a | b, found, F.col(key).isNull()))


def ingest_listing_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    ts: str,
    keys: Sequence[str],
) -> StreamingQuery:
    """Take in all landed blocks not seen before, then stop.

    Progress is in ``checkpoint``; a later call goes on from there. Rows are compared
    by key with what is at ``target`` in the ranges of their keys, however old: another document's listing may
    land late. Each batch has a folder ``batch=<number>`` of its own, which a repeated
    batch overwrites, so no row is lost or doubled after a failure.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        try:
            known = batch.sparkSession.read.parquet(target).filter(F.col("batch") != number)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            known = None
        rows = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        if known is not None:
            known = in_ranges(known, rows, keys[0])
        found = new_rows(rows, known, keys)
        found.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        spark.readStream.schema(schema)
        .parquet(source)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
