"""Submission counts per week, kept up to date from landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def weekly_counts(meta: DataFrame, ts: str, delay: str | None = None) -> DataFrame:
    """Counts per nearest Sunday.

    Shifting by three days turns rounding to the nearest week into a tumbling
    window; epoch day 0 is a Thursday, so windows start three days later.
    """
    shifted = meta.select((F.col(ts).cast("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("__t"))
    if delay is not None:
        shifted = shifted.withWatermark("__t", delay)
    windows = shifted.groupBy(F.window("__t", "7 days", startTime="3 days").alias("w"))
    return windows.agg(F.count("*").alias("n")).select(
        F.to_date("w.start").alias("week"), "n"
    )


def weekly_table(spark: SparkSession, target: str) -> DataFrame:
    """The newest version of the table."""
    versions = spark.read.parquet(target)
    newest = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")


def submissions_stream(
    spark: SparkSession,
    source: str,
    schema: StructType,
    target: str,
    checkpoint: str,
    ts: str,
    delay: str = "7 days",
    closed_only: bool = False,
) -> StreamingQuery:
    """Bring the weekly table at ``target`` up to date with all landed files.

    By default each batch writes every week so far beside the older versions, and
    ``weekly_table`` reads the last complete one, so a failure leaves readers what
    they had; ``closed_only`` appends weeks once the watermark has passed.
    """
    files = spark.readStream.schema(schema).parquet(source)
    if closed_only:
        return (
            weekly_counts(files, ts, delay)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def add_version(batch: DataFrame, number: int) -> None:
        # One row per week: a single small file, which appears whole or not at all.
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/version={number}")

    return (
        weekly_counts(files, ts)
        .writeStream.outputMode("complete")
        .foreachBatch(add_version)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
