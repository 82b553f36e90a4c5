"""Incremental ingest and counts over the events, landed as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from ..streaming import ingest_listing_stream, submissions_stream, weekly_table
from . import inputs as I
from .catalog import query
from .ingest import _EVENT_COLUMNS, _TS, overlapping_blocks
from .text import _WEEK


@query(f"SELECT {_EVENT_COLUMNS} FROM events")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping blocks, landed the newest first, give each row once."""
    landing = fresh_path(spark, "landing")
    blocks = overlapping_blocks(spark, sf_dir)
    target, checkpoint = fresh_path(spark, "listing"), fresh_path(spark, "progress")
    for landed in (blocks[1:], blocks[:1]):
        for block in landed:
            block.write.mode("append").parquet(landing)
        ingest_listing_stream(
            spark, landing, blocks[0].schema, target, checkpoint, "ts", ["event_id", "ts"]
        ).awaitTermination()
    rows = spark.read.parquet(target)
    return rows.select("event_id", F.date_format("ts", _TS).alias("ts"), "user_id", "event_type", "props")


@query(f"SELECT {_WEEK} AS week, count(*) AS n FROM (SELECT ts::DATE AS d FROM events) GROUP BY 1")
def weekly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly table, brought up to date from two landings."""
    landing = fresh_path(spark, "submissions")
    target, checkpoint = fresh_path(spark, "weekly"), fresh_path(spark, "progress")
    events = I.table(spark, sf_dir, "events")
    early = F.to_date("ts") < F.lit("2024-01-16")
    for part in (events.filter(early), events.filter(~early)):
        part.write.mode("append").parquet(landing)
        submissions_stream(spark, landing, events.schema, target, checkpoint, "ts").awaitTermination()
    return weekly_table(spark, target)


@query(f"""SELECT {_WEEK} AS week, count(*) AS n FROM (SELECT ts::DATE AS d FROM events) GROUP BY 1
HAVING {_WEEK} < (SELECT max({_WEEK}) FROM (SELECT ts::DATE AS d FROM events))""")
def weekly_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only form holds the weeks that are over."""
    landing = fresh_path(spark, "submissions")
    target, checkpoint = fresh_path(spark, "weekly"), fresh_path(spark, "progress")
    events = I.table(spark, sf_dir, "events")
    events.write.parquet(landing)
    submissions_stream(
        spark, landing, events.schema, target, checkpoint, "ts", "1 day", closed_only=True
    ).awaitTermination()
    return spark.read.parquet(target)
