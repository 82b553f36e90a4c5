"""Landed listing pages: flattening, block planning, dedupe and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import eastern_cursor, parse_utc
from .schemas import LISTING_ATTRIBUTES, LISTING_JSON

# Limits of the listing service.
BLOCK_MAX = 5000
PAGE_SIZE = 250
MAX_PAGES = 20


def read_listing_json(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    raw = spark.read.schema(LISTING_JSON).json(path, multiLine=True)
    return flatten_listing(raw, doc_id)


def flatten_listing(pages: DataFrame, doc_id: str | None = None) -> DataFrame:
    """One row per listed item, attribute names without their prefix."""
    items = pages.select(F.explode("data").alias("d")).select(
        F.col("d.id").alias("id"),
        *[F.col(f"d.attributes.{a}").alias(a) for a in LISTING_ATTRIBUTES],
    )
    return items if doc_id is None else items.withColumn("comment_on", F.lit(doc_id))


def rule_documents(docs: DataFrame) -> DataFrame:
    """Rules and proposed rules under the names that later steps use."""
    return docs.filter(F.col("documentType").isin("Rule", "Proposed Rule")).select(
        "id",
        F.col("objectId").alias("objectid"),
        F.col("documentType").alias("type"),
        "title",
        F.col("postedDate").alias("posted"),
    )


def plan_blocks(docs: DataFrame, id_col: str = "objectid", total: str = "comments") -> DataFrame:
    """Blocks and pages that a listing of ``total`` items needs."""
    t = F.col(total).cast("long")
    blocks = F.sequence(F.lit(1).cast("long"), F.floor(t / BLOCK_MAX) + 1)
    size = F.least(t - (F.col("block") - 1) * BLOCK_MAX, F.lit(BLOCK_MAX).cast("long"))
    pages = F.least(F.floor(F.col("block_size") / PAGE_SIZE) + 1, F.lit(MAX_PAGES).cast("long"))
    return (
        docs.filter(t > 0)
        .select(id_col, F.col(total), F.explode(blocks).alias("block"))
        .withColumn("block_size", size)
        .withColumn("pages", pages)
    )


def dedupe_blocks(*blocks: DataFrame) -> DataFrame:
    """Blocks overlap at the cursor date; drop fully repeated rows."""
    return reduce(lambda a, b: a.unionByName(b), blocks).dropDuplicates()


def next_cursor(listing: DataFrame, by: str = "comment_on", ts: str = "lastModifiedDate") -> DataFrame:
    """Latest modification per document, as the text the service queries by."""
    stamp = F.col(ts)
    if listing.schema[ts].dataType.typeName() == "string":
        stamp = parse_utc(stamp)
    return listing.groupBy(by).agg(F.max(stamp).alias("__last")).select(
        by, eastern_cursor("__last").alias("cursor")
    )


def reconcile_counts(
    listing: DataFrame, docs: DataFrame, by: str = "comment_on", doc_key: str = "objectid",
    announced: str = "comments",
) -> DataFrame:
    """Announced against retrieved counts; a non-zero difference is a failure."""
    wanted = docs.filter(F.col(announced) > 0).select(
        F.col(doc_key).alias(by), F.col(announced).cast("long").alias("announced")
    )
    got = listing.groupBy(by).agg(F.count("*").alias("retrieved"))
    joined = wanted.join(got, by, "full_outer")
    return joined.select(
        by,
        F.coalesce("announced", F.lit(0)).alias("announced"),
        F.coalesce("retrieved", F.lit(0)).alias("retrieved"),
        (F.coalesce("retrieved", F.lit(0)) - F.coalesce("announced", F.lit(0))).alias("diff"),
    )
