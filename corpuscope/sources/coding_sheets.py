"""Sheets that coders fill in, and what comes back from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import build_url, str_trunc, strip_html_sheet
from ..operators.scale import hash_order

SHEET = "comment_id string, url string, text string, support string, notes string"


def coding_sheet(sample: DataFrame, text: DataFrame, width: int = 750) -> DataFrame:
    """One row per sampled comment with the start of each of its texts.

    Texts are shortened before they are collected, so a comment with very many
    documents brings at most ``width`` characters each.
    """
    short = text.join(sample.select("comment_id").distinct(), "comment_id", "left_semi").select(
        "comment_id", "docOrder", str_trunc("text", width).alias("text")
    )
    docs = F.array_sort(F.collect_list(F.struct("docOrder", "text")))
    joined = F.array_join(F.transform(docs, lambda d: d["text"]), "\n\n")
    sheet = short.groupBy("comment_id").agg(strip_html_sheet(joined).alias("text"))
    return sheet.select(
        "comment_id",
        build_url("comment_id").alias("url"),
        "text",
        F.lit("").alias("support"),
        F.lit("").alias("notes"),
    )


def write_sheet(sheet: DataFrame, path: str, seed: int = 0) -> None:
    """Shuffled CSV for the coders."""
    sheet.orderBy(hash_order("comment_id", seed)).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').option("multiLine", True).csv(path)


def read_codings(spark: SparkSession, folder: str) -> DataFrame:
    """All coders' sheets, the coder taken from the file name or its folder.

    Layout is ``<folder>/<coder>.csv`` or ``<folder>/coder=<coder>/*.csv``.
    """
    rows = (
        spark.read.schema(SHEET)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
        .csv(folder)
        .select("*", F.col("_metadata.file_path").alias("__path"))
    )
    by_folder = F.regexp_extract("__path", r"/coder=([^/]+)/[^/]+$", 1)
    by_file = F.regexp_extract("__path", r"/([^/]+)\.csv$", 1)
    coder = F.when(by_folder != "", by_folder).otherwise(by_file)
    return rows.withColumn("coder", coder).drop("text", "__path")


def discordance_sheet(coding: DataFrame) -> DataFrame:
    """Comments whose coders disagree, with blanks for nulls and tied modes joined."""
    rest = [c for c in coding.columns if c not in ("comment_id", "url", "mode", "identical")]
    flat = F.array_join(F.transform("mode", lambda m: F.coalesce(m, F.lit(""))), "")
    return (
        coding.filter(~F.col("identical"))
        .select(
            "comment_id",
            "url",
            flat.alias("mode"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rest],
            "identical",
        )
    )
