"""Coders' labels: reconciliation and agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_keep_na
from .tables import columns_like, pivot_many


def row_modes(values: Column) -> Column:
    """All most frequent entries of an array, nulls counted, in order of appearance."""
    kinds = F.array_distinct(values)
    counts = F.transform(kinds, lambda v: F.size(F.filter(values, lambda x: x.eqNullSafe(v))))
    return F.filter(kinds, lambda v, i: F.get(counts, i) == F.array_max(counts))


def normalise_codes(sheets: DataFrame) -> DataFrame:
    return sheets.withColumn("support", lower_keep_na("support"))


def coding_table(
    sheets: DataFrame, coders: Sequence[str], urls_from: str | None = None
) -> DataFrame:
    """One row per comment: each coder's code and notes, unanimity and mode(s).

    ``sheets`` is long: coder, comment_id, url, support, notes.
    """
    codes = normalise_codes(sheets)
    wide = pivot_many(codes, ["comment_id"], "coder", ["support", "notes"], coders)
    values = F.array(*[F.col(f"support_{c}") for c in coders])
    judged = wide.withColumn("identical", F.size(F.array_distinct(values)) == 1).withColumn(
        "mode", row_modes(values)
    )
    source = codes if urls_from is None else codes.filter(F.col("coder") == urls_from)
    urls = source.groupBy("comment_id").agg(F.min("url").alias("url"))
    joined = judged.join(urls, "comment_id", "left")
    return joined.select(
        "comment_id", "url", *[c for c in judged.columns if c != "comment_id"]
    )


def repeated_comments(coding: DataFrame) -> DataFrame:
    """Comments with more than one row; empty when the table is sound."""
    return coding.groupBy("comment_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def krippendorff_alpha(
    codes: DataFrame, unit: str = "comment_id", value: str = "support"
) -> DataFrame:
    """Nominal alpha over units with at least two values; nulls are missing.

    Undefined, hence null, when only one value occurs.

    From the value counts per unit, the coincidence matrix's diagonal and its
    margins are all that the nominal coefficient needs, so no pairs are formed.
    """
    counts = (
        codes.filter(F.col(value).isNotNull())
        .groupBy(unit, value)
        .agg(F.count("*").cast("double").alias("c"))
    )
    sizes = counts.groupBy(unit).agg(F.sum("c").alias("m")).filter(F.col("m") >= 2)
    usable = counts.join(sizes, unit)
    margins = usable.groupBy(value).agg(
        F.sum("c").alias("nc"),
        F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"),
    )
    n, same = F.sum("nc"), F.sum("same")
    squares = F.sum(F.col("nc") * F.col("nc"))
    return margins.agg(
        n.cast("long").alias("n_values"),
        (1 - F.try_divide((n - 1) * (n - same), n * n - squares)).alias("alpha"),
    )


def discordant(coding: DataFrame) -> DataFrame:
    return coding.filter(~F.col("identical"))


def load_manual_coding(coding: DataFrame, filter_na: bool = False) -> DataFrame:
    """Sides from unique modes: y is support, n is oppose, anything else null."""
    flat = F.array_join(F.transform("mode", lambda m: F.coalesce(m, F.lit("NA"))), "")
    slim = columns_like(columns_like(coding, starts="support", drop=True), starts="notes", drop=True)
    out = slim.withColumn(
        "support", F.when(flat == "y", "support").when(flat == "n", "oppose")
    ).drop("mode")
    return out.filter(F.col("support").isNotNull()) if filter_na else out
