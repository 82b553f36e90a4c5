"""Choosing comments for hand coding along a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep_first, mark, sample_fixed, top_and_bottom


def sample_for_coding(
    scores: DataFrame,
    exclude: DataFrame,
    n: int = 200,
    seed: int | str = 0,
    key: str = "comment_id",
    value: str = "value",
) -> DataFrame:
    """n extreme comments on each side with ties, and 2n others from the rest.

    Comments in ``exclude`` (form letters) take no part. A comment on both sides
    keeps its first side: top, then bottom.
    """
    eligible = scores.select(key, value).join(
        exclude.select(key).distinct(), key, "left_anti"
    )
    extremes = top_and_bottom(eligible, value, n)
    rest = eligible.join(extremes.select(key).distinct(), key, "left_anti")
    others = sample_fixed(rest, key, 2 * n, seed).withColumn("side", F.lit("random"))
    order = F.when(F.col("side") == "top", 1).when(F.col("side") == "bottom", 2).otherwise(3)
    tagged = extremes.unionByName(others).withColumn("__o", order)
    return keep_first(tagged, [key], ["__o"]).drop("__o")


def loading_distribution(
    scores: DataFrame, form_letters: DataFrame, sample: DataFrame, key: str = "comment_id"
) -> DataFrame:
    """Scores flagged as form letter and as part of the coding sample."""
    flagged = mark(scores, form_letters, key, "form_letter")
    return flagged.join(sample.select(key, "side"), key, "left")
