"""Comparisons between two sides, for several codings at once.

A *codings* frame has columns coding, comment_id, support. Every statistic is
grouped by ``coding``, so all label sets are computed in one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import log1kp
from .corpus import keyword_flags
from .tables import (
    complete,
    exact_quantiles,
    histogram,
    pivot_fill,
    pivot_many,
    share_within,
    sum_and_mean,
    top_and_bottom,
    top_n,
    value_order,
    with_group_value,
)
from .vocab import extract_noun

SIDES = ("oppose", "support")


def n_docs_table(codings: DataFrame, has_missing: bool = False) -> DataFrame:
    """Distinct comments and shares per coding and side, wide, with a total."""
    levels = [*SIDES, "NA"] if has_missing else list(SIDES)
    named = codings.withColumn("support", F.coalesce("support", F.lit("NA")))
    if not has_missing:
        named = named.filter(F.col("support") != "NA")
    counts = named.groupBy("coding", "support").agg(
        F.countDistinct("comment_id").alias("n_docs")
    )
    shares = share_within(counts, ["coding"], "n_docs", "perc")
    wide = pivot_many(shares, ["coding"], "support", ["n_docs", "perc"], levels)
    wide = wide.na.fill(0, [f"n_docs_{x}" for x in levels])
    wide = wide.na.fill(0.0, [f"perc_{x}" for x in levels])
    total = sum((F.col(f"n_docs_{x}") for x in levels), F.lit(0).cast("long"))
    return wide.withColumn("total", total)


def coded_bigrams(bigrams: DataFrame, codings: DataFrame) -> DataFrame:
    """Bigrams of comments that are on one of the two sides, with their noun."""
    sided = codings.filter(F.col("support").isin(*SIDES)).select(
        "coding", "comment_id", "support"
    )
    return extract_noun(bigrams.join(sided, "comment_id", "inner"))


def distinct_comments(coded: DataFrame) -> DataFrame:
    return coded.groupBy("coding").agg(F.countDistinct("comment_id").alias("n_comments"))


def noun_share(coded: DataFrame, nouns: Sequence[str] | None = None) -> DataFrame:
    """Share of a comment's distinct bigrams that go to each noun, zeros included."""
    keys = ["coding", "support", "comment_id"]
    counts = coded.groupBy(*keys, "noun").agg(F.count("*").alias("n"))
    filled = complete(counts, keys, "noun", "n", nouns)
    return share_within(filled, keys, "n")


def noun_share_summary(shares: DataFrame) -> DataFrame:
    """Mean and median share by coding, noun and side."""
    by = ["coding", "noun", "support"]
    table = exact_quantiles(shares, "share", {"share_median": 0.5}, by, moments=True)
    return table.select(
        *by, F.col("size").alias("n_docs"), F.col("mean").alias("share_mean"), "share_median"
    )


def noun_share_table(shares: DataFrame, nouns: Sequence[str]) -> DataFrame:
    """The summary with one pair of columns per noun."""
    return pivot_many(
        noun_share_summary(shares),
        ["coding", "support", "n_docs"],
        "noun",
        ["share_mean", "share_median"],
        nouns,
    )


def occurrence(coded: DataFrame, term: str, out: str = "n") -> DataFrame:
    """Share of each side's comments that contain a term.

    Rows are first made distinct and counted; the few side totals then meet the
    counts, not the rows.
    """
    by = ["coding", "support"]
    totals = coded.groupBy(*by).agg(F.countDistinct("comment_id").alias("n_docs"))
    counts = (
        coded.select(*by, "comment_id", term)
        .distinct()
        .groupBy(*by, term)
        .agg(F.count("*").alias(out))
    )
    sized = with_group_value(counts, totals, by, "n_docs")
    return sized.withColumn("p", F.col(out) / F.col("n_docs"))


def noun_occurrence(coded: DataFrame) -> DataFrame:
    return occurrence(coded, "noun")


def bigram_occurrence(coded: DataFrame) -> DataFrame:
    return occurrence(coded, "bigram", "df")


def bigram_top_n(p_df: DataFrame, n: int = 10) -> DataFrame:
    return top_n(p_df, "p", n, ["coding", "support"])


def bigram_display(p_df: DataFrame, n: int = 15) -> DataFrame:
    """Top bigrams with their noun and display position."""
    top = extract_noun(bigram_top_n(p_df, n))
    return value_order(top, ["coding", "support"], "p")


def bigram_llr(p_df: DataFrame, k: int = 5) -> DataFrame:
    """log10(p_oppose + 10^-k) - log10(p_support + 10^-k), absent terms as 0."""
    wide = pivot_fill(p_df, ["coding", "bigram"], "support", "p", SIDES, 0.0)
    return wide.withColumn("llr", log1kp("oppose", k) - log1kp("support", k))


def llr_extremes(llr: DataFrame, n: int, term: str = "bigram") -> DataFrame:
    """Terms that speak most for either side, with display position."""
    both = top_and_bottom(llr, "llr", n, ["coding"])
    named = both.withColumn(
        "side", F.when(F.col("side") == "top", "oppose").otherwise("support")
    )
    picked = named.select("coding", "side", term, "llr")
    return value_order(picked, ["coding", "side"], "llr")


def median_llr_by_noun(llr: DataFrame) -> DataFrame:
    return exact_quantiles(extract_noun(llr), "llr", {"llr": 0.5}, ["coding", "noun"])


def median_df(p_df: DataFrame) -> DataFrame:
    """Median document frequency per side, bigrams absent on a side counted as 0."""
    filled = complete(p_df, ["coding", "bigram"], "support", "df", SIDES)
    return exact_quantiles(filled, "df", {"df": 0.5}, ["coding", "support"])


def token_llr(tokens: DataFrame, codings: DataFrame) -> DataFrame:
    """log1p difference of document frequency shares for every lemma, any part of speech."""
    sided = codings.filter(F.col("support").isin(*SIDES)).select(
        "coding", "comment_id", "support"
    )
    per_side = [F.count_if(F.col("support") == side).alias(side) for side in SIDES]
    totals = sided.groupBy("coding").agg(F.struct(*per_side).alias("total"))
    counts = (
        tokens.select("comment_id", "lemma")
        .distinct()
        .join(sided, "comment_id", "inner")
        .groupBy("coding", "lemma")
        .agg(F.struct(*per_side).alias("n"))
    )
    sized = with_group_value(counts, totals, ["coding"], "total")
    shares = [
        F.when(F.col(f"total.{x}") > 0, F.col(f"n.{x}") / F.col(f"total.{x}")).otherwise(0.0).alias(x)
        for x in SIDES
    ]
    wide = sized.select("coding", "lemma", *shares)
    return wide.withColumn("llr", F.log1p("oppose") - F.log1p("support"))


def length_by_support(lengths: DataFrame, codings: DataFrame) -> DataFrame:
    sided = codings.select("coding", "comment_id", "support")
    return lengths.join(sided, "comment_id", "inner")


def length_histogram(by_support: DataFrame, length: str = "len", bins: int = 80) -> DataFrame:
    """Frequency polygon of log10 length per coding and side."""
    return histogram(by_support, F.log10(F.col(length)), bins, ["coding", "support"])


def keyword_occurrence(
    text: DataFrame, codings: DataFrame, patterns: Mapping[str, str]
) -> DataFrame:
    """Comments of each side that hold each keyword in any of their documents."""
    names = list(patterns)
    per_comment = (
        keyword_flags(text.select("comment_id", "text"), patterns)
        .groupBy("comment_id")
        .agg(*[F.bool_or(c).alias(c) for c in names])
    )
    joined = per_comment.join(codings.select("coding", "comment_id", "support"), "comment_id")
    return joined.groupBy("coding", "support").agg(
        F.count("*").alias("n"), *sum_and_mean(names)
    )
