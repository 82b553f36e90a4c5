"""Counts over annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import not_in
from ..functions.text import build_url
from .scale import join_by_frequency
from .tables import count_share, exact_quantiles, weighted_mean

# Parts of speech that are not words, for term counts and for lengths.
NON_WORDS = ("PUNCT", "SPACE", "SYM", "X", "NUM")
NON_LENGTH = ("PUNCT", "SPACE", "NUM")


def words(tokens: DataFrame, exclude: Sequence[str] = NON_WORDS) -> DataFrame:
    """Word tokens; a token without a part of speech counts as a word."""
    return tokens.filter(not_in("pos", exclude))


def doc_term_matrix(tokens: DataFrame, exclude: Sequence[str] = NON_WORDS) -> DataFrame:
    return words(tokens, exclude).groupBy("comment_id", "lemma").agg(F.count("*").alias("n"))


def comment_length(tokens: DataFrame, exclude: Sequence[str] | None = NON_LENGTH) -> DataFrame:
    """Tokens per comment; ``exclude=None`` counts all of them."""
    counted = tokens if exclude is None else words(tokens, exclude)
    return counted.groupBy("comment_id").agg(F.count("*").alias("len"))


def length_quantiles(dtm: DataFrame) -> DataFrame:
    lengths = dtm.groupBy("comment_id").agg(F.sum("n").alias("n"))
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
    return exact_quantiles(lengths, "n", probs)


def short_comments(dtm: DataFrame, text: DataFrame, k: int = 12) -> DataFrame:
    """Comments of at most k words with their texts."""
    lengths = dtm.groupBy("comment_id").agg(F.sum("n").alias("n"))
    return lengths.filter(F.col("n") <= k).join(text, "comment_id", "left")


def pos_distribution(tokens: DataFrame) -> DataFrame:
    return count_share(tokens, "pos")


def value_counts(tokens: DataFrame, pos: str, column: str = "lemma") -> DataFrame:
    return tokens.filter(F.col("pos") == pos).groupBy(column).agg(F.count("*").alias("n"))


def term_search(tokens: DataFrame, pattern: str) -> DataFrame:
    """Counts of lemma and part of speech for lemmas that match."""
    return (
        tokens.filter(F.col("lemma").rlike(pattern))
        .groupBy("lemma", "pos")
        .agg(F.count("*").alias("n"))
    )


def comments_using(tokens: DataFrame, pattern: str, pos: str = "NOUN") -> DataFrame:
    """Number of comments that use a matching lemma as the given part of speech."""
    return tokens.filter((F.col("pos") == pos) & F.col("lemma").rlike(pattern)).agg(
        F.countDistinct("comment_id").alias("n_comments")
    )


def mean_idf(dtm: DataFrame) -> DataFrame:
    """Mean of 1 / occurrences over a comment's words; high for garbled text.

    The few lemmas that make up much of any text are joined by broadcast.
    """
    idf = dtm.groupBy("lemma").agg(F.sum("n").alias("df")).withColumn("idf", 1 / F.col("df"))
    joined = join_by_frequency(dtm, idf, "lemma", "df")
    means = joined.groupBy("comment_id").agg(weighted_mean("idf", "n").alias("mean_idf"))
    return means.withColumn("url", build_url("comment_id"))
