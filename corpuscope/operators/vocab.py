"""Adjective-noun bigrams, entropy scores and vocabulary selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_part
from ..session import written


def adj_noun_bigrams(annotations: DataFrame, nouns: Sequence[str]) -> DataFrame:
    """Adjectives whose head is one of the nouns, counted per comment.

    The token must equal the noun with case; the bigram is made of lemmas. Annotations are
    read once: nouns and adjectives are cut down, counted, and meet under the noun's place,
    whose keys lie within a sentence, so no key is frequent.
    """
    keys = ["comment_id", "doc_id", "sentence_id", "__at"]
    noun = F.col("token").isin(list(nouns)) & (F.col("pos") == "NOUN")
    adjective = (F.col("pos") == "ADJ") & (F.col("lemma") != "-")
    at = F.when(F.col("pos") == "ADJ", F.col("head_token_id").cast("int")).otherwise(F.col("token_id"))
    marked = annotations.filter(noun | adjective).select(
        "comment_id", "doc_id", "sentence_id", at.alias("__at"), (F.col("pos") == "ADJ").alias("adj"), "lemma"
    )
    counted = marked.groupBy(*keys, "adj", "lemma").agg(F.count("*").alias("n"))
    # Nulls meet nothing; as a filter this would reach the tokens and find all their heads.
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    sides = [
        F.collect_list(F.when(which & known, F.struct("lemma", "n"))).alias(name)
        for name, which in (("adjs", F.col("adj")), ("nouns", ~F.col("adj")))
    ]
    met = counted.groupBy(*keys).agg(*sides).select("comment_id", F.explode("adjs").alias("a"), "nouns")
    arcs = met.select("comment_id", "a", F.explode("nouns").alias("b"))
    return (
        arcs.select(
            "comment_id", F.concat_ws("_", "a.lemma", "b.lemma").alias("bigram"), (F.col("a.n") * F.col("b.n")).alias("n")
        )
        .groupBy("comment_id", "bigram")
        .agg(F.sum("n").alias("n"))
    )


def entropy_scores(dtm: DataFrame, document: str, term: str, n: str = "n") -> DataFrame:
    """Entropy of each term over documents, and its distance from the maximum.

    ``dtm`` has one row per document and term. With N the total of a term,
    H = log2 N - sum(n log2 n) / N, which one aggregation gives. ``n_docs``
    counts the term's documents; H is exactly 0 for a term of one document.
    The matrix is stored first, since it is read for its documents and its terms.
    """
    dtm = written(dtm.select(document, term, n), "scored")
    x = F.col(n).cast("double")
    n_docs = dtm.agg(F.countDistinct(document))
    scores = dtm.groupBy(term).agg(
        F.sum(n).alias("n"),
        F.count("*").alias("n_docs"),
        F.sum(x * F.log2(x)).alias("__s"),
    )
    total = F.col("n").cast("double")
    h = F.when(F.col("n_docs") == 1, F.lit(0.0)).otherwise(
        F.log2(total) - F.col("__s") / total
    )
    return (
        scores.withColumn("H", h)
        .withColumn("dH", F.log2(n_docs.scalar().cast("double")) - F.col("H"))
        .withColumn("ndH", F.log10(total) * F.col("dH"))
        .select(term, "n", "n_docs", "H", "dH", "ndH")
    )


def vocabulary(scores: DataFrame, term: str = "bigram") -> DataFrame:
    """Terms with H > 0, that is those of two or more documents."""
    return scores.filter(F.col("n_docs") >= 2).select(term)


def select_vocab(bigrams: DataFrame, scores: DataFrame, term: str = "bigram") -> DataFrame:
    return bigrams.join(vocabulary(scores, term), term, "left_semi")


def extract_noun(df: DataFrame, bigram: str = "bigram", noun: str = "noun") -> DataFrame:
    return df.withColumn(noun, last_part(bigram))


def noun_counts(scores: DataFrame) -> DataFrame:
    """Bigrams per noun, all and those in the vocabulary."""
    return (
        extract_noun(scores)
        .groupBy("noun")
        .agg(
            F.count("*").alias("n_all"),
            F.sum(F.when(F.col("n_docs") >= 2, 1).otherwise(0)).alias("n_vocab"),
        )
    )
