"""From hand-coded labels to labels for the whole corpus.

Text becomes signed hash features as (comment, bucket, sign) rows. The lasso's path is
fitted on the labelled comments (``lasso``); the coefficients at one penalty are a table
of at most ``num_terms`` + 1 rows, and the corpus is scored by joining that table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import binary_hash, md5_int
from ..functions.stemming import stem
from ..functions.text import str_trunc
from .corpus import concat_texts
from .lasso import EVERY, held_out_counts
from .scale import join_by_frequency
from .tables import count_share, mark

POSITIVE = "oppose"
NEGATIVE = "support"
NUM_TERMS = 1024
WORD = r"[\p{L}\p{N}]+(?:['’]\p{L}+)*"


def training_set(text: DataFrame, coding: DataFrame, form_letters: DataFrame) -> DataFrame:
    """comment_id, support, text of labelled comments; form letters count as opposed."""
    wanted = coding.select("comment_id").union(form_letters.select("comment_id")).distinct()
    chosen = text.join(wanted, "comment_id", "left_semi")
    joined = concat_texts(chosen).join(coding.select("comment_id", "support"), "comment_id", "left")
    flagged = mark(joined, form_letters, "comment_id", "form_letter")
    label = F.when(F.col("form_letter"), POSITIVE).otherwise(F.col("support"))
    return (
        flagged.withColumn("support", label)
        .filter(F.col("support").isNotNull())
        .select("comment_id", "support", "text")
    )


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stem_table(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Stem of each distinct word."""
    return vocabulary.select(word).distinct().withColumn("stem", _stem(word))


def word_counts(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Words per comment without English stop words.

    ``max_chars`` cuts texts first, as the source analysis does with 3000; by
    default the whole text counts. A table of several documents per comment is
    counted as it is, without gluing the texts together.
    """
    text = F.col("text") if max_chars is None else str_trunc("text", max_chars, "")
    stop = StopWordsRemover.loadDefaultStopWords("english")
    found = docs.select(
        "comment_id", F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word")
    )
    return (
        found.filter(~F.col("word").isin(stop))
        .groupBy("comment_id", "word")
        .agg(F.count("*").alias("n"))
    )


def hashed_features(
    counts: DataFrame, num_terms: int = NUM_TERMS, stemming: bool = True
) -> DataFrame:
    """Non-zero signs of the signed hash counts: comment_id, bucket, sign.

    Stems and hashes are computed once per distinct word and joined back by the
    words' own frequencies.
    """
    vocab = counts.groupBy("word").agg(F.sum("n").alias("__freq"))
    term = _stem("word") if stemming else F.col("word")
    hashed = vocab.withColumn("term", term).select(
        "word",
        "__freq",
        F.pmod(md5_int(F.col("term")), F.lit(num_terms)).cast("int").alias("bucket"),
        F.when(md5_int(F.concat(F.lit("sign:"), "term")) % 2 == 0, 1).otherwise(-1).alias("s"),
    )
    joined = join_by_frequency(counts, hashed, "word", "__freq")
    signed = joined.groupBy("comment_id", "bucket").agg(
        binary_hash(F.sum(F.col("n") * F.col("s"))).alias("sign")
    )
    return signed.filter(F.col("sign") != 0)


def drop_zero_variance(features: DataFrame, n_comments: DataFrame) -> DataFrame:
    """Features of buckets that are not the same for every comment.

    ``n_comments`` is a one-row frame with the number of comments.
    """
    full = F.count("*") == n_comments.scalar()
    flat = features.groupBy("bucket").agg(
        (full & (F.min("sign") == F.max("sign"))).alias("flat")
    )
    return features.join(flat.filter("NOT flat").select("bucket"), "bucket", "left_semi")


def with_class_weights(df: DataFrame, label: str = "support") -> DataFrame:
    """Weights that make the classes count alike, as upsampling to parity does."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__size"))
    most = sizes.agg(F.max("__size"))
    weights = sizes.select(label, (most.scalar() / F.col("__size")).alias("weight"))
    return df.join(F.broadcast(weights), label)


def feature_vectors(labelled: DataFrame, features: DataFrame, num_terms: int = NUM_TERMS) -> DataFrame:
    """Labelled comments with an ML vector; comments without features get zeros.

    Meant for the hand-labelled comments and what is put to them, not for the corpus.
    """
    cells = features.groupBy("comment_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.col("sign").cast("double")))).alias("c")
    )
    at = F.sequence(F.lit(0), F.lit(num_terms - 1))
    dense = F.transform(at, lambda i: F.coalesce(F.try_element_at("c", i), F.lit(0.0)))
    joined = labelled.join(cells, "comment_id", "left")
    return joined.withColumn("features", array_to_vector(dense)).drop("c").withColumn(
        "label", (F.col("support") == POSITIVE).cast("double")
    )


def penalty_grid(levels: int = 30, low: float = -10.0, high: float = 0.0) -> list[float]:
    """Regular grid on the log10 scale."""
    return [10.0**x for x in np.linspace(low, high, levels)]


def metrics(
    predicted: DataFrame, truth: str = "support", estimate: str = "pred_class", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, sensitivity (share of opposed found), specificity, balanced accuracy."""
    t, e = F.col(truth), F.col(estimate)
    sensitivity = F.avg(F.when(t == POSITIVE, (e == POSITIVE).cast("double")))
    specificity = F.avg(F.when(t == NEGATIVE, (e == NEGATIVE).cast("double")))
    return predicted.groupBy(*by).agg(
        F.avg((t == e).cast("double")).alias("accuracy"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        ((sensitivity + specificity) / 2).alias("bal_accuracy"),
    )


def tune_lasso(rows: DataFrame, path: DataFrame, num_terms: int = NUM_TERMS) -> DataFrame:
    """Held-out metrics per penalty and fold of a lasso path, from counts of hits and misses."""
    counts = held_out_counts(rows, path, num_terms)
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return counts.select(
        "penalty",
        "fold",
        F.try_divide(tp + tn, tp + fn + tn + fp).alias("accuracy"),
        sensitivity.alias("sensitivity"),
        specificity.alias("specificity"),
        ((sensitivity + specificity) / 2).alias("bal_accuracy"),
    )


METRICS = ("accuracy", "bal_accuracy", "sensitivity", "specificity")


def collect_metrics(tuning: DataFrame) -> DataFrame:
    """Mean of each metric over folds, one row per penalty."""
    return tuning.groupBy("penalty").agg(*[F.avg(m).alias(m) for m in METRICS])


def show_best(tuning: DataFrame, metric: str = "bal_accuracy", n: int = 5) -> DataFrame:
    return collect_metrics(tuning).orderBy(F.desc(metric), "penalty").limit(n)


def best_coefficients(path: DataFrame, tuning: DataFrame, metric: str = "bal_accuracy") -> DataFrame:
    """bucket and beta of the fit on the whole training set at the best penalty; the intercept has bucket -1."""
    best = show_best(tuning, metric, 1).select("penalty")
    fitted = path.filter((F.col("fold") == EVERY) & (F.col("penalty") == best.scalar()))
    return fitted.select("bucket", "beta")


def fit_forest(train: DataFrame, trees: int = 1000, max_depth: int = 10, seed: int = 0):
    return RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, weightCol="weight", seed=seed
    ).fit(train)


def augment(comments: DataFrame, features: DataFrame, coefficients: DataFrame) -> DataFrame:
    """pred_class and pred_oppose for each comment.

    The coefficient table has at most ``num_terms`` + 1 rows, so it is broadcast;
    no vectors are built for the corpus.
    """
    beta = F.broadcast(coefficients.filter(F.col("bucket") >= 0))
    intercept = coefficients.filter(F.col("bucket") == -1).select("beta")
    scores = (
        features.join(beta, "bucket")
        .groupBy("comment_id")
        .agg(F.sum(F.col("sign") * F.col("beta")).alias("__z"))
    )
    joined = comments.join(scores, "comment_id", "left")
    z = F.coalesce("__z", F.lit(0.0)) + intercept.scalar()
    p = 1 / (1 + F.exp(-z))
    return (
        joined.withColumn("pred_oppose", p)
        .withColumn("pred_class", F.when(F.col("pred_oppose") > 0.5, POSITIVE).otherwise(NEGATIVE))
        .drop("__z")
    )


def augment_with_model(model, vectors: DataFrame) -> DataFrame:
    """The same columns from any fitted Spark ML classifier, on prepared vectors."""
    p = vector_to_array("probability")[1]
    return (
        model.transform(vectors)
        .withColumn("pred_oppose", p)
        .withColumn("pred_class", F.when(F.col("prediction") == 1.0, POSITIVE).otherwise(NEGATIVE))
        .drop("rawPrediction", "probability", "prediction")
    )


def load_imputed_full(imputed: DataFrame) -> DataFrame:
    return imputed.withColumnRenamed("pred_class", "support").drop("text")


def load_imputed_filtered(imputed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Only confident predictions: below 1 - threshold or above threshold."""
    p = F.col("pred_oppose")
    return load_imputed_full(imputed).filter((p < 1 - threshold) | (p > threshold))


def class_share(df: DataFrame, label: str = "support") -> DataFrame:
    return count_share(df, label)


def confident_class_share(imputed: DataFrame, threshold: float = 0.2) -> DataFrame:
    p = F.col("pred_oppose")
    return count_share(imputed.filter((p > 1 - threshold) | (p < threshold)), "pred_class")

