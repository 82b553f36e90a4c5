"""The given tables, seen as comments, attachments, coder sheets and codings.

documents are comments (docOrder 0); conversation turns are further documents of
the comment with the same number; labels (quality 1 = oppose, 0 = support) are
the basis of four coders' sheets, some of whose codes are changed by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agreement import coding_table, load_manual_coding
from ..operators.annotate import annotate, tagged_tokens
from ..operators.classify import load_imputed_filtered, load_imputed_full
from ..operators.corpus import build_corpus
from ..operators.tables import tagged_union
from ..operators.vocab import adj_noun_bigrams
from ..session import spread

CODERS = ("c0", "c1", "c2", "c3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").cast("string").alias("comment_id"), "text"
        )
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("comment_id"),
        (F.col("turn") + 1).cast("int").alias("docOrder"),
        "text",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents before the length filter."""
    first = comments(spark, sf_dir).select("comment_id", F.lit(0).alias("docOrder"), "text")
    return first.unionByName(attachments(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_corpus(comments(spark, sf_dir), attachments(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_tokens(corpus(spark, sf_dir))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(corpus(spark, sf_dir))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long coder sheets: coder, comment_id, url, support, notes."""
    labels = table(spark, sf_dir, "labels")
    base = F.when(F.col("quality") == 1, "n").otherwise("y")
    flipped = F.when(F.col("quality") == 1, "y").otherwise("n")

    def entry(k: int):
        code = (
            F.when((F.col("doc_id") + k) % 31 == 0, "NA")
            .when((F.col("doc_id") + 7 * k) % 21 == 0, flipped)
            .otherwise(base)
        )
        return F.struct(
            F.lit(CODERS[k]).alias("coder"),
            (F.upper(code) if k == 1 else code).alias("support"),
            F.when(F.col("toxic") == 1, F.concat(F.lit("note "), F.lit(k))).alias("notes"),
        )

    entries = F.array(*[entry(k) for k in range(len(CODERS))])
    return labels.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.concat(F.lit("https://www.regulations.gov/comment/"), F.col("doc_id")).alias("url"),
        F.inline(entries),
    ).select("coder", "comment_id", "url", "support", "notes")


def coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_table(sheets(spark, sf_dir), CODERS, urls_from=CODERS[2])


def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for model output, the same on every engine."""
    p = ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0)
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").cast("string").alias("comment_id"), "text", p.alias("pred_oppose"))
        .withColumn("pred_class", F.when(F.col("pred_oppose") > 0.5, "oppose").otherwise("support"))
    )


def codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three label sets as one frame: coding, comment_id, support."""
    guess = imputed(spark, sf_dir)
    frames = {
        "manual": load_manual_coding(coding(spark, sf_dir)),
        "filtered": load_imputed_filtered(guess),
        "imputed": load_imputed_full(guess),
    }
    return tagged_union({k: v.select("comment_id", "support") for k, v in frames.items()})


# Nouns of the invented prose that the bigram queries are about.
NOUNS = tuple("anea th er thth re ea ti nd es en ou nt sh wh".split())


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj_noun_bigrams(annotations(spark, sf_dir), NOUNS)
