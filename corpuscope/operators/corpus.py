"""Document corpus: assembly, audits, phrase search and keyword-in-context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import round_date
from ..functions.text import contains_fixed, detect, str_trunc
from .scale import hash_rank

# Length bounds of a usable document, both exclusive.
MIN_LEN, MAX_LEN = 100, 1_000_000


def build_corpus(
    comments: DataFrame,
    attachments: DataFrame | None = None,
    min_len: int = MIN_LEN,
    max_len: int = MAX_LEN,
) -> DataFrame:
    """Comment texts (docOrder 0) and attachment texts as one table of documents.

    ``comments``: comment_id, text. ``attachments``: comment_id, docOrder, text.
    """
    docs = comments.select("comment_id", F.lit(0).alias("docOrder"), "text")
    if attachments is not None:
        docs = docs.unionByName(
            attachments.select("comment_id", F.col("docOrder").cast("int"), "text")
        )
    return docs.select(
        "comment_id",
        F.concat_ws("-", "comment_id", "docOrder").alias("doc_id"),
        "text",
        "docOrder",
        F.length("text").alias("len"),
    ).filter((F.col("len") > min_len) & (F.col("len") < max_len))


def with_row_id(corpus: DataFrame) -> DataFrame:
    """Dense numbers 1..N in hash order of ``doc_id``, without one global sort."""
    return hash_rank(corpus, "doc_id", "row", out="row_id")


def concat_texts(corpus: DataFrame, sep: str = "\n") -> DataFrame:
    """All texts of a comment, in document order, as one string.

    The result row is as long as the comment itself; use it for frames that
    people or a model read whole, not as a step towards counts.
    """
    docs = F.array_sort(F.collect_list(F.struct("docOrder", "text")))
    return corpus.groupBy("comment_id").agg(
        F.array_join(F.transform(docs, lambda d: d["text"]), sep).alias("text")
    )


def annotation_coverage(corpus: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents expected, annotated and missed, in one row."""
    have = annotations.select("doc_id").distinct().withColumn("have", F.lit(1))
    want = corpus.select("doc_id").distinct()
    return want.join(have, "doc_id", "left").agg(
        F.count("*").alias("n_corpus"),
        F.count("have").alias("n_annotated"),
        F.sum(F.when(F.col("have").isNull(), 1).otherwise(0)).alias("n_missing"),
    )


def unannotated(corpus: DataFrame, annotations: DataFrame) -> DataFrame:
    return corpus.join(annotations.select("doc_id").distinct(), "doc_id", "left_anti")


def empty_after_cleaning(corpus: DataFrame, cleaned: str = "text") -> DataFrame:
    """Documents whose text is empty; annotation refuses a corpus that has any."""
    return corpus.filter(F.length(cleaned) == 0)


def form_letters(corpus: DataFrame, phrase_groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Comments that hold any fixed phrase of any group, ignoring case."""
    flags = {
        name: reduce(lambda a, b: a | b, [contains_fixed("text", p) for p in phrases])
        for name, phrases in phrase_groups.items()
    }
    any_hit = reduce(lambda a, b: a | b, flags.values())
    return corpus.filter(any_hit).select("comment_id").distinct()


def form_letter_counts(
    corpus: DataFrame, phrase_groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Documents found per phrase group."""
    hits = [
        F.when(
            reduce(lambda a, b: a | b, [contains_fixed("text", p) for p in phrases]), F.lit(name)
        )
        for name, phrases in phrase_groups.items()
    ]
    return (
        corpus.select(F.explode(F.array_compact(F.array(*hits))).alias("form"))
        .groupBy("form")
        .agg(F.count("*").alias("n"))
    )


def kwic(corpus: DataFrame, target: str, text_col: str = "text", window: int = 20) -> DataFrame:
    """Each occurrence of a pattern with up to ``window`` characters around it.

    Documents are found with case, extracts ignore it, as the source analysis
    does; the window does not cross a line end.
    """
    around = f"(?i).{{0,{window}}}{target}.{{0,{window}}}"
    found = corpus.filter(F.col(text_col).rlike(target))
    extracts = F.regexp_extract_all(F.col(text_col), F.lit(around), F.lit(0))
    return found.select(
        *[c for c in corpus.columns if c != text_col], F.explode(extracts).alias("extracts")
    )


def keyword_flags(text: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    return text.withColumns(
        {name: detect("text", p, ignore_case=True) for name, p in patterns.items()}
    )


def submission_histogram(meta: DataFrame, ts: str, unit: str = "week") -> DataFrame:
    """Submissions per nearest week or month."""
    return meta.groupBy(round_date(ts, unit).alias(unit)).agg(F.count("*").alias("n"))


def early_outliers(
    meta: DataFrame, cutoff: str, text: DataFrame, date_col: str, key: str = "id", width: int = 500
) -> DataFrame:
    """Texts received before a date, shortened for reading."""
    early = meta.filter(F.col(date_col) < F.lit(cutoff))
    joined = early.join(text, early[key] == text["comment_id"], "inner")
    return joined.select(text["comment_id"], text["doc_id"], str_trunc(text["text"], width).alias("text"))


def text_length_audit(docs: DataFrame, min_len: int = MIN_LEN, max_len: int = MAX_LEN) -> DataFrame:
    """How many documents fall outside the length bounds, and from how many comments."""
    kind = (
        F.when(F.length("text") < min_len, "short")
        .when(F.length("text") > max_len, "long")
        .otherwise("usable")
    )
    return docs.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_docs"),
        F.countDistinct("comment_id").alias("n_comments"),
        F.max(F.length("text")).alias("longest"),
    )


def docs_per_comment(docs: DataFrame) -> DataFrame:
    return docs.groupBy("comment_id").agg(F.count("*").alias("n_docs"))
