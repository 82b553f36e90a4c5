"""Queries opN_<name> over the whole tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, exact_dedup, fingerprints, manifest, merges, mixing, near_dedup, pii, quality, substring_dedup, token_counts, urls, variants,
)
from .common import read
from .sql import OP10, OP11, OP12, OP2, OP3, OP9

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
#: A deployment passes its own secret.
PII_KEY = "corpuscope"
MERGES_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


@cache
def merge_vocabulary(path: str = public_tokenizers.path(MERGES_FILE)) -> merges.Merges:
    return merges.Merges(path)


@cache
def vocabulary(path: str = public_tokenizers.path(BPE_FILE), pattern: str = public_tokenizers.PATTERN) -> bpe.Vocabulary:
    return bpe.Vocabulary(bpe.load_ranks(path), pattern)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), vocabulary())


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("h")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return exact_dedup.exact_duplicates(docs).drop("n_chars")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = pii.pseudonymise(read(spark, sf_dir, "documents"), PII_KEY)
    return masked.select(
        "doc_id", F.size("pii").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",").alias("kinds"),
        "text",
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_limits(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_FILE))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "text_score", "meta_score", "quality_score", "kept")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_likeness(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.digest("prints").alias("fingerprint"), fingerprints.digest("edited_prints").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    return urls.filter_urls(read(spark, sf_dir, "pages"), outcomes)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_manifest(read(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.token_digests(read(spark, sf_dir, "documents"), merge_vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_source_mix, op3_exact_dedup, op4_pii, op5_token_counts, op6_quality, op7_near_dedup,
        op8_fingerprints, op9_url_filter, op10_substring_dedup, op11_spelling_variants, op12_merkle_manifest, op13_bpe,
    )
}
SQL: dict[str, str] = {
    "op2_source_mix": OP2, "op3_exact_dedup": OP3, "op9_url_filter": OP9, "op10_substring_dedup": OP10,
    "op11_spelling_variants": OP11, "op12_merkle_manifest": OP12,
}
