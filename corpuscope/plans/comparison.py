"""Statistics of the two sides for the three label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as S
from ..operators import tokens as K
from ..operators.annotate import tagged_tokens
from ..session import written
from . import inputs as I
from .catalog import query
from .labels import model_codings
from .sql import sql
from .text import vocab_bigrams
from .verbs import r6


def _wide(table: str, has_missing: bool) -> str:
    sides = ["oppose", "support"] + (["NA"] if has_missing else [])
    cells = ", ".join(f"count(DISTINCT comment_id) FILTER (side = '{s}') AS n_docs_{s}" for s in sides)
    total = " + ".join(f"n_docs_{s}" for s in sides)
    shares = ", ".join(f"round(n_docs_{s} / ({total})::DOUBLE, 6) AS perc_{s}" for s in sides)
    names = ", ".join(f"n_docs_{s}" for s in sides)
    return (
        f"SELECT coding, {names}, {shares}, CAST({total} AS BIGINT) AS total FROM (SELECT coding, {cells} "
        f"FROM (SELECT coding, comment_id, coalesce(support, 'NA') AS side FROM {table}) GROUP BY 1)"
    )


@query(sql(_wide("codings", True), "codings"))
def n_docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.n_docs_table(I.codings(spark, sf_dir), has_missing=True))


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(S.coded_bigrams(vocab_bigrams(spark, sf_dir), I.codings(spark, sf_dir)), "coded")


@query(sql(_wide("coded", False), "coded"))
def n_docs_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.n_docs_table(_coded(spark, sf_dir)))


@query(sql("SELECT coding, comment_id, support, bigram, n, noun FROM coded", "coded"))
def coded_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coded_bigrams(vocab_bigrams(spark, sf_dir), I.codings(spark, sf_dir))


@query(sql("SELECT coding, count(DISTINCT comment_id) AS n_comments FROM coded GROUP BY 1", "coded"))
def coded_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distinct_comments(_coded(spark, sf_dir))


_SHARES = """(SELECT d.coding, d.support, d.comment_id, n.noun, coalesce(c.n, 0) AS n,
  coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY d.coding, d.comment_id) AS share
FROM (SELECT DISTINCT coding, support, comment_id FROM coded) d CROSS JOIN (SELECT DISTINCT noun FROM coded) n
LEFT JOIN (SELECT coding, comment_id, noun, count(*) AS n FROM coded GROUP BY 1, 2, 3) c
  ON c.coding = d.coding AND c.comment_id = d.comment_id AND c.noun = n.noun)"""


@query(sql(f"SELECT coding, support, comment_id, noun, n, round(share, 6) AS share FROM {_SHARES}", "coded"))
def noun_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.noun_share(_coded(spark, sf_dir)))


@query(
    sql(
        f"""SELECT coding, noun, support, count(DISTINCT comment_id) AS n_docs, round(avg(share), 6) AS share_mean,
  round(quantile_cont(share, 0.5), 6) AS share_median FROM {_SHARES} GROUP BY 1, 2, 3""",
        "coded",
    )
)
def noun_share_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.noun_share_summary(S.noun_share(_coded(spark, sf_dir))))


_TWO = ("anea", "th")


@query(
    sql(
        "SELECT coding, support, count(DISTINCT comment_id) AS n_docs, "
        + ", ".join(f"round(avg(share) FILTER (noun = '{n}'), 6) AS share_mean_{n}" for n in _TWO)
        + ", "
        + ", ".join(f"round(quantile_cont(share, 0.5) FILTER (noun = '{n}'), 6) AS share_median_{n}" for n in _TWO)
        + f" FROM {_SHARES} GROUP BY 1, 2",
        "coded",
    )
)
def noun_share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.noun_share_table(S.noun_share(_coded(spark, sf_dir)), _TWO))


@query(
    sql(
        """SELECT coding, support, noun, count(DISTINCT comment_id) AS n, any_value(n_docs) AS n_docs,
  round(count(DISTINCT comment_id) / any_value(n_docs)::DOUBLE, 6) AS p
FROM coded JOIN side_docs USING (coding, support) GROUP BY 1, 2, 3""",
        "coded",
        "side_docs",
    )
)
def noun_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.noun_occurrence(_coded(spark, sf_dir)))


@query(sql("SELECT coding, support, bigram, df, n_docs, round(p, 6) AS p FROM p_bigram", "p_bigram"))
def bigram_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.bigram_occurrence(_coded(spark, sf_dir)))


_TOP = "(SELECT *, rank() OVER (PARTITION BY coding, support ORDER BY p DESC) AS r FROM p_bigram)"


@query(sql(f"SELECT coding, support, bigram, df, n_docs, round(p, 6) AS p FROM {_TOP} WHERE r <= 10", "p_bigram"))
def bigram_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.bigram_top_n(S.bigram_occurrence(_coded(spark, sf_dir)), 10))


@query(
    sql(
        f"""SELECT coding, support, bigram, round(p, 6) AS p, regexp_extract(bigram, '[^_]*$') AS noun,
  CAST(row_number() OVER (PARTITION BY coding, support ORDER BY p, bigram) AS INTEGER) AS ord FROM {_TOP} WHERE r <= 15""",
        "p_bigram",
    )
)
def bigram_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    p_df = S.bigram_occurrence(_coded(spark, sf_dir)).select("coding", "support", "bigram", "p")
    return r6(S.bigram_display(p_df, 15))


@query(sql("SELECT coding, bigram, round(oppose, 6) AS oppose, round(support, 6) AS support, round(llr, 6) AS llr FROM llr", "llr"))
def bigram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.bigram_llr(S.bigram_occurrence(_coded(spark, sf_dir))))


def _extremes(table: str, term: str, n: int) -> str:
    return f"""SELECT coding, side, {term}, llr, CAST(row_number() OVER (PARTITION BY coding, side ORDER BY llr, {term}) AS INTEGER) AS ord FROM (
  SELECT coding, 'oppose' AS side, {term}, llr FROM (SELECT *, rank() OVER (PARTITION BY coding ORDER BY llr DESC) AS r FROM {table}) WHERE r <= {n}
  UNION ALL SELECT coding, 'support', {term}, llr FROM (SELECT *, rank() OVER (PARTITION BY coding ORDER BY llr) AS r FROM {table}) WHERE r <= {n})"""


# Ratios are rounded before they are ranked, so equal ones tie on every engine.
_ROUNDED = "(SELECT coding, bigram, round(llr, 6) AS llr FROM llr)"


@query(sql(_extremes(_ROUNDED, "bigram", 10), "llr"))
def llr_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.llr_extremes(r6(S.bigram_llr(S.bigram_occurrence(_coded(spark, sf_dir)))), 10)


@query(
    sql(
        "SELECT coding, regexp_extract(bigram, '[^_]*$') AS noun, round(quantile_cont(llr, 0.5), 6) AS llr FROM llr GROUP BY 1, 2",
        "llr",
    )
)
def median_llr_by_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.median_llr_by_noun(S.bigram_llr(S.bigram_occurrence(_coded(spark, sf_dir)))))


@query(
    sql(
        """SELECT coding, s.support, quantile_cont(coalesce(p.df, 0), 0.5) AS df FROM (SELECT DISTINCT coding, bigram FROM p_bigram) b
CROSS JOIN (SELECT unnest(['oppose', 'support']) AS support) s LEFT JOIN p_bigram p USING (coding, bigram, support) GROUP BY 1, 2""",
        "p_bigram",
    )
)
def median_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.median_df(S.bigram_occurrence(_coded(spark, sf_dir)))


def _lemma_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.token_llr(I.tokens(spark, sf_dir), I.codings(spark, sf_dir))


@query(
    sql(
        "SELECT coding, lemma, round(oppose, 6) AS oppose, round(support, 6) AS support, round(llr, 6) AS llr FROM lemma_llr",
        "lemma_llr",
    )
)
def token_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_lemma_llr(spark, sf_dir))


_ROUNDED_LEMMAS = "(SELECT coding, lemma, round(llr, 6) AS llr FROM lemma_llr)"


@query(sql(_extremes(_ROUNDED_LEMMAS, "lemma", 15), "lemma_llr"))
def token_llr_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.llr_extremes(r6(_lemma_llr(spark, sf_dir)), 15, "lemma")


_KEYWORDS = {
    "first": "(?!(?-i)The of)(the of)",
    "second": "ertion|ontion",
    "third": "ness|ment",
}
_FLAGS = {
    "first": "regexp_matches(replace(text, 'The of', '#'), '(?i)the of')",
    "second": "regexp_matches(text, '(?i)ertion|ontion')",
    "third": "regexp_matches(text, '(?i)ness|ment')",
}


@query(
    sql(
        "SELECT coding, support, count(*) AS n, "
        + ", ".join(
            f"count(*) FILTER ({k}) AS {k}_sum, round(avg(CASE WHEN {k} THEN 1.0 ELSE 0.0 END), 6) AS {k}_mean"
            for k in _FLAGS
        )
        + " FROM (SELECT comment_id, "
        + ", ".join(f"bool_or({v}) AS {k}" for k, v in _FLAGS.items())
        + " FROM corpus GROUP BY 1) JOIN codings USING (comment_id) GROUP BY 1, 2",
        "corpus",
        "codings",
    )
)
def keyword_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.keyword_occurrence(I.corpus(spark, sf_dir), I.codings(spark, sf_dir), _KEYWORDS))


_LENGTHS = "(SELECT comment_id, count(*) AS len FROM tokens GROUP BY 1)"


@query(
    sql(
        f"SELECT coding, support, comment_id, len FROM {_LENGTHS} JOIN codings USING (comment_id)",
        "tokens",
        "codings",
    )
)
def length_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = K.comment_length(I.tokens(spark, sf_dir), None)
    return S.length_by_support(lengths, I.codings(spark, sf_dir))


@query(
    sql(
        f"""SELECT coding, support, CAST(least(floor((v - lo) / (hi - lo) * 80) + 1, 80) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT coding, support, log10(len) AS v, min(log10(len)) OVER () AS lo, max(log10(len)) OVER () AS hi
  FROM {_LENGTHS} JOIN codings USING (comment_id)) GROUP BY 1, 2, 3""",
        "tokens",
        "codings",
    )
)
def length_histogram_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = K.comment_length(tagged_tokens(I.corpus(spark, sf_dir)), None)
    joined = written(S.length_by_support(lengths, I.codings(spark, sf_dir)), "lengths")
    return S.length_histogram(joined)


@query(
    sql(
        """SELECT coding || '.' || support AS grp, noun, round(count(DISTINCT comment_id) / any_value(n_docs)::DOUBLE, 6) AS p
FROM coded JOIN side_docs USING (coding, support) GROUP BY coding, support, noun""",
        "coded",
        "side_docs",
    )
)
def noun_occurrence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence under one key made of coding and side, as a plot needs it."""
    p_df = S.noun_occurrence(_coded(spark, sf_dir))
    return r6(p_df.select(F.concat_ws(".", "coding", "support").alias("grp"), "noun", "p"))


# --- the same over the labels of the fitted model --------------------------------------


def _model_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(S.coded_bigrams(vocab_bigrams(spark, sf_dir), model_codings(spark, sf_dir)), "coded")


@query()
def model_n_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments per side and label set, the imputed ones from the fitted model."""
    return S.n_docs_table(model_codings(spark, sf_dir), has_missing=True)


@query()
def model_noun_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.noun_share_summary(S.noun_share(_model_coded(spark, sf_dir)))


@query()
def model_bigram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bigram_llr(S.bigram_occurrence(_model_coded(spark, sf_dir)))


@query()
def model_length_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lengths of the two sides under each label set."""
    lengths = K.comment_length(tagged_tokens(I.corpus(spark, sf_dir)), None)
    return S.length_by_support(lengths, model_codings(spark, sf_dir))
