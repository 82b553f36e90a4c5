"""Corpus, annotation, vocabulary and co-occurrence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import corpus as C
from ..operators import embedding as E
from ..operators import tokens as K
from ..operators import vocab as B
from ..operators.tables import ecdf, ordered_slice, six_numbers
from ..session import written
from . import inputs as I
from .catalog import query
from .sql import sql
from .verbs import r6


@query(
    sql(
        "SELECT comment_id, doc_id, text, docOrder AS \"docOrder\", len FROM corpus", "corpus"
    )
)
def build_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus(spark, sf_dir)


@query(
    sql(
        """SELECT comment_id, doc_id, CAST(sentence_id AS INTEGER) AS sentence_id, CAST(token_id AS INTEGER) AS token_id, token, lemma, pos,
  CAST(head_token_id AS INTEGER) AS head_token_id,
  CASE WHEN head_token_id = token_id THEN 'dep' WHEN pos = 'ADJ' THEN 'amod' WHEN pos = 'DET' THEN 'det' ELSE 'nummod' END AS dep_rel
FROM annotations""",
        "annotations",
    )
)
def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.annotate_pending(I.corpus(spark, sf_dir))


_LEXICON = """SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM benchmark) GROUP BY 1"""


@query(
    sql(
        f"""SELECT t.lemma_out AS lemma, t.pos_out AS pos, count(*) AS n FROM (
  SELECT CASE WHEN l.word IS NULL THEN lemma ELSE 'lex_' || l.word END AS lemma_out, CASE WHEN l.word IS NULL THEN pos ELSE 'ADJ' END AS pos_out
  FROM tokens LEFT JOIN ({_LEXICON}) l ON lower(token) = l.word) t GROUP BY 1, 2""",
        "tokens",
    )
)
def annotate_with_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark texts as a lexicon that overrides the rules."""
    words = I.table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")
    )
    lexicon = words.select(F.lower("w").alias("word")).distinct().select(
        "word", F.concat(F.lit("lex_"), "word").alias("lemma"), F.lit("ADJ").alias("pos")
    )
    tagged = A.annotate_with_lexicon(I.corpus(spark, sf_dir), lexicon)
    return tagged.groupBy("lemma", "pos").agg(F.count("*").alias("n"))


@query(
    sql(
        """SELECT (SELECT count(*) FROM corpus) AS n_corpus, (SELECT count(DISTINCT doc_id) FROM tokens WHERE doc_id LIKE '%-0') AS n_annotated,
  (SELECT count(*) FROM corpus WHERE docOrder > 0) AS n_missing""",
        "tokens",
    )
)
def annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments are not annotated yet, so they show as missing."""
    done = A.tagged_tokens(C.build_corpus(I.comments(spark, sf_dir)))
    return C.annotation_coverage(I.corpus(spark, sf_dir), done)


@query(sql("SELECT count(*) AS n_adjectives, CAST(0 AS BIGINT) AS n_bad_heads FROM tokens WHERE pos = 'ADJ'", "tokens"))
def head_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.head_quality(I.annotations(spark, sf_dir))


@query(sql("SELECT comment_id, lemma, n FROM dtm", "dtm"))
def doc_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.doc_term_matrix(I.tokens(spark, sf_dir))


@query(
    sql(
        "SELECT comment_id, count(*) AS len FROM tokens WHERE pos NOT IN ('PUNCT', 'SPACE', 'NUM') GROUP BY 1",
        "tokens",
    )
)
def comment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.comment_length(I.tokens(spark, sf_dir))


_LENGTHS = "(SELECT comment_id, sum(n) AS n FROM dtm GROUP BY 1)"


@query(
    sql(
        "SELECT "
        + ", ".join(
            f"round(quantile_cont(n, {p}), 6) AS p{k}"
            for k, p in [("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95), ("100", 1.0)]
        )
        + f" FROM {_LENGTHS}",
        "dtm",
    )
)
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.length_quantiles(K.doc_term_matrix(I.tokens(spark, sf_dir))))


@query(
    sql(
        f"""SELECT CAST(n AS BIGINT) AS n_words, count(*) AS n, round(sum(count(*)) OVER (ORDER BY n) / (SELECT count(*) FROM {_LENGTHS}), 6) AS ecdf
FROM {_LENGTHS} GROUP BY n""",
        "dtm",
    )
)
def length_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = K.comment_length(I.tokens(spark, sf_dir), K.NON_WORDS)
    return r6(ecdf(lengths.withColumnRenamed("len", "n_words"), "n_words"), "ecdf")


@query(
    sql(
        f"""SELECT comment_id, CAST(n AS BIGINT) AS n, doc_id, text FROM {_LENGTHS} JOIN corpus USING (comment_id) WHERE n <= 25""",
        "dtm",
        "corpus",
    )
)
def short_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = I.corpus(spark, sf_dir)
    short = K.short_comments(K.doc_term_matrix(A.tagged_tokens(corpus)), corpus, 25)
    return short.select("comment_id", "n", "doc_id", "text").orderBy("n")


@query(sql("SELECT pos, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tokens GROUP BY 1", "tokens"))
def pos_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.pos_distribution(I.tokens(spark, sf_dir)))


@query(sql("SELECT lemma, count(*) AS n FROM tokens WHERE pos = 'PROPN' GROUP BY 1", "tokens"))
def lemma_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.value_counts(I.tokens(spark, sf_dir), "PROPN")


@query(sql("SELECT token, count(*) AS n FROM tokens WHERE pos = 'SYM' GROUP BY 1", "tokens"))
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.value_counts(I.tokens(spark, sf_dir), "SYM", "token")


@query(sql("SELECT count(DISTINCT lemma) AS n_lemmas FROM tokens", "tokens"))
def distinct_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tokens(spark, sf_dir).agg(F.countDistinct("lemma").alias("n_lemmas"))


@query(sql("SELECT lemma, pos, count(*) AS n FROM tokens WHERE regexp_matches(lemma, 'tion') GROUP BY 1, 2", "tokens"))
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.term_search(I.tokens(spark, sf_dir), "tion")


@query(
    sql(
        "SELECT count(DISTINCT comment_id) AS n_comments FROM tokens WHERE pos = 'NOUN' AND regexp_matches(lemma, 'tion|ment')",
        "tokens",
    )
)
def comments_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.comments_using(I.tokens(spark, sf_dir), "tion|ment")


@query(sql("SELECT comment_id, bigram, n FROM bigrams", "bigrams"))
def adj_noun_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.bigrams(spark, sf_dir)


@query(
    sql(
        """SELECT bigram, n, n_docs, round(abs(H), 6) AS entropy, round(dH, 6) AS distance, round(log10(n) * dH, 6) AS weighted
FROM scores""",
        "scores",
    )
)
def bigram_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams ranked by weighted distance from the largest entropy."""
    scores = B.entropy_scores(I.bigrams(spark, sf_dir), "comment_id", "bigram")
    named = scores.select(
        "bigram",
        "n",
        "n_docs",
        F.col("H").alias("entropy"),
        F.col("dH").alias("distance"),
        F.col("ndH").alias("weighted"),
    )
    return r6(named).orderBy(F.desc("weighted"), "bigram")


_LEMMA_SCORES = """SELECT lemma, CAST(sum(n) AS BIGINT) AS n, round(abs(sum(-p * log2(p))), 6) AS entropy
FROM (SELECT comment_id, lemma, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lemma) AS p FROM tokens WHERE pos = '{pos}' GROUP BY 1, 2) GROUP BY 1"""


def _lemma_entropy(spark: SparkSession, sf_dir: str, pos: str) -> DataFrame:
    dtm = I.tokens(spark, sf_dir).filter(F.col("pos") == pos).groupBy("comment_id", "lemma").agg(
        F.count("*").alias("n")
    )
    scores = B.entropy_scores(dtm, "comment_id", "lemma")
    return r6(scores.select("lemma", "n", F.abs("H").alias("entropy")))


@query(sql(_LEMMA_SCORES.format(pos="VERB"), "tokens"))
def verb_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lemma_entropy(spark, sf_dir, "VERB")


@query(sql(_LEMMA_SCORES.format(pos="NOUN"), "tokens"))
def noun_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lemma_entropy(spark, sf_dir, "NOUN")


def vocab_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    bigrams = written(I.bigrams(spark, sf_dir), "bigrams")
    return B.select_vocab(bigrams, B.entropy_scores(bigrams, "comment_id", "bigram"))


@query(sql("SELECT comment_id, bigram, n FROM vocab_bigrams", "vocab_bigrams"))
def select_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab_bigrams(spark, sf_dir)


@query(
    sql(
        """SELECT regexp_extract(bigram, '[^_]*$') AS noun, count(*) AS n_all, CAST(sum(CASE WHEN H > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_vocab
FROM scores GROUP BY 1""",
        "scores",
    )
)
def noun_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.noun_counts(B.entropy_scores(I.bigrams(spark, sf_dir), "comment_id", "bigram"))


@query(
    sql(
        """SELECT min(n)::DOUBLE AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean,
  quantile_cont(n, 0.75) AS q3, max(n)::DOUBLE AS max
FROM (SELECT comment_id, CAST(sum(n) AS BIGINT) AS n FROM vocab_bigrams GROUP BY 1)""",
        "vocab_bigrams",
    )
)
def bigrams_per_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = vocab_bigrams(spark, sf_dir).groupBy("comment_id").agg(F.sum("n").alias("n"))
    return r6(six_numbers(per, "n"))


_MEAN_IDF = """SELECT d.comment_id, sum(d.n / i.df::DOUBLE) / sum(d.n) AS mean_idf FROM dtm d
  JOIN (SELECT lemma, sum(n) AS df FROM dtm GROUP BY 1) i USING (lemma) GROUP BY 1"""


@query(
    sql(
        f"SELECT comment_id, round(mean_idf, 6) AS mean_idf, 'https://www.regulations.gov/comment/' || comment_id AS url FROM ({_MEAN_IDF})",
        "dtm",
    )
)
def mean_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    dtm = written(K.doc_term_matrix(I.tokens(spark, sf_dir)), "dtm")
    return r6(K.mean_idf(dtm))


@query(
    sql(
        f"SELECT comment_id, round(mean_idf, 6) AS mean_idf FROM ({_MEAN_IDF}) ORDER BY round(mean_idf, 6) DESC, comment_id LIMIT 10 OFFSET 10",
        "dtm",
    )
)
def mean_idf_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 11 to 20 of the most garbled comments."""
    dtm = written(K.doc_term_matrix(I.tokens(spark, sf_dir)), "dtm")
    means = r6(K.mean_idf(dtm)).select("comment_id", "mean_idf")
    return ordered_slice(means, 11, 20, F.desc("mean_idf"), F.col("comment_id"))


# Phrases of the invented prose, in two groups.
PHRASES = {"first": ["the of the", "of and the"], "second": ["that the"]}
_HIT = {
    k: "(" + " OR ".join(f"contains(lower(text), '{p}')" for p in v) + ")" for k, v in PHRASES.items()
}


@query(sql(f"SELECT DISTINCT comment_id FROM corpus WHERE {' OR '.join(_HIT.values())}", "corpus"))
def form_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.form_letters(I.corpus(spark, sf_dir), PHRASES)


@query(
    sql(
        " UNION ALL ".join(f"SELECT '{k}' AS form, count(*) AS n FROM corpus WHERE {h}" for k, h in _HIT.items()),
        "corpus",
    )
)
def form_letter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.form_letter_counts(I.corpus(spark, sf_dir), PHRASES)


@query(
    sql(
        """SELECT doc_id, unnest(regexp_extract_all(text, '(?i).{0,20}tion of.{0,20}')) AS extracts FROM corpus
WHERE regexp_matches(text, 'tion of')""",
        "corpus",
    )
)
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kwic(I.corpus(spark, sf_dir), "tion of").select("doc_id", "extracts")


_WEEK = "CASE WHEN dayofweek(d) <= 3 THEN d - CAST(dayofweek(d) AS INTEGER) ELSE d + CAST(7 - dayofweek(d) AS INTEGER) END"


@query(f"SELECT {_WEEK} AS week, count(*) AS n FROM (SELECT ts::DATE AS d FROM events) GROUP BY 1")
def submission_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.submission_histogram(I.table(spark, sf_dir, "events"), "ts", "week")


@query(
    sql(
        """SELECT c.comment_id, c.doc_id, CASE WHEN c.len > 500 THEN left(c.text, 497) || '...' ELSE c.text END AS text
FROM corpus c JOIN events e ON c.comment_id = CAST(e.event_id AS VARCHAR) WHERE e.ts < TIMESTAMP '2024-01-02'""",
        "corpus",
    )
)
def early_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts received before a date, for reading."""
    meta = I.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("received")
    )
    return C.early_outliers(meta, "2024-01-02", I.corpus(spark, sf_dir), "received")


@query(
    sql(
        """SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) > 1000000 THEN 'long' ELSE 'usable' END AS kind,
  count(*) AS n_docs, count(DISTINCT comment_id) AS n_comments, CAST(max(length(text)) AS INTEGER) AS longest FROM docs GROUP BY 1""",
        "docs",
    )
)
def text_length_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.text_length_audit(I.docs(spark, sf_dir))


@query(
    sql(
        """SELECT min(n)::DOUBLE AS min, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean,
  quantile_cont(n, 0.75) AS q3, max(n)::DOUBLE AS max FROM (SELECT comment_id, count(*) AS n FROM corpus GROUP BY 1)""",
        "corpus",
    )
)
def docs_per_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(six_numbers(C.docs_per_comment(I.corpus(spark, sf_dir)), "n_docs"))


# --- co-occurrence ---------------------------------------------------------------


@query(sql("SELECT token, n, round(p, 8) AS p FROM unigrams", "unigrams"))
def unigram_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.unigram_p(E.content_tokens(I.tokens(spark, sf_dir)))
    return found.withColumn("p", F.round("p", 8))


# A pair shares no more contexts than either token has, so the others leave first.
_OFTEN = """(SELECT token, context_id FROM (SELECT DISTINCT token, context_id FROM content)
  SEMI JOIN (SELECT token FROM content GROUP BY 1 HAVING count(DISTINCT context_id) > 20) USING (token))"""
_PAIRS = f"""(SELECT item1, item2, n, n / sum(n) OVER () AS p FROM (
  SELECT a.token AS item1, b.token AS item2, count(*) AS n FROM {_OFTEN} a JOIN {_OFTEN} b USING (context_id)
  GROUP BY 1, 2 HAVING count(*) > 20))"""


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(E.content_tokens(I.tokens(spark, sf_dir)), "content")


@query(sql(f"SELECT item1, item2, n, round(p, 8) AS p FROM {_PAIRS}", "content"))
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cooccurrence(_content(spark, sf_dir)).withColumn("p", F.round("p", 8))


@query(
    sql(
        f"""SELECT item1, item2, round(log10(q.p / a.p / b.p), 6) AS pmi FROM {_PAIRS} q
LEFT JOIN unigrams a ON a.token = item1 LEFT JOIN unigrams b ON b.token = item2""",
        "content",
        "unigrams",
    )
)
def pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _content(spark, sf_dir)
    found = E.pmi(content)
    return r6(found.select("item1", "item2", "pmi"))
