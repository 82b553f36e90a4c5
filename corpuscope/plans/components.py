"""Principal components, coding samples and word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding as E
from ..operators import pca as P
from ..operators.corpus import form_letters
from ..operators.sampling import loading_distribution, sample_for_coding
from ..session import written
from ..sources.tables import load_or_build
from . import inputs as I
from .catalog import once, query
from .sql import sql
from .text import _HIT, PHRASES, _content, vocab_bigrams
from .verbs import r6

# Counts of each bigram per comment, with the two moments of the comment's column
# over all m bigrams, zeros included; cells of the standardised Gram matrix.
_GRAM = """
, m AS (SELECT count(DISTINCT bigram) AS m FROM vocab_bigrams),
cols AS (SELECT comment_id, sum(n)::DOUBLE AS s, sum(n * n)::DOUBLE AS ss FROM vocab_bigrams GROUP BY 1),
sd AS (SELECT comment_id, s / m AS mu, sqrt((ss - s * s / m) / (m - 1)) AS sd FROM cols, m WHERE (ss - s * s / m) / (m - 1) > 1e-12),
z AS (SELECT v.bigram, v.comment_id, v.n / sd.sd AS a, sd.mu / sd.sd AS c FROM vocab_bigrams v JOIN sd USING (comment_id)),
r AS (SELECT bigram, sum(a * c) AS r FROM z GROUP BY 1),
k AS (SELECT sum(power(mu / sd, 2)) AS k FROM sd),
cells AS (SELECT x.bigram AS b1, y.bigram AS b2, sum(x.a * y.a) AS g FROM z x JOIN z y USING (comment_id) GROUP BY 1, 2)
SELECT x.bigram AS bigram1, y.bigram AS bigram2, round(coalesce(g, 0) - x.r - y.r + k, 4) AS g
FROM r x JOIN r y ON x.bigram <= y.bigram LEFT JOIN cells ON b1 = x.bigram AND b2 = y.bigram, k
"""
COMPONENTS = 5


@query(sql(_GRAM, "vocab_bigrams"))
def gram_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised bigram-by-bigram matrix, whose vectors are the components."""
    cells = P.cooccurrence_cells(written(vocab_bigrams(spark, sf_dir), "vocab"))
    return cells.select("bigram1", "bigram2", F.round("g", 4).alias("g"))


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, P.Components]:
    dtm = written(vocab_bigrams(spark, sf_dir), "vocab")
    return dtm, P.pca(dtm, COMPONENTS)


def _scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the fit that a session makes once."""
    return load_or_build(spark, once(spark, sf_dir, "pc-scores"), lambda: P.pc_scores(spark, _fitted(spark, sf_dir)[1]))


def _loadings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_or_build(spark, once(spark, sf_dir, "pc-loadings"), lambda: P.pc_loadings(_fitted(spark, sf_dir)[1]))


@query()
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pc = _fitted(spark, sf_dir)
    return P.explained_variance(spark, pc)


@query()
def pc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores_of(spark, sf_dir)


@query()
def pc_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loadings_of(spark, sf_dir)


_PAIRS = f"(SELECT unnest(range(1, {COMPONENTS + 1})) AS a), (SELECT unnest(range(1, {COMPONENTS + 1})) AS b)"


@query(
    f"""SELECT what, a::INTEGER AS a, b::INTEGER AS b, true AS holds FROM (SELECT unnest(['loadings', 'scores']) AS what), {_PAIRS} WHERE a <= b
UNION ALL SELECT 'product', a::INTEGER, a::INTEGER, true FROM (SELECT unnest(range(1, {COMPONENTS + 1})) AS a)"""
)
def component_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the components are what they should be: scores the products of the matrix and the
    loadings, and both orthogonal."""
    dtm, pc = _fitted(spark, sf_dir)
    return P.misses(dtm, pc).select("what", "a", "b", (F.col("off") < 1e-6).alias("holds"))


@query()
def biplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.biplot_frame(_scores_of(spark, sf_dir))


@query()
def extreme_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extreme_terms(_scores_of(spark, sf_dir), list(I.NOUNS))


# --- samples along a score ---------------------------------------------------------

# A score that every engine computes alike, the length of all a comment's documents;
# the same samples along the loadings follow below.
_SCORE = "(SELECT comment_id, sum(len)::DOUBLE AS value FROM corpus GROUP BY 1)"
_FORMS = f"(SELECT comment_id FROM corpus WHERE {' OR '.join(_HIT.values())})"
_SAMPLE = f"""
, elig AS (SELECT * FROM {_SCORE} WHERE comment_id NOT IN {_FORMS}),
ranked AS (SELECT *, rank() OVER (ORDER BY value DESC) AS t, rank() OVER (ORDER BY value) AS b FROM elig),
ext AS (SELECT comment_id, value, CASE WHEN t <= 200 THEN 'top' ELSE 'bottom' END AS side FROM ranked WHERE t <= 200 OR b <= 200),
rnd AS (SELECT comment_id, value, 'random' AS side FROM elig WHERE comment_id NOT IN (SELECT comment_id FROM ext)
  ORDER BY md5('5:' || comment_id), comment_id LIMIT 400),
picked AS (SELECT * FROM ext UNION ALL SELECT * FROM rnd)
"""


def _scores(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("comment_id").agg(F.sum("len").cast("double").alias("value"))


@query(sql(_SAMPLE + "SELECT comment_id, value, side FROM picked", "corpus"))
def length_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = I.corpus(spark, sf_dir)
    return sample_for_coding(_scores(corpus), form_letters(corpus, PHRASES), 200, 5)


@query(
    sql(
        _SAMPLE
        + f"""SELECT s.comment_id, s.value, s.comment_id IN {_FORMS} AS form_letter, p.side
FROM {_SCORE} s LEFT JOIN picked p ON p.comment_id = s.comment_id""",
        "corpus",
    )
)
def length_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = I.corpus(spark, sf_dir)
    forms, scores = form_letters(corpus, PHRASES), _scores(corpus)
    return loading_distribution(scores, forms, sample_for_coding(scores, forms, 200, 5))


def _first_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loadings_of(spark, sf_dir).filter("PC = 1").select("comment_id", "value")


def _loading_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_for_coding(_first_loadings(spark, sf_dir), form_letters(I.corpus(spark, sf_dir), PHRASES), 200, 5)


@query()
def coding_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments to be coded: both ends of the first component, without form letters, and a random rest."""
    return _loading_sample(spark, sf_dir)


@query()
def loading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loadings on the first component, with form letters and the sample marked."""
    forms = form_letters(I.corpus(spark, sf_dir), PHRASES)
    return loading_distribution(_first_loadings(spark, sf_dir), forms, _loading_sample(spark, sf_dir))


@query()
def sample_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = loading_flags(spark, sf_dir)
    return flags.groupBy(F.coalesce("side", F.lit("none")).alias("side")).agg(F.count("*").alias("n"))


# --- word vectors --------------------------------------------------------------------


DIMENSIONS = 256


def _word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that a session computes once."""
    return load_or_build(spark, once(spark, sf_dir, "word-vectors"), lambda: E.word_vectors(E.pmi(_content(spark, sf_dir)), DIMENSIONS))


@query()
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every token in a kept pair, with their length."""
    found = _word_vectors(spark, sf_dir)
    return found.select("token", F.size("vec").alias("dims"), E.dot(F.col("vec"), F.col("vec")).alias("length2"))


@query(f"SELECT d::INTEGER AS d, 1.0::DOUBLE AS length2 FROM (SELECT unnest(range({DIMENSIONS})) AS d)")
def word_vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared lengths of the columns of the vectors, which are all 1."""
    cells = _word_vectors(spark, sf_dir).select(F.posexplode("vec").alias("d", "x"))
    return cells.groupBy("d").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("length2"))


@query()
def stem_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens like those that begin with a stem, among those of their part of speech."""
    return E.get_variants(_word_vectors(spark, sf_dir), "^(tion|ment)", 10)


_VEC = "(SELECT vec_id || '_' || label AS token, label, embedding::DOUBLE[] AS vec FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "embeddings").select(
        F.concat_ws("_", "vec_id", "label").alias("token"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


@query(
    f"""SELECT v.token, round(list_dot_product(v.vec, t.vec), 6) AS similarity FROM {_VEC} v,
  (SELECT vec FROM {_VEC} WHERE token LIKE '7\\_%' ESCAPE '\\') t"""
)
def similar_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    token = vectors.filter(F.col("token").rlike("^7_")).select("token").first()[0]
    return r6(E.similar(vectors, token)).orderBy(F.desc("similarity"))


_RANKED = f"""SELECT match, token, round(s, 6) AS similarity FROM (
  SELECT m.token AS match, v.token, list_dot_product(m.vec, v.vec) AS s,
    rank() OVER (PARTITION BY m.token ORDER BY list_dot_product(m.vec, v.vec) DESC) AS r
  FROM {_VEC} m JOIN {_VEC} v ON {{cond}}) WHERE r <= 5"""


@query(_RANKED.format(cond="m.label = v.label"))
def variants_same_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token matches; the label stands for the part of speech."""
    return r6(E.get_variants(_vectors(spark, sf_dir), "_[0-9]+$", 5, filter_pos=True, block=128))


@query(_RANKED.format(cond="true"))
def variants_any_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.get_variants(_vectors(spark, sf_dir), "_[0-9]+$", 5, filter_pos=False, block=128))


@query(
    sql(
        _SAMPLE
        + f"SELECT coalesce(p.side, 'none') AS side, count(*) AS n FROM {_SCORE} s LEFT JOIN picked p ON p.comment_id = s.comment_id GROUP BY 1",
        "corpus",
    )
)
def length_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = length_flags(spark, sf_dir)
    return flags.groupBy(
        F.coalesce("side", F.lit("none")).alias("side")
    ).agg(F.count("*").alias("n"))
