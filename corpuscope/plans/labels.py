"""Coding agreement, classification and the imputed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import classify as M
from ..operators import lasso as X
from ..operators import tables as V
from ..operators.agreement import load_manual_coding
from ..operators.corpus import form_letters
from ..session import written
from ..sources.tables import load_or_build
from . import inputs as I
from .catalog import once, query
from .sql import sql
from .text import _HIT, PHRASES
from .verbs import r6

_WIDE = ", ".join(f"max(support) FILTER (coder = '{c}') AS support_{c}" for c in I.CODERS)
_NOTES = ", ".join(f"max(notes) FILTER (coder = '{c}') AS notes_{c}" for c in I.CODERS)


@query(
    sql(
        f"""SELECT comment_id, any_value(url) AS url, {_WIDE}, {_NOTES},
  count(DISTINCT support) = 1 AS identical, any_value(mode) AS mode FROM codes JOIN modes USING (comment_id) GROUP BY 1""",
        "codes",
        "modes",
    )
)
def coding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.coding(spark, sf_dir).withColumn("mode", F.array_join("mode", ""))


@query(
    sql(
        """SELECT count(*) AS n_values, round(1 - (count(*) - 1) * (count(*) - any_value(same)) / (power(count(*), 2) - any_value(squares)), 6) AS alpha
FROM codes, (SELECT sum(power(c, 2)) AS squares FROM (SELECT support, count(*)::DOUBLE AS c FROM codes GROUP BY 1)),
  (SELECT sum(c * (c - 1) / (m - 1)) AS same FROM (SELECT comment_id, support, count(*)::DOUBLE AS c,
    sum(count(*)) OVER (PARTITION BY comment_id) AS m FROM codes GROUP BY 1, 2))""",
        "codes",
    )
)
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.krippendorff_alpha(G.normalise_codes(I.sheets(spark, sf_dir))))


@query(
    sql(
        f"""SELECT comment_id, any_value(mode) AS mode, {_WIDE} FROM codes JOIN modes USING (comment_id)
GROUP BY 1 HAVING count(DISTINCT support) > 1""",
        "codes",
        "modes",
    )
)
def discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.discordant(I.coding(spark, sf_dir))
    return rows.select(
        "comment_id", F.array_join("mode", "").alias("mode"), *[f"support_{c}" for c in I.CODERS]
    )


@query(
    sql(
        """SELECT comment_id, count(DISTINCT support) = 1 AS identical,
  CASE any_value(mode) WHEN 'y' THEN 'support' WHEN 'n' THEN 'oppose' END AS support
FROM codes JOIN modes USING (comment_id) GROUP BY 1""",
        "codes",
        "modes",
    )
)
def manual_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.load_manual_coding(I.coding(spark, sf_dir)).select("comment_id", "identical", "support")


@query(
    sql(
        f"""SELECT comment_id, support, text FROM (SELECT t.comment_id, t.text,
  CASE WHEN t.comment_id IN (SELECT comment_id FROM corpus WHERE {' OR '.join(_HIT.values())}) THEN 'oppose'
    WHEN mode = 'y' THEN 'support' WHEN mode = 'n' THEN 'oppose' END AS support
  FROM (SELECT comment_id, string_agg(text, chr(10) ORDER BY docOrder) AS text FROM corpus GROUP BY 1) t LEFT JOIN modes USING (comment_id))
WHERE support IS NOT NULL""",
        "corpus",
        "modes",
    )
)
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir)


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = I.corpus(spark, sf_dir)
    manual = G.load_manual_coding(I.coding(spark, sf_dir))
    return M.training_set(corpus, manual, form_letters(corpus, PHRASES))


@query()
def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed hash features of stemmed words."""
    return M.hashed_features(M.word_counts(I.corpus(spark, sf_dir)))


@query()
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stem_table(M.word_counts(I.corpus(spark, sf_dir)))


_RAW_WORDS = r"""
, words AS (SELECT comment_id, word, count(*) AS n FROM (
  SELECT comment_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’]\p{L}+)*')) AS word FROM corpus) GROUP BY 1, 2),
hashed AS (SELECT comment_id, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % 1024 AS INTEGER) AS bucket,
  n * (CASE WHEN ('0x' || substr(md5('sign:' || word), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM words),
signs AS (SELECT comment_id, bucket, CAST(sign(sum(v)) AS INTEGER) AS sign FROM hashed GROUP BY 1, 2 HAVING sum(v) <> 0)
"""


def _unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        I.corpus(spark, sf_dir)
        .select("comment_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(M.WORD), F.lit(0))).alias("word"))
        .groupBy("comment_id", "word")
        .agg(F.count("*").alias("n"))
    )
    return M.hashed_features(written(counts, "words"), stemming=False)


@query(sql(_RAW_WORDS + "SELECT comment_id, bucket, sign FROM signs", "corpus"))
def signed_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashing itself, on words as they are."""
    return _unstemmed(spark, sf_dir)


@query(
    sql(
        _RAW_WORDS
        + """SELECT comment_id, bucket, sign FROM signs WHERE bucket NOT IN (
  SELECT bucket FROM signs GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT comment_id) FROM corpus) AND min(sign) = max(sign))""",
        "corpus",
    )
)
def varying_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.corpus(spark, sf_dir).agg(F.countDistinct("comment_id").alias("n"))
    return M.drop_zero_variance(written(_unstemmed(spark, sf_dir), "signs"), n)


_GUESS = """(SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'oppose' ELSE 'support' END AS support, i.pred_class
  FROM labels l JOIN imputed i ON i.comment_id = CAST(l.doc_id AS VARCHAR))"""


@query(
    sql(
        f"""SELECT round(accuracy, 6) AS accuracy, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity,
  round((sensitivity + specificity) / 2, 6) AS bal_accuracy FROM (
  SELECT avg(CASE WHEN support = pred_class THEN 1.0 ELSE 0.0 END) AS accuracy,
    avg(CASE WHEN pred_class = 'oppose' THEN 1.0 ELSE 0.0 END) FILTER (support = 'oppose') AS sensitivity,
    avg(CASE WHEN pred_class = 'support' THEN 1.0 ELSE 0.0 END) FILTER (support = 'support') AS specificity FROM {_GUESS})""",
        "imputed",
    )
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = I.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.when(F.col("quality") == 1, "oppose").otherwise("support").alias("support"),
    )
    return r6(M.metrics(truth.join(I.imputed(spark, sf_dir), "comment_id")))


@query(
    sql(
        """SELECT comment_id, pred_oppose, pred_class AS support FROM imputed WHERE pred_oppose < 1 - 0.8::DOUBLE OR pred_oppose > 0.8::DOUBLE""",
        "imputed",
    )
)
def imputed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.load_imputed_filtered(I.imputed(spark, sf_dir))


@query(sql("SELECT comment_id, pred_oppose, pred_class AS support FROM imputed", "imputed"))
def imputed_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.load_imputed_full(I.imputed(spark, sf_dir))


@query(
    sql(
        "SELECT pred_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM imputed GROUP BY 1",
        "imputed",
    )
)
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(M.class_share(I.imputed(spark, sf_dir), "pred_class"))


@query(
    sql(
        """SELECT pred_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM imputed
WHERE pred_oppose > 1 - 0.2::DOUBLE OR pred_oppose < 0.2::DOUBLE GROUP BY 1""",
        "imputed",
    )
)
def confident_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(M.confident_class_share(I.imputed(spark, sf_dir)))


@query(
    sql(
        """SELECT CAST(least(floor(pred_oppose / hi * 80) + 1, 80) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT pred_oppose, max(pred_oppose) OVER () AS hi FROM imputed) GROUP BY 1""",
        "imputed",
    )
)
def prediction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(I.imputed(spark, sf_dir), F.col("pred_oppose"), 80)


# --- fitted models: rows only --------------------------------------------------------


FOLDS = 5


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash features of the whole corpus."""

    def build() -> DataFrame:
        # Read for the vocabulary and for its frequent and its other words.
        return M.hashed_features(written(M.word_counts(I.corpus(spark, sf_dir)), "words"))

    return load_or_build(spark, once(spark, sf_dir, "features"), build)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comment_id, support and split of the labelled comments."""

    def build() -> DataFrame:
        return V.stratified_split(_training(spark, sf_dir).select("comment_id", "support"), "comment_id", "support", 0.75, 1)

    return load_or_build(spark, once(spark, sf_dir, "labelled"), build)


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Weighted training comments with folds, and those of their features that vary."""
    split = _labelled(spark, sf_dir).filter("split = 'train'")
    folded = V.stratified_folds(M.with_class_weights(split), "comment_id", "support", FOLDS, 2)
    own = _features(spark, sf_dir).join(split.select("comment_id"), "comment_id", "left_semi")
    return folded, M.drop_zero_variance(own, split.agg(F.count("*")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse training rows."""

    def build() -> DataFrame:
        folded, used = _train(spark, sf_dir)
        return X.sparse_rows(folded.withColumn("fold", F.col("fold").cast("int")), used, M.POSITIVE)

    return load_or_build(spark, once(spark, sf_dir, "training-rows"), build)


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = _rows(spark, sf_dir)
        folds = sorted(r.fold for r in rows.select("fold").distinct().collect())
        return X.lasso_path(rows, M.penalty_grid(), M.NUM_TERMS, folds)

    return load_or_build(spark, once(spark, sf_dir, "lasso-path"), build)


def _tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tune_lasso(_rows(spark, sf_dir), _path(spark, sf_dir))


def _coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the lasso at the best penalty."""
    return M.best_coefficients(_path(spark, sf_dir), written(_tuning(spark, sf_dir), "tuning"))


@query(
    f"""SELECT f::INTEGER AS fold, l::INTEGER AS level, true AS holds
FROM (SELECT unnest(range(-1, {FOLDS})) AS f), (SELECT unnest(range(30)) AS l)"""
)
def lasso_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each fit of the path is optimal: its gradient against its penalty, by joins and sums.

    A level is a penalty's place in the grid; those beyond the end of a path share its last fit.
    """
    path = _path(spark, sf_dir)
    off = X.conditions(_rows(spark, sf_dir), path, M.NUM_TERMS).select("fold", "fitted", "worst")
    grid = F.array(*[F.lit(p) for p in M.penalty_grid()])
    level = F.aggregate(grid, F.lit(0), lambda n, p: n + (p < F.col("penalty") * (1 - 1e-9)).cast("int"))
    fits = path.select("fold", "penalty", "fitted").distinct()
    return fits.join(off, ["fold", "fitted"]).select("fold", level.alias("level"), (F.col("worst") < 2 * X.TOLERANCE).alias("holds"))


@query()
def lasso_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean held-out metrics over five folds for each of 30 penalties."""
    return M.collect_metrics(_tuning(spark, sf_dir))


@query()
def best_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best penalties by each metric."""
    tuning = written(_tuning(spark, sf_dir), "tuning")
    return V.tagged_union({m: M.show_best(tuning, m) for m in M.METRICS}, "metric")


@query()
def lasso_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefficients(spark, sf_dir)


@query()
def lasso_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and probability for every comment of the corpus."""
    everyone = I.corpus(spark, sf_dir).select("comment_id").distinct()
    return M.augment(everyone, _features(spark, sf_dir), _coefficients(spark, sf_dir))


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter("split = 'test'").drop("split")


@query()
def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tuned lasso does on labelled comments that it has not seen."""
    return M.metrics(M.augment(_held_out(spark, sf_dir), _features(spark, sf_dir), _coefficients(spark, sf_dir)))


def model_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lasso's class and probability for every comment, fitted once in a session."""
    return load_or_build(spark, once(spark, sf_dir, "imputed"), lambda: lasso_predictions(spark, sf_dir))


def model_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's labels for the corpus, all and confident ones, beside the hand-made ones."""
    guess = model_imputed(spark, sf_dir)
    frames = {
        "manual": load_manual_coding(I.coding(spark, sf_dir)),
        "filtered": M.load_imputed_filtered(guess),
        "imputed": M.load_imputed_full(guess),
    }
    return V.tagged_union({k: v.select("comment_id", "support") for k, v in frames.items()})


@query()
def imputed_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_codings(spark, sf_dir)


@query()
def model_class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the classes that the model gives, over all comments and over those it is sure of."""
    guess = model_imputed(spark, sf_dir)
    frames = {"all": M.class_share(guess, "pred_class"), "confident": M.confident_class_share(guess)}
    return V.tagged_union(frames, "comments")


@query()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's classes for labelled comments that it has not seen."""
    folded, used = _train(spark, sf_dir)
    model = M.fit_forest(written(M.feature_vectors(folded, used), "train"))
    vectors = M.feature_vectors(_held_out(spark, sf_dir), _features(spark, sf_dir))
    return M.augment_with_model(model, vectors).select("comment_id", "support", "pred_class", "pred_oppose")
