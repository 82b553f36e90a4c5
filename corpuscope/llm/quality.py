"""6. Quality classifier by co-training of a text view and a metadata view.

The text view sees shares of letters, symbols, capitals and repeated words; the
metadata view sees the stated length and how good the labelled documents of the same
source and language are, from a table of every source and language. Each is a logistic
regression. In every round each view labels, of all unlabelled documents, those that it
ranks highest and lowest, GIVEN of them in the proportion of the classes, and the other
view learns from them. Such a label weighs as much as labelled rows kept apart show that the
view does better than chance there, so a view that knows little teaches little, and all
of them together weigh no more than the labelled rows. Both views are then calibrated on labelled rows
that were kept apart, and a logistic regression over the two calibrated views
gives the score.

At most FIT_ROWS labelled documents are used, the first in hash order. Unlabelled ones
are all used: their features are stored once, and a fit is a few sums over them, as is
the table of sources. Scoring is one narrow expression over all documents, whole texts;
what a source and language add comes by broadcast while there are at most PAIRS of
them, else by broadcast of the frequent and a join of the rest.

Cases: null texts count as empty, null metadata as a value of its own, a stated length that isn't a number as 0, null labels
as none; a document with several labels takes their mean, rounded up at a half; rows that repeat
a labelled id count as one, the first by the text's hash. With
fewer than MIN_EACH labels of either class there is no model, every score is the share
of good labels (1 without labels) and everything is kept. Sources without labels count
as the mean. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import join_by_frequency
from .common import stored, text_of, words

FIT_ROWS, MIN_EACH = 20_000, 10
#: Rounds, the share of the unlabelled rows that a view labels in one, and the score that keeps a document.
ROUNDS, GIVEN, KEEP = 2, 0.2, 0.5
#: Labelled rows that the mean counts for in a source's or language's share, and in how often a view is right.
PRIOR, DOUBT = 20.0, 10.0
#: Pairs of source and language that are broadcast.
PAIRS = 50_000
TEXT = ("words", "length", "distinct", "spread", "symbols", "capitals", "digits", "lines")


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__x``, an array of the TEXT features."""
    t = F.col("__t")
    df = df.withColumn("__t", text_of(text)).withColumn("__w", words(text_of(text)))
    n = F.greatest(F.size("__w"), F.lit(1)).cast("double")
    chars = F.greatest(F.char_length(t), F.lit(1)).cast("double")

    def left(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(t, pattern, "")).cast("double")

    df = df.withColumn("__letters", left(r"[^\p{L}]+")).withColumn("__distinct", F.size(F.array_distinct("__w")) / n)
    df = df.withColumn(
        "__x",
        F.array(
            F.log1p(n), F.least(chars / n, F.lit(50.0)), F.col("__distinct"), F.col("__distinct") * F.log1p(n),
            left(r"[\p{L}\p{N}\s.,;:'\-]+") / chars, left(r"[^\p{Lu}]+") / (F.col("__letters") + 1),
            left(r"\P{N}+") / chars, left(r"[^\n]+") / n,
        ),
    )
    return df.drop("__t", "__w", "__letters", "__distinct")


def meta_features(df: DataFrame) -> DataFrame:
    """Add ``__stated`` (log of the stated length), ``__source`` and ``__lang``."""
    def of(column: str) -> Column:
        return F.col(column) if column in df.columns else F.lit(None)

    stated = F.log1p(F.greatest(F.coalesce(of("n_chars").try_cast("double"), F.lit(0.0)), F.lit(0.0)))
    return df.withColumns({"__stated": stated, "__source": of("source").cast("string"), "__lang": of("lang").cast("string")})


class Linear(NamedTuple):
    """A logistic regression on standardised values, clipped at CLIP deviations."""

    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -CLIP, CLIP) @ self.weight + self.bias


CLIP = 6.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> Linear:
    """Newton steps on the penalised likelihood."""
    weight = np.ones(len(y)) if weight is None else weight
    mean, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / sd, -CLIP, CLIP), np.ones(len(y))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = _sigmoid(z @ b)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ b)
        size = np.abs(step).max()
        b += step * min(1.0, 5 / max(size, 1e-9))
        if size < 1e-8:
            break
    return Linear(mean, sd, b[:-1], float(b[-1]))


class Taught(NamedTuple):
    """What a view gave the other one in a round."""

    turn: int
    view: str
    good: int
    bad: int
    weight: float


class Model(NamedTuple):
    text: Linear
    meta: Linear
    final: Linear | None  # over the two calibrated logits; None: no model
    base: float
    pairs: DataFrame | None  # __source, __lang, source_odds, lang_odds and rows of every pair
    exchanged: tuple[Taught, ...] = ()


EMPTY = Linear(np.zeros(1), np.ones(1), np.zeros(1), 0.0)


def fit_by_sums(rows: DataFrame, xs: Sequence[Column], y: Column, weight: Column, ridge: float = 1.0) -> Linear:
    """``fit_logistic`` over all rows with a weight: a Newton step is one sum over them.

    Every task sends as many numbers as the step has, which are added up by their place.
    """
    n = len(xs)
    used = rows.filter(weight > 0).select(y.alias("y"), weight.alias("w"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])

    def added(part, size: int) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                y, w, *x = (b.column(c).to_numpy() for c in b.schema.names)
                total += part(np.column_stack(x), y, w)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["k", "v"])

        found = used.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in found:
            out[r.k] = r.v
        return out

    moments = added(lambda x, y, w: np.concatenate([[w.sum()], w @ x, w @ x**2]), 1 + 2 * n)
    mean = moments[1 : n + 1] / moments[0]
    sd = np.maximum(np.sqrt(np.maximum(moments[n + 1 :] / moments[0] - mean**2, 0)), 1e-6)
    penalty = np.diag([ridge] * n + [1e-6])
    b = np.zeros(n + 1)

    def step_sums(x, y, w):
        z = np.column_stack([np.clip((x - mean) / sd, -CLIP, CLIP), np.ones(len(y))])
        p = _sigmoid(z @ b)
        return np.concatenate([z.T @ (w * (y - p)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])

    for _ in range(25):
        sums = added(step_sums, (n + 1) * (n + 2))
        h = sums[n + 1 :].reshape(n + 1, n + 1) + penalty
        step = np.linalg.solve(h, sums[: n + 1] - penalty @ b)
        size = np.abs(step).max()
        b = b + step * min(1.0, 5 / max(size, 1e-9))
        # Newton steps square what is left.
        if size < 1e-3:
            break
    return Linear(mean, sd, b[:-1], float(b[-1]))


def _known_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int) -> DataFrame:
    """Stored features of every row: x, stated, source, lang; y, weight and apart of labelled ones."""
    wanted = [c for c in ("source", "lang", "n_chars") if c in docs.columns and c not in (key, text)]
    bare = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__body"), *[F.col(f"`{c}`") for c in wanted])
    each = meta_features(text_features(bare, "__body")).select(
        F.col("__id").alias("id"), F.xxhash64(text_of("__body")).alias("row"), F.col("__x").alias("x"),
        F.col("__stated").alias("stated"), F.col("__source").alias("source"), F.col("__lang").alias("lang"),
    )
    each = stored(each, "features")
    ids = each.select("id").filter("id is not null").distinct()
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("y")).filter("y is not null")
    marks = marks.groupBy("id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y")).join(ids, "id")
    order = F.md5(F.col("id").cast("string"))
    labelled = marks.orderBy(order, "id").limit(fit_rows)
    # Of each class every fifth is kept for calibration; at most fit_rows rows here.
    marked = labelled.select("id", "y", order.alias("o")).collect()
    taken, numbers = [], {0.0: 0, 1.0: 0}
    for r in sorted(marked, key=lambda r: (r.o, str(r.id))):
        taken.append((r.id, r.y, numbers[r.y] % 5 == 0))
        numbers[r.y] += 1
    schema = labelled.select("id", "y").schema.add("apart", "boolean")
    chosen = F.broadcast(docs.sparkSession.createDataFrame(taken, schema))
    one = each.join(chosen.select("id"), "id").groupBy("id").agg(F.min("row").alias("row"))
    one = one.join(each, ["id", "row"]).groupBy("id", "row").agg(F.count("*").alias("copies"))
    # One row per labelled id.
    one = F.broadcast(one.join(chosen, "id"))
    joined = each.join(one, ["id", "row"], "left")
    return stored(joined.withColumn("own", F.coalesce(1 / F.col("copies"), F.lit(0.0))), "known-rows")


def _odds(good: Column, total: Column, base: float) -> Column:
    """Log odds of a share that is shrunk towards ``base``."""
    return F.log((good + PRIOR * base) / (total - good + PRIOR * (1 - base)))


def _with_odds(rows: DataFrame, base: float, y: Column, weight: Column) -> DataFrame:
    """Add what source and language say of a row, from all other rows (``source_odds``, ``lang_odds``)
    and from all rows (``source_all``, ``lang_all``)."""
    rows = rows.withColumn("__y", F.coalesce(y, F.lit(0.0))).withColumn("__w", weight)
    for c in ("source", "lang"):
        sums = rows.groupBy(F.struct(c).alias("__k")).agg(
            F.sum("__w").alias("__n"), F.sum(F.col("__w") * F.col("__y")).alias("__g"), F.count("*").alias("rows")
        )
        # A key inside a struct equals another null one.
        sums = stored(sums, "shares")
        if sums.limit(PAIRS + 1).count() <= PAIRS:
            rows = rows.withColumn("__k", F.struct(c)).join(F.broadcast(sums.drop("rows")), "__k").drop("__k")
        else:
            rows = join_by_frequency(rows.withColumn("__k", F.struct(c)), sums, "__k", "rows").drop("__k", "rows")
        without = _odds(F.greatest(F.col("__g") - F.col("__w") * F.col("__y"), F.lit(0.0)), F.greatest(F.col("__n") - F.col("__w"), F.lit(0.0)), base)
        rows = rows.withColumns({f"{c}_odds": without, f"{c}_all": _odds(F.col("__g"), F.col("__n"), base)}).drop("__n", "__g")
    return rows.drop("__y", "__w")


def _text_x() -> list[Column]:
    return [F.get("x", F.lit(i)) for i in range(len(TEXT))]


def _meta_x(kind: str = "odds") -> list[Column]:
    return [F.col("stated"), F.col(f"source_{kind}"), F.col(f"lang_{kind}")]


def _apart(rows: DataFrame, logits: dict[str, Column]) -> tuple[np.ndarray, ...]:
    """y and the logits of the rows kept apart, at most a fifth of FIT_ROWS."""
    found = rows.filter("apart").select("id", "y", *[z.alias(n) for n, z in logits.items()]).dropDuplicates(["id"]).collect()
    found.sort(key=lambda r: str(r.id))
    return tuple(np.array([r[c] for r in found], float) for c in ("y", *logits))


def _lessons(rows: DataFrame, logit: Column, seen: tuple[np.ndarray, np.ndarray], base: float, given: float, n_train: float, name: str) -> tuple[DataFrame, int, int, float]:
    """``rows`` with the labels (``{name}_y``) and weights (``{name}_w``) that a view gives to unlabelled ones.

    ``seen`` has the classes and logits of the rows kept apart.
    """
    rows = rows.drop(f"{name}_y", f"{name}_w").withColumn("__z", logit)
    cuts = rows.filter("y is null").agg(F.percentile_approx("__z", [given * (1 - base), 1 - given * base], 10_000)).first()[0]
    if cuts is None or not cuts[0] < cuts[1]:
        cuts = [-np.inf, np.inf]
    y, z = seen
    # How often the view was right there, less what chance gives.
    knows = []
    for c, share, there in ((1.0, base, z >= cuts[1]), (0.0, 1 - base, z <= cuts[0])):
        right = ((y[there] == c).sum() + DOUBT * share) / (there.sum() + DOUBT)
        knows.append(max(0.0, (right - share) / (1 - share)))
    good = F.col("y").isNull() & (F.col("__z") >= F.lit(float(cuts[1])))
    bad = F.col("y").isNull() & (F.col("__z") <= F.lit(float(cuts[0])))
    number = rows.agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad")).first()
    counts = [n if k > 0 else 0 for n, k in zip((number.good, number.bad), knows)]
    total = sum(n * k for n, k in zip(counts, knows))
    scale = min(1.0, n_train / total) if total else 0.0
    weight = F.when(good, knows[0] * scale).when(bad, knows[1] * scale).otherwise(0.0)
    marked = rows.withColumns({f"{name}_y": F.when(good, 1.0).when(bad, 0.0), f"{name}_w": weight}).drop("__z")
    return marked, *counts, float(total * scale)


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, given: float = GIVEN,
) -> Model:
    rows = _known_rows(docs, labels, key, text, label, fit_rows)
    train = F.when(F.col("apart"), 0.0).otherwise(F.col("own"))
    counted = {r.y: r for r in rows.filter("y is not null").groupBy("y").agg(F.sum("own").alias("n"), F.sum(train).alias("t")).collect()}
    n = sum(r.n for r in counted.values())
    base = float(counted[1.0].n / n) if 1.0 in counted else 0.0 if n else 1.0
    if len(counted) < 2 or min(r.n for r in counted.values()) < MIN_EACH - 0.5:
        return Model(EMPTY, EMPTY, None, base, None)
    n_train = sum(r.t for r in counted.values())
    # A view learns from labelled rows and from what the other one (``by_...``) tells.
    rows = rows.withColumns({"by_meta_y": F.lit(None).cast("double"), "by_meta_w": F.lit(0.0), "by_text_y": F.lit(None).cast("double"), "by_text_w": F.lit(0.0)})

    def learn(teacher: str) -> tuple[Column, Column]:
        return F.coalesce("y", f"{teacher}_y"), F.when(F.col("y").isNotNull(), train).otherwise(F.col(f"{teacher}_w"))

    exchanged = []
    for turn in range(rounds + 1):
        rows = stored(_with_odds(rows.drop("source_odds", "lang_odds", "source_all", "lang_all"), base, *learn("by_text")), "views")
        tv = fit_by_sums(rows, _text_x(), *learn("by_meta"))
        mv = fit_by_sums(rows, _meta_x(), *learn("by_text"))
        logits = {"t": _logit(_text_x(), tv), "m": _logit(_meta_x(), mv)}
        y, t, m = _apart(rows, logits)
        if turn == rounds:
            break
        for view, name, seen in (("t", "by_text", t), ("m", "by_meta", m)):
            rows, good, bad, weight = _lessons(rows, logits[view], (y, seen), base, given, n_train, name)
            exchanged.append(Taught(turn, name, good, bad, weight))
    scaled = [fit_logistic(z[:, None], y) for z in (t, m)]
    both = np.column_stack([c.logit(z[:, None]) for c, z in zip(scaled, (t, m))])
    final = fit_logistic(both, y)
    pairs = rows.groupBy("source", "lang").agg(
        F.first("source_all").alias("source_odds"), F.first("lang_all").alias("lang_odds"), F.count("*").alias("rows")
    ).withColumnsRenamed({"source": "__source", "lang": "__lang"})
    # The calibrations are linear, so they go into the final weights.
    return Model(_calibrated(tv, scaled[0]), _calibrated(mv, scaled[1]), final, base, stored(pairs, "pairs"), tuple(exchanged))


def _calibrated(view: Linear, scale: Linear) -> Linear:
    a = scale.weight[0] / scale.sd[0]
    return Linear(view.mean, view.sd, view.weight * a, float(view.bias * a + scale.bias - a * scale.mean[0]))


def _logit(values: list[Column], view: Linear) -> Column:
    total = F.lit(float(view.bias))
    for v, mean, sd, w in zip(values, view.mean, view.sd, view.weight):
        z = (v - F.lit(float(mean))) / F.lit(float(sd))
        total = total + F.lit(float(w)) * F.greatest(F.least(z, F.lit(CLIP)), F.lit(-CLIP))
    return total


def _pair() -> Column:
    """Source and language as one text; a missing one is unlike any other."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return F.concat(F.char_length(part("__source")).cast("string"), F.lit(":"), part("__source"), part("__lang"))


def score(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with text_score, meta_score, quality_score and kept added; columns of these names are replaced."""
    docs = docs.drop("text_score", "meta_score", "quality_score", "kept")
    if model.final is None:
        base = F.lit(model.base)
        return docs.withColumns({"text_score": base, "meta_score": base, "quality_score": base, "kept": F.lit(True)})
    df = meta_features(docs).withColumn("__pair", _pair())
    pairs = model.pairs.select(_pair().alias("__pair"), "source_odds", "lang_odds", F.col("rows").alias("__rows"))
    pairs = pairs.withColumnsRenamed({"source_odds": "__so", "lang_odds": "__lo"})
    if model.pairs.limit(PAIRS + 1).count() <= PAIRS:
        df = df.join(F.broadcast(pairs), "__pair", "left")
    else:
        df = join_by_frequency(df, pairs, "__pair", "__rows", "left")
    df = text_features(df, text)
    odds = float(np.log(model.base / (1 - model.base)))
    df = df.withColumn("__tl", _logit([F.get("__x", F.lit(i)) for i in range(len(TEXT))], model.text))
    df = df.withColumn("__ml", _logit([F.col("__stated"), F.coalesce("__so", F.lit(odds)), F.coalesce("__lo", F.lit(odds))], model.meta))
    df = df.withColumn("__f", _logit([F.col("__tl"), F.col("__ml")], model.final))

    def p(logit: str) -> Column:
        return 1 / (1 + F.exp(-F.greatest(F.least(F.col(logit), F.lit(35.0)), F.lit(-35.0))))

    df = df.withColumns({"text_score": p("__tl"), "meta_score": p("__ml"), "quality_score": p("__f")})
    working = ("__x", "__tl", "__ml", "__f", "__pair", "__so", "__lo", "__rows", "__stated", "__source", "__lang")
    return df.withColumn("kept", F.col("quality_score") >= keep).drop(*working)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier keeps, columns as they were."""
    columns = docs.columns
    judged = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), *[
        F.col(f"`{c}`") for c in dict.fromkeys((text, "source", "lang", "n_chars")) if c in columns
    ]), fit(docs, labels, key, text), text)
    return judged.filter("kept").select("__row.*")
