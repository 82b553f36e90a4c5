"""Building blocks that keep ranks, running sums and joins spread out.

None of them puts an unbounded group into one task:

* ``hash_rank`` cuts each stratum into 16^digits buckets of an MD5 order;
* ``running_total`` cuts values at approximate quantiles, then adds exact offsets;
* ``join_by_frequency`` serves the few most frequent keys from a broadcast whose
  row count is bounded by construction, and shuffles the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def hash_order(key: Column | str, seed: int | str) -> Column:
    """Deterministic pseudo-random order, the same on every engine with MD5."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


# Rows that meet in one bucket, about.
BUCKET_ROWS = 50_000


def _with_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows, and the one row that each bucket starts with (``__first``).

    The offsets take part in the buckets' own window, so rows are shuffled once.
    """
    return rows.withColumn("__first", F.lit(0)).unionByName(
        offsets.withColumn("__first", F.lit(-1)), allowMissingColumns=True
    )


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int | str,
    strata: Sequence[str] = (),
    out: str = "hash_rank",
    size: str | None = None,
) -> DataFrame:
    """Exact 1-based rank in hash order, within strata; ``size`` adds their sizes.

    The hash is uniform, so its first digits cut even one all-holding stratum
    into equal buckets; their number follows the number of rows, and only bucket
    counts are summed up in order. Rows are shuffled once, by stratum and bucket.
    """
    strata = list(strata)
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, (F.count("*") + 1) / F.lit(BUCKET_ROWS)))).cast("int")
    keyed = df.withColumn("__h", hash_order(key, seed)).withColumn(
        "__b", F.substring("__h", F.lit(1), df.agg(digits).scalar())
    )
    groups = [*strata, "__b"]
    before = W.partitionBy(*strata).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*groups)
        .agg(F.count("*").alias("__n"))
        .withColumn("__w", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__size", F.sum("__n").over(W.partitionBy(*strata)))
        .drop("__n")
    )
    inside = W.partitionBy(*groups).orderBy("__first", "__h", key).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = _with_offsets(keyed.withColumn("__w", F.lit(1).cast("long")), offsets)
    ranked = ranked.withColumn(out, F.sum("__w").over(inside))
    if size is not None:
        ranked = ranked.withColumn(size, F.first("__size").over(inside))
    return ranked.filter(F.col("__first") == 0).drop("__h", "__b", "__w", "__size", "__first")


def running_total(
    df: DataFrame,
    value: str,
    weight: str,
    by: Sequence[str] = (),
    out: str = "cumulative",
    total: str | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Running sum of ``weight`` in order of ``value``; one row per (by, value).

    ``total`` adds the sum of the whole group.

    Cut points come from one approximate-quantile row; wherever they fall, the
    sums are exact, since each bucket starts from the total of those before it.
    Rows are stored first, since cuts, offsets and sums read them, and shuffled once, by
    group and bucket.
    """
    by = list(by)
    df = written(df, "running")
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(10 * buckets))))
    v = F.col(value).cast("double")
    bucketed = df.withColumn("__cuts", cuts.scalar()).withColumn(
        "__b", F.size(F.filter("__cuts", lambda c: c < v))
    )
    bucketed = bucketed.drop("__cuts")
    groups = [*by, "__b"]
    before = W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*groups)
        .agg(F.sum(weight).alias("__s"))
        .withColumn("__w", F.coalesce(F.sum("__s").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__s").over(W.partitionBy(*by)))
        .drop("__s")
    )
    inside = (
        W.partitionBy(*groups).orderBy("__first", value).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    summed = _with_offsets(bucketed.withColumn("__w", F.col(weight)), offsets)
    summed = summed.withColumn(out, F.sum("__w").over(inside))
    if total is not None:
        summed = summed.withColumn(total, F.first("__total").over(inside))
    return summed.filter(F.col("__first") == 0).drop("__b", "__w", "__total", "__first")


def join_by_frequency(
    left: DataFrame,
    right: DataFrame,
    on: str,
    frequency: str,
    how: str = "inner",
    max_hot: int = 1000,
) -> DataFrame:
    """Join a lookup table whose ``frequency`` tells how often each key occurs.

    Fewer than ``max_hot`` keys can each hold more than 1/max_hot of all
    occurrences, so the hot part of the lookup is broadcast safely; rows with a
    hot key never enter the shuffle of the cold part. The lookup, one row per
    key, is stored first, since it is read for its total and for both parts.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    lookup = written(right, "lookup")
    total = lookup.agg(F.sum(frequency))
    is_hot = F.coalesce(F.col(frequency) > total.scalar() / F.lit(max_hot), F.lit(False))
    hot = lookup.filter(is_hot)
    cold = lookup.filter(~is_hot)
    by_broadcast = left.join(F.broadcast(hot), on, "inner")
    by_shuffle = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, how)
    return by_broadcast.unionByName(by_shuffle)
