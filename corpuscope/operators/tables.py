"""Relational verbs that Spark needs a few steps for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import _null_safe_join, hash_order, hash_rank, running_total

# --- selection and renaming -------------------------------------------------


def columns_like(
    df: DataFrame, starts: str = "", ends: str = "", contains: str = "", drop: bool = False
) -> DataFrame:
    """Keep (or drop) the columns whose names match all given parts."""
    hit = [
        c
        for c in df.columns
        if c.startswith(starts) and c.endswith(ends) and contains in c
    ]
    return df.drop(*hit) if drop else df.select(*hit)


def rename_with(df: DataFrame, rename: Callable[[str], str], starts: str = "") -> DataFrame:
    return df.toDF(*[rename(c) if c.startswith(starts) else c for c in df.columns])


def across(df: DataFrame, names: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in names})


# --- counts, shares, summaries ----------------------------------------------


def share_of_total(df: DataFrame, n: str, out: str = "share") -> DataFrame:
    """n / sum(n) over the whole frame, the total as a scalar subquery."""
    total = df.agg(F.sum(n))
    return df.withColumn(out, F.try_divide(F.col(n), total.scalar()))


def share_within(df: DataFrame, by: Sequence[str], n: str, out: str = "share") -> DataFrame:
    """n / sum(n) within groups; meant for frames that are already aggregated."""
    return df.withColumn(out, F.try_divide(F.col(n), F.sum(n).over(W.partitionBy(*by))))


def count_share(df: DataFrame, *keys: str) -> DataFrame:
    return share_of_total(df.groupBy(*keys).agg(F.count("*").alias("n")), "n")


def with_distinct_count(df: DataFrame, by: Sequence[str], key: str, out: str) -> DataFrame:
    """Attach the number of distinct keys of each group to its rows."""
    counts = df.groupBy(*by).agg(F.countDistinct(key).alias(out))
    return _null_safe_join(df, counts, by, "inner")


def frequencies(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count("*").alias("__freq"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    freq: str | None = None,
    moments: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation at (N - 1) p, per group.

    Works on value frequencies with a bucketed running sum, so a group of any
    size is spread over tasks. ``freq`` names a frequency column when ``df`` is
    already a table of (by, value, frequency). ``moments`` adds
    size, min, mean and max.
    """
    by = list(by)
    table = (
        df.withColumnRenamed(freq, "__freq") if freq else frequencies(df, value, by)
    )
    cum = running_total(table, value, "__freq", by, out="__cum", total="__N")
    v = F.col(value).cast("double")
    picks = [F.max("__N").alias("__N")]
    if moments:
        picks.append(F.min(v).alias("min"))
        picks.append((F.sum(v * F.col("__freq")) / F.max("__N")).alias("mean"))
        picks.append(F.max(v).alias("max"))
    for i, p in enumerate(probs.values()):
        at = (F.col("__N") - 1) * F.lit(p)
        picks.append(F.min(F.when(F.col("__cum") > F.floor(at), v)).alias(f"__lo{i}"))
        picks.append(F.min(F.when(F.col("__cum") > F.ceil(at), v)).alias(f"__hi{i}"))
    out = cum.groupBy(*by).agg(*picks)
    for i, (name, p) in enumerate(probs.items()):
        at = (F.col("__N") - 1) * F.lit(p)
        frac = at - F.floor(at)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out = out.withColumn(name, F.when(frac == 0, lo).otherwise(lo + frac * (hi - lo)))
    extra = [F.col("__N").alias("size"), "min", "mean", "max"] if moments else []
    return out.select(*by, *probs, *extra)


def six_numbers(df: DataFrame, value: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum in one row."""
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    out = exact_quantiles(df, value, quartiles, moments=True)
    return out.select("min", "q1", "median", "mean", "q3", "max")


def with_group_value(df: DataFrame, groups: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Attach a value per group where the groups are a handful.

    ``groups`` (one row per keys) travels as one map in a scalar subquery, so
    rows are not shuffled by a key with few values.
    """
    entries = F.collect_list(F.struct(F.struct(*keys), F.col(value)))
    table = groups.agg(F.map_from_entries(entries))
    return (
        df.withColumn("__map", table.scalar())
        .withColumn(value, F.element_at("__map", F.struct(*keys)))
        .drop("__map")
    )


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    w = F.col(w) if isinstance(w, str) else w
    return F.try_divide(F.sum(x * w), F.sum(w))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Cumulative share of rows at or below each distinct value."""
    cum = running_total(frequencies(df, value), value, "__freq", out="__cum", total="__N")
    return cum.select(
        value, F.col("__freq").alias("n"), (F.col("__cum") / F.col("__N")).alias("ecdf")
    )


def histogram(
    df: DataFrame, value: Column, bins: int = 80, by: Sequence[str] = ()
) -> DataFrame:
    """Counts over equal-width bins that span the range of all rows."""
    valued = df.withColumn("__v", value).filter(F.col("__v").isNotNull())
    ends = valued.agg(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    binned = valued.withColumn("__ends", ends.scalar())
    binned = binned.withColumn("__lo", F.col("__ends.lo")).withColumn("__hi", F.col("__ends.hi"))
    position = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins
    binned = binned.withColumn(
        "bin",
        F.when(F.col("__hi") == F.col("__lo"), F.lit(1))
        .otherwise(F.least(F.floor(position) + 1, F.lit(bins)))
        .cast("int"),
    )
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def sum_and_mean(names: Sequence[str]) -> list[Column]:
    """``<name>_sum`` and ``<name>_mean`` aggregates of boolean columns."""
    out = []
    for c in names:
        out.append(F.sum(F.col(c).cast("long")).alias(f"{c}_sum"))
        out.append(F.avg(F.col(c).cast("double")).alias(f"{c}_mean"))
    return out


# --- distinct, first, modes --------------------------------------------------


def keep_first(df: DataFrame, key: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """One row per key, the first by priority, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, "__best.*").select(*df.columns)


def modes(df: DataFrame, by: str, value: str, order: str, na_rm: bool = False) -> DataFrame:
    """All most frequent values per group, in order of first appearance.

    A null value counts as a category unless ``na_rm``. Values are counted first,
    so what is collected per group is one entry per distinct value.
    """
    rows = df.filter(F.col(value).isNotNull()) if na_rm else df
    counted = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    entries = F.collect_list(F.struct("n", "o", F.col(value).alias("v")))
    ordered = F.array_sort(
        F.transform("__e", lambda e: F.struct(e["o"].alias("o"), e["n"].alias("n"), e["v"].alias("v")))
    )
    top = F.array_max(F.transform("__e", lambda e: e["n"]))
    return (
        counted.groupBy(by)
        .agg(entries.alias("__e"))
        .withColumn("__top", top)
        .withColumn("__o", ordered)
        .select(
            by,
            F.transform(
                F.filter("__o", lambda e: e["n"] == F.col("__top")), lambda e: e["v"]
            ).alias("mode"),
        )
    )


def unanimous(value: str) -> Column:
    """Aggregate: true when a group holds exactly one distinct value, null included."""
    nulls = F.max(F.when(F.col(value).isNull(), 1).otherwise(0))
    return (F.countDistinct(value) + nulls == 1).alias("identical")


# --- ranks -------------------------------------------------------------------


def top_n(df: DataFrame, value: str, n: int, by: Sequence[str] = (), lowest: bool = False) -> DataFrame:
    """The n highest (or lowest) values by minimum rank, ties kept.

    The n-th value of each group is found among its distinct values, of which only
    the first n with their counts are ranked; rows are then compared with it, so
    ties stay in the tasks they are in.
    """
    valued = df.filter(F.col(value).isNotNull())
    order = F.col(value).asc() if lowest else F.col(value).desc()
    inside = W.partitionBy(*by).orderBy(order)
    counted = valued.groupBy(*by, value).agg(F.count("*").alias("__n"))
    first = counted.withColumn("__k", F.row_number().over(inside)).filter(F.col("__k") <= n)
    before = F.coalesce(F.sum("__n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("__before", before).filter(F.col("__before") < n)
    last = F.max(value) if lowest else F.min(value)
    if not by:
        cut = kept.agg(last).scalar()
        return valued.filter(F.col(value) <= cut if lowest else F.col(value) >= cut)
    cuts = kept.groupBy(*by).agg(last.alias("__cut"))
    hit = F.col(value) <= F.col("__cut") if lowest else F.col(value) >= F.col("__cut")
    return _null_safe_join(valued, cuts, by, "inner").filter(hit).drop("__cut")


def top_and_bottom(df: DataFrame, value: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """n highest and n lowest rows with ties; a row may stand on both sides."""
    top = top_n(df, value, n, by).withColumn("side", F.lit("top"))
    bottom = top_n(df, value, n, by, lowest=True).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def ordered_slice(df: DataFrame, first: int, last: int, *order: Column) -> DataFrame:
    """Rows first..last (1-based) of an order, through a bounded top-k."""
    return df.orderBy(*order).limit(last).offset(first - 1)


def value_order(df: DataFrame, by: Sequence[str], value: str, out: str = "ord") -> DataFrame:
    """Position by value within a group, for display frames of bounded size."""
    rest = [F.col(c) for c in df.columns if c not in (*by, value)]
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(value, *rest)))


# --- sampling ----------------------------------------------------------------


#: Hexadecimal digits of a hash that a sample's histogram is over.
_DIGITS = 4


def sample_fixed(df: DataFrame, key: str, k: int, seed: int | str) -> DataFrame:
    """The first k rows in hash order.

    A histogram of the first digits of the hash tells which of its 16 ** _DIGITS cells
    holds the k-th row. Rows of cells before it are taken by a filter, where they are;
    only those of that one cell are ranked.
    """
    # Rows without a key come first.
    cell = F.coalesce(F.substring(hash_order(key, seed), 1, _DIGITS), F.lit(""))
    sizes = df.groupBy(cell.alias("c")).agg(F.count("*").alias("n"))
    # At most 16 ** _DIGITS cells.
    upto = sizes.select("c", "n", F.sum("n").over(W.orderBy("c")).alias("upto"))
    edge = upto.filter(F.col("upto") >= k).agg(F.min(F.struct("c", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    edge = edge.select(F.coalesce("e.c", F.lit("g")).alias("c"), F.coalesce("e.before", F.lit(0)).alias("before")).first()
    before = df.filter(cell < edge.c)
    last = hash_rank(df.filter(cell == edge.c), key, seed, out="__r").filter(F.col("__r") <= k - edge.before)
    return before.unionByName(last.drop("__r"))


def shuffle_rows(df: DataFrame, key: str, seed: int | str) -> DataFrame:
    return df.orderBy(hash_order(key, seed), F.col(key))


def stratified_split(df: DataFrame, key: str, label: str, prop: float, seed: int | str) -> DataFrame:
    """Mark floor(prop * size) rows of each label as ``train``, the rest as ``test``."""
    ranked = hash_rank(df, key, seed, [label], out="__r", size="__N")
    is_train = F.col("__r") <= F.floor(F.col("__N") * F.lit(prop))
    return ranked.withColumn("split", F.when(is_train, "train").otherwise("test")).drop(
        "__r", "__N"
    )


def stratified_folds(df: DataFrame, key: str, label: str, v: int, seed: int | str) -> DataFrame:
    """Fold number 0..v-1, balanced within each label."""
    ranked = hash_rank(df, key, seed, [label], out="__r")
    return ranked.withColumn("fold", F.pmod(F.col("__r"), F.lit(v)).cast("int")).drop("__r")


def upsample(df: DataFrame, key: str, label: str, seed: int | str) -> DataFrame:
    """Repeat rows of smaller classes until every class is as large as the largest.

    Each row is kept floor(max/size) times, and the first max mod size rows in
    hash order once more, so every row stays.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n"))
    ranked = hash_rank(df, key, seed, [label], out="__r", size="__N").withColumn(
        "__max", largest.scalar()
    )
    size, most = F.col("__N"), F.col("__max")
    copies = F.floor(most / size) + F.when(F.col("__r") <= most % size, 1).otherwise(0)
    return ranked.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))
    ).drop("__r", "__N", "__max")


# --- reshaping ----------------------------------------------------------------


def tagged_union(frames: Mapping[str, DataFrame], tag: str = "coding") -> DataFrame:
    """Union by name with a column that tells the source frame."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def mapped(frames: Mapping[str, DataFrame], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return tagged_union({name: f(df) for name, df in frames.items()})


def complete(
    df: DataFrame,
    keys: Sequence[str],
    over: str,
    value: str,
    levels: Sequence | None = None,
    fill=0,
) -> DataFrame:
    """Every key with every level of ``over``; missing ones get ``fill``.

    ``over`` must be a small category. Its levels travel as one array, so no
    key is joined with anything: each key's own rows become a map that is read
    for each level.
    """
    if levels is None:
        found = df.agg(F.array_sort(F.collect_set(over)))
        levels_col = found.scalar()
    else:
        levels_col = F.array(*[F.lit(x) for x in levels])
    entries = F.map_from_entries(F.collect_list(F.struct(over, value)))
    grouped = df.groupBy(*keys).agg(entries.alias("__m")).withColumn("__levels", levels_col)
    exploded = grouped.select(*keys, "__m", F.explode("__levels").alias(over))
    filled = F.coalesce(F.element_at("__m", F.col(over)), F.lit(fill))
    return exploded.select(*keys, over, filled.cast(df.schema[value].dataType).alias(value))


def pivot_fill(
    df: DataFrame, keys: Sequence[str], names: str, value: str, levels: Sequence, fill=0
) -> DataFrame:
    wide = df.groupBy(*keys).pivot(names, list(levels)).agg(F.first(value))
    return wide.na.fill(fill, [str(x) for x in levels])


def pivot_many(
    df: DataFrame, keys: Sequence[str], names: str, values: Sequence[str], levels: Sequence
) -> DataFrame:
    """Columns ``<value>_<level>`` for several values at once."""
    aggs = [F.first(v).alias(v) for v in values]
    if len(aggs) == 1:
        aggs.append(F.count("*").alias("__drop"))
    wide = df.groupBy(*keys).pivot(names, list(levels)).agg(*aggs)
    picks = [
        F.col(f"`{x}_{v}`").alias(f"{v}_{x}") for v in values for x in levels
    ]
    return wide.select(*keys, *picks)


def mark(df: DataFrame, keys: DataFrame, on: str, out: str) -> DataFrame:
    """Flag rows whose key is in another frame."""
    flagged = keys.select(on).distinct().withColumn(out, F.lit(True))
    return df.join(flagged, on, "left").withColumn(out, F.coalesce(out, F.lit(False)))
