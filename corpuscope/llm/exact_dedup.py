"""3. Exact duplicates by deterministic naming of blocks.

Texts lose their white space and are cut into blocks of BLOCK bytes. The distinct
blocks are sorted and numbered; then adjacent numbers are paired, and the distinct
pairs are sorted and numbered, until each document has one number. Documents of
equal byte length have equal texts exactly when their numbers agree: every name
stands for one content, so there are no collisions.

Distinct contents are found with partial aggregation before the shuffle, so a block
that a third of the documents share meets once per task. Numbers are ranks within
buckets. Content travels once to be numbered; documents find the number by a
128-bit digest, after a count over all distinct contents has shown that no two of
them share one (else other seeds are taken).

Cases: null counts as empty; empty texts are equal to each other and to texts of
white space; of equal texts the row with the most code points, then the smallest
doc_id (nulls last) stays, and of rows that agree in both exactly one; every row
gives a row; other columns are kept, named as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, parts, stored, text_of, whole

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def _numbered(distinct: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Add ``name``: the rank among the sorted rows of a bucket, and the bucket."""
    bucketed = distinct.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.row_number().over(W.partitionBy("__b").orderBy(*keys))
    return bucketed.withColumn("name", rank * F.lit(buckets) + F.col("__b")).drop("__b")


def _blocks(docs: DataFrame, text: str, seed: int, keep: list[Column]) -> DataFrame:
    bare = docs.select(*keep, text_of(text).alias("t")).withColumn("bin", normalised(F.col("t")).cast("binary"))
    named = [c for c in bare.columns if c not in ("t", "bin")]
    measured = bare.select(
        *named, "bin", F.char_length("t").cast("long").alias("n_chars"),
        F.octet_length("bin").cast("long").alias("n_bytes"), F.sha2("bin", 256).alias("sha"),
    )
    last = F.greatest(F.ceil(F.col("n_bytes") / F.lit(BLOCK)) - 1, F.lit(0)).cast("int")
    each = measured.withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    cut = each.withColumn("block", F.expr(f"substring(bin, at * {BLOCK} + 1, {BLOCK})")).drop("bin")
    return cut.withColumn("d1", F.xxhash64("block", F.lit(seed))).withColumn("d2", F.xxhash64(F.lit(seed + 1), "block"))


def _block_names(docs: DataFrame, text: str, buckets: int) -> tuple[DataFrame, int]:
    for seed in range(0, 1000, 2):
        distinct = _blocks(docs, text, seed, []).select("block", "d1", "d2").groupBy("block", "d1", "d2").agg(F.lit(0).alias("o"))
        names = stored(
            _numbered(distinct.drop("o"), ["d1", "d2", "block"], buckets).drop("block"), "block-names"
        )
        if not names.groupBy("d1", "d2").count().filter("count > 1").head(1):
            return names, seed
    raise AssertionError("no seed tells the blocks apart")


def identities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``docs`` but the text, with n_chars, n_bytes, sha and ``name``.

    Equal (n_bytes, name) means equal normalised text. The result is a stored table.
    """
    spark = docs.sparkSession
    buckets = 4 * parts(spark)
    names, seed = _block_names(docs, text, buckets)
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(c) for c in others]) if others else F.struct(F.lit(0).alias("none"))
    keep = [F.monotonically_increasing_id().alias("row"), row.alias("rest")]
    cut = _blocks(docs, text, seed, keep).drop("block")
    # What describes the document goes with its first block.
    first = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("rest", "n_chars", "sha")]
    pieces = stored(
        cut.select("row", "at", "d1", "d2", "n_bytes", *first).join(names, ["d1", "d2"]).drop("d1", "d2"),
        "named-blocks",
    )
    about = pieces.filter("at = 0").select("row", "rest", "n_chars", "n_bytes", "sha")
    longest = pieces.agg(F.max("at")).first()[0] or 0
    done = pieces.filter(f"n_bytes <= {BLOCK}").select("row", "name")
    level = pieces.filter(f"n_bytes > {BLOCK}").select("row", "at", "name")
    while longest > 0:
        pairs = level.groupBy("row", F.expr("at div 2").alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pair_names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], buckets)
        level = stored(pairs.join(pair_names, ["a", "b"]).select("row", "at", "name"), "named-pairs")
        longest //= 2
    one = done.unionByName(level.select("row", "name"))
    return about.join(one, "row")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 and n_chars of every row."""
    rows = identities(docs.select(key, text), text).select(
        "row", F.col(f"rest.{key}").alias("key"), "n_chars", "n_bytes", "name", "sha"
    )
    rows = stored(rows, "identities")
    best = F.struct(-F.col("n_chars"), F.col("key").isNull(), F.col("key"), F.col("row"))
    groups = rows.groupBy("n_bytes", "name").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    picked = groups.select(
        "n_bytes", "name", "group_size", F.col("best.key").alias("keep_id"), F.col("best.row").alias("keep_row")
    )
    return rows.join(picked, ["n_bytes", "name"]).select(
        F.col("key").alias(key), "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars",
    )


def drop_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, all columns and texts as they were."""
    kept = exact_duplicates(docs, key, text).filter("kept").select(
        F.col(key).alias("__key"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n")
    )
    # Of rows that agree in doc_id, length and normalised text one stays.
    tagged = docs.select(
        whole(docs), F.col(key).alias("own"), F.char_length(text_of(text)).cast("long").alias("n"),
        F.sha2(normalised(text_of(text)).cast("binary"), 256).alias("sha"),
    )
    same = F.col("own").eqNullSafe(F.col("__key")) & (F.col("sha") == F.col("__sha")) & (F.col("n") == F.col("__n"))
    return tagged.join(kept, same).dropDuplicates(["__key", "__sha", "__n"]).select("__doc.*")
