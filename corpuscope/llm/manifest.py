"""12. A Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf: the hash of its fields, each written with its length, so that no two
rows of different values give the same bytes. Per tree, leaves are ranked; a node is
the hash of up to FAN_OUT nodes in a row, until one is left; the roots of all trees are
the leaves of one more tree, the crown.

A rank's digits are columns. In a block of FAN_OUT ** DIGITS neighbours the digits are
grouped away one after another, lowest first; every step nests the nodes of a run in a
struct beside their hash. All steps of a block need the one shuffle that dealt the
blocks. Block roots are ranked by block and go the same way, so a tree of any size
has few rounds and no row ever holds more than a block. On the way back, what stands above a block comes to it as one more row
of its group, and one transform over the nested structs gives every leaf its path, with
no join between leaves and nodes.

Only hashes and the key travel; texts are read once, in a narrow stage.

Cases: a null field is ``-``, unlike an empty one; a null tree key is a tree of its own
and the first; a null order key comes first; rows of one order key follow by leaf hash
and, where that is equal too, hold any of their places, which have equal nodes; a tree
of one row has its leaf as its root; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, stored

FAN_OUT = 2
#: Digits that a block groups away: it has FAN_OUT ** DIGITS leaves.
DIGITS = 8


def field(value: Column) -> Column:
    """A value with its length in bytes, or a sign for none."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf(values: Sequence[Column]) -> Column:
    return digest(*map(field, values))


def ranked(leaves: DataFrame, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(tree, rank, levels, digest, payload) of rows (tree, digest, ...): rank within the
    tree in the given order, from 0, and the number of levels above the leaves.

    Rows are cut into ranges of the whole order, so a tree with most of the rows is
    spread as well as any other. A row number that was stored with the row keeps equal
    rows apart, or many of them would be one range.
    """
    numbered = stored(leaves.withColumn("__at", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "digest", "__at"]
    ranges = numbered.repartitionByRange(parts(leaves.sparkSession), *by)
    cut = stored(ranges.withColumn("__part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(W.partitionBy("tree", "__part").orderBy(*by[1:])) - 1
    counts = cut.groupBy("tree", "__part").agg(F.count("*").alias("__n"))
    tree = W.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        F.col("tree").alias("__tree"), "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(tree).alias("__size"),
    )
    # A tree's key is a struct, never null itself, so the join finds null keys too.
    placed = cut.withColumn("__inside", inside).withColumnRenamed("tree", "__tree").join(starts, ["__tree", "__part"])
    powers, power = [], 1
    while power < 1 << 62:
        powers.append(F.lit(power).cast("long"))
        power *= FAN_OUT
    levels = F.size(F.filter(F.array(*powers), lambda x: x < F.col("__size")))
    return placed.select(
        F.col("__tree").alias("tree"), (F.col("__inside") + F.col("__start")).cast("long").alias("rank"),
        levels.alias("levels"), "digest", F.struct(*payload).alias("payload"),
    )


def _rolled(nodes: DataFrame, below: int) -> DataFrame:
    """(tree, block, levels, node): each block's nodes nested; ``below`` levels are done already."""
    digits = [f"__d{i}" for i in range(DIGITS)]
    rows = nodes.select(
        "tree", F.expr(f"rank div {FAN_OUT ** DIGITS}").alias("block"), "levels",
        *[F.expr(f"cast(rank div {FAN_OUT ** i} % {FAN_OUT} as int)").alias(d) for i, d in enumerate(digits)],
        F.struct("digest", "payload").alias("node"),
    ).repartition("tree", "block")
    for i, digit in enumerate(digits):
        rest = ["tree", "block", *digits[i + 1 :]]
        runs = rows.groupBy(*rest).agg(F.max("levels").alias("levels"), F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("run"))
        kids = F.transform("run", lambda x: x["node"])
        rows = runs.select(*rest, "levels", kids.alias("kids"))
        hashed = digest(F.array_join(F.transform("kids", lambda x: x["digest"]), ""))
        # A tree that is one node by now stays as it is.
        own = F.when(F.col("levels") > below + i, hashed).otherwise(F.col("kids")[0]["digest"])
        rows = rows.select(*rest, "levels", F.struct(own.alias("digest"), "kids").alias("node"))
    return rows


def _leaves_of(node: Column, depth: int, below: int, levels: Column, path: Column) -> Column:
    """Array of (payload, digest, path) of the leaves under a node, whose own path is ``path``."""
    if depth == 0:
        return F.array(F.struct(node["payload"].alias("payload"), node["digest"].alias("digest"), path.alias("path")))
    here = levels > below + depth - 1

    def child(kid: Column, i: Column) -> Column:
        side = lambda part: F.array_join(F.transform(part, lambda x: x["digest"]), "")
        left = side(F.slice(node["kids"], F.lit(1), i))
        right = side(F.slice(node["kids"], i + 2, F.lit(FAN_OUT)))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        return _leaves_of(kid, depth - 1, below, levels, F.when(here, F.concat(step, path)).otherwise(path))

    return F.flatten(F.transform(node["kids"], child))


STEPS = "array<struct<left:string,right:string>>"


def paths(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame] | None = None, below: int = 0) -> DataFrame:
    """(tree, payload, digest, subroot, root, path): for every node the hashes beside its way up.

    ``crown`` takes the roots (tree, digest) and gives (tree, root, path) above them;
    without it a tree's root is the root.
    """
    blocks = stored(_rolled(nodes, below), "blocks")
    if blocks.filter("block > 0").head(1):
        up = paths(
            blocks.select("tree", F.col("block").alias("rank"), "levels", "node.digest", F.struct("block").alias("payload")),
            crown, below + DIGITS,
        ).select("tree", "payload.block", "subroot", "root", "path")
    else:
        up = blocks.select("tree", "block", F.col("node.digest").alias("subroot"))
        if crown is None:
            up = up.withColumn("root", F.col("subroot")).withColumn("path", F.array().cast(STEPS))
        else:
            above = crown(blocks.select("tree", "node.digest"))
            up = up.withColumn("root", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast(STEPS))
            up = up.unionByName(above.select("tree", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("subroot"), "root", "path"))
    # A block meets what stands above it in its own group of two or three rows.
    both = blocks.unionByName(up, allowMissingColumns=True)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("levels", "node", "subroot", "root", "path")]
    met = both.groupBy("tree", "block").agg(*first)
    found = _leaves_of(F.col("node"), DIGITS, below, F.col("levels"), F.col("path"))
    return met.select("tree", "subroot", "root", F.explode(found).alias("__x")).select("tree", "__x.*", "subroot", "root")


def crown_of(roots: DataFrame) -> DataFrame:
    """(tree, root, path) of the tree over the roots of all trees, in the order of their keys."""
    leaves = roots.select(F.struct(F.lit(0).alias("one")).alias("tree"), F.col("tree").alias("key"), "digest")
    found = paths(ranked(leaves, ["key"], ["key"]))
    return found.select(F.col("payload.key").alias("tree"), "root", "path")


def proof(path: Column) -> Column:
    """All hashes beside the way up, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(rows: DataFrame, tree: str, order: str, fields: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """``order``, the columns of ``keep``, leaf, subroot, root and path (array of the
    hashes left and right of each step) for every row of ``rows``."""
    by = F.col(f"`{order}`").alias("__order")
    kept = [by, *keep]
    leaves = rows.select(
        F.struct(F.col(f"`{tree}`").alias("key")).alias("tree"), F.struct(*kept).alias("kept"), by, leaf([F.col(f"`{f}`") for f in fields]).alias("digest")
    )
    found = paths(ranked(leaves, ["__order"], ["kept"]), crown_of)
    return found.select("payload.kept.*", F.col("digest").alias("leaf"), "subroot", "root", "path").withColumnRenamed("__order", order)


#: What a leaf of ``documents`` consists of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def verified_manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest of ``documents`` by language, and whether each row still gives its root
    after those whose crc32 of the id is divisible by ``every`` had 1 added to n_chars."""
    # Text that isn't a number stays, as a null does.
    number = F.col("n_chars").try_cast("long")
    changed = [number + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    tampered = F.when(hit & number.isNotNull(), leaf(changed)).alias("tampered")
    found = manifest(docs, "lang", "doc_id", FIELDS, [tampered])
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
