"""2. Mixing sources to target weights by a low-discrepancy schedule.

Sources in code point order weigh 1, 2, 3, repeating. They share all words by
weight, but none takes more than LIMIT times what it has; what is over is shared
again among the others until none is above.

The documents of a source, in hash order, form one run of words, cut into blocks of
BLOCK words. The schedule has a slot for every block that is taken: slot t looks up
the golden-ratio point of t among the cumulated slot numbers of the sources, which
spreads each source evenly over the mix. The k-th slot of a source takes its k-th
block, from the first again after the last; its last slot takes the words that are
left of the target. Points fall a few slots short of or over a source's number:
those over are left out, and those short come after the schedule.

The heavy steps are by (source, bucket): a source that holds a third of the rows is
cut into as many buckets as its rows need, with exact sums carried over.

Cases: null texts have size 0 and are not taken; the null source is one source and
comes last; without words all targets are 0; rows that repeat an id are documents
of their own; only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ordered_parts, running, stored, text_of, whole

BLOCK, LIMIT, SEED = 1024, 3, "mix"
WEIGHTS = (1, 2, 3)
#: Rows that meet in one bucket, about.
ROWS = 50_000
#: Odd, near 2^31 divided by the golden ratio: multiples of it modulo 2^31 are evenly spread.
STEP, TURN = 1327217885, 1 << 31


def n_words(text: Column) -> Column:
    """Words are the borders from space to other characters, counted without making them."""
    bare = F.regexp_replace(F.concat(F.lit(" "), text), f"(?:{SPACE}+[^\\x20\\x09-\\x0D]+)", "x")
    return F.char_length(F.regexp_replace(bare, SPACE + "+", "")).cast("long")


def document_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (its number), key, source, size and place (hash order), stored."""
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
            n_words(text_of(text)).alias("size"), F.xxhash64(text_of(text)).alias("h"),
            F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("place"),
        ),
        "sizes",
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sid, source, source_size, weight and target (double) of every source, stored."""
    by = [F.col("source").isNull(), F.col("source")]
    table = ordered_parts(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by, "sources")
    ranked = running(table, F.lit(1), by, "sid", F.col("part")).drop("part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    sources = stored(ranked.withColumn("weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, shares, n = total, None, -1

    def wide(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    def above() -> Column:
        """What a share of left / shares would take over its limit."""
        most = wide(F.col("source_size")) * F.lit(limit)
        return wide(F.col("weight")) * F.lit(left).cast("decimal(19,0)") > most * F.lit(shares).cast("decimal(19,0)")

    full = F.lit(False)
    while True:
        rest = sources.filter(~full).agg(F.sum("weight").alias("w")).first().w or 0
        spent = sources.filter(full).agg(F.sum("source_size").alias("s"), F.count("*").alias("n")).first()
        left, shares = total - limit * (spent.s or 0), max(rest, 1)
        if spent.n == n:
            break
        n, full = spent.n, above()
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(shares))
    target = F.when(full, (F.lit(limit) * F.col("source_size")).cast("double")).otherwise(share)
    return stored(sources.withColumn("target", target), "targets")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """t (place in the mix), sid, k (its rank in the source), block and words of every slot."""
    spark = targets.sparkSession
    needs = targets.filter("source_size > 0").select("sid", "source_size", F.floor("target").alias("words"))
    needs = needs.withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}")).withColumn(
        "slots", F.expr(f"(words div source_size) * blocks + (words % source_size + {block} - 1) div {block}")
    )
    by = [F.col("sid")]
    spread = ordered_parts(needs.filter("slots > 0"), by, "slots")
    needs = stored(running(spread, F.col("slots"), by, "first", F.col("part")).drop("part"), "slots")
    sums = needs.agg(F.sum("slots").alias("n"), F.count("*").alias("sources")).first()
    n = sums.n or 0
    # Cells of the line of all slots; a source is listed in those it touches.
    width = max(1, -(-n // max(4096, 4 * sums.sources)))
    cells = needs.select(
        "sid", "first", "slots", F.explode(F.expr(f"sequence(first div {width}, (first + slots - 1) div {width})")).alias("cell")
    )
    point = F.floor((F.col("t") % TURN) * STEP % TURN / F.lit(float(TURN)) * F.lit(float(n))).cast("long")
    points = spark.range(n).withColumnRenamed("id", "t").withColumn("v", point).withColumn("cell", F.expr(f"v div {width}"))
    drawn = points.join(cells, "cell").filter("v >= first and v < first + slots").select("t", "sid")
    ranked = stored(running(drawn, F.lit(1), [F.col("t")], "k", F.expr(f"t div {ROWS}"), ["sid"]), "schedule")
    got = needs.join(ranked.groupBy("sid").agg(F.count("*").alias("got")), "sid", "left")
    short = got.withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    # The k-th slot that a source lacks comes k places after the schedule.
    late = short.select("sid", F.explode(F.expr("sequence(got, slots - 1)")).alias("k")).withColumn("t", F.col("k") + n)
    slots = ranked.unionByName(late).join(needs.select("sid", "source_size", "blocks", "slots", "words"), "sid").filter("k < slots")
    before = F.expr(f"(k div blocks) * source_size + (k % blocks) * {block}")
    whole = F.expr(f"least({block}, source_size - (k % blocks) * {block})")
    return slots.select(
        "t", "sid", "k", F.expr("k % blocks").alias("block"),
        F.least(whole, F.col("words") - before).alias("words"), whole.alias("whole"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """key, h (hash of the text), size, source_size, target and taken of every row."""
    sizes = document_sizes(docs, key, text, source)
    targets = source_targets(sizes)
    slots = schedule(targets, block)
    # How often a block is taken whole, and the words of its last, shorter turn.
    turns = slots.groupBy("sid", "block").agg(
        F.sum(F.when(F.col("words") == F.col("whole"), 1).otherwise(0)).alias("turns"),
        F.max(F.when(F.col("words") < F.col("whole"), F.col("words")).otherwise(0)).alias("part"),
    )
    same = sizes["source"].eqNullSafe(targets["source"])
    placed = sizes.join(targets, same).select("row", "key", "h", "size", "place", "sid", "source_size", "target")
    placed = stored(placed, "placed")
    n = placed.count()
    digits = 1
    while 16**digits * ROWS < n:
        digits += 1
    bucket = F.conv(F.substring("place", 1, digits), 16, 10).cast("long")
    order = [F.col("place"), F.col("key"), F.col("h"), F.col("row")]
    laid = running(placed.filter("size > 0"), F.col("size"), order, "start", bucket, ["sid"])
    pieces = laid.select(
        "row", "sid", "start", (F.col("start") + F.col("size")).alias("end"),
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"),
    )
    first, last = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    part = F.greatest(F.least(last, F.col("block") * block + F.col("part")) - first, F.lit(0))
    taken = pieces.join(turns, ["sid", "block"]).groupBy("row").agg(F.sum((last - first) * F.col("turns") + part).alias("taken"))
    return placed.join(taken, "row", "left").select(
        F.col("key").alias(key), "h", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; columns as they were."""
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    often = mix(docs, key, text, source).filter("size > 0").withColumn("__times", times).filter("__times > 0")
    # Rows that agree in id and text share their copies; the first of them stands for all.
    often = often.groupBy(F.col(key).alias("__key"), F.col("h").alias("__h")).agg(F.sum("__times").alias("__times"))
    tagged = docs.select(whole(docs), F.col(key).alias("own"), F.xxhash64(text_of(text)).alias("of"))
    same = F.col("own").eqNullSafe(F.col("__key")) & (F.col("of") == F.col("__h"))
    once = tagged.join(often, same).dropDuplicates(["__key", "__h"])
    return once.select("__doc", F.explode(F.expr("sequence(1, cast(__times as int))"))).select("__doc.*")
