"""8. Document fingerprints by winnowing, with built-in functions only.

Every K words in a row are hashed; of every WINDOW hashes in a row the smallest is
chosen, of equal ones the rightmost, and kept with its place. Two texts that share
K + WINDOW - 1 words in a row share a chosen hash. In a run of more than PIECE characters
without white space every character counts as a word, so that grams begin at every
one of them and scripts without spaces have the same guarantee, in characters.

``edited_pairs`` brings each document together with the next one in descending
order of id without sorting everything in one task: buckets of about BUCKET bytes
are cut at quantiles of the id, and the first document of each bucket is also sent to
the bucket before it. An id that many rows have, or no id, has buckets of its own, cut by
the text's hash, in which equal texts are one row with a number.

Cases: ids are numbers, or cast to them; null counts as empty; texts of fewer than K words have one hash and texts of
fewer than K + WINDOW - 1 words one window; texts without words have no hashes, and
two such texts are alike (1), else nothing is like them (0). Null ids come last; rows
that repeat an id are ordered by their text's hash, and every row gives a row. A single
document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

K, WINDOW, PIECE = 5, 4, 16
#: Bytes of text in a bucket, and the most buckets (beyond, they grow).
BUCKET, BUCKETS = 4 << 20, 250_000
CUTS = 1000
#: A run of up to PIECE characters, or a character of a longer one.
_IN = r"[^\x20\x09-\x0D]"
WORD = rf"(?<!{_IN}){_IN}{{1,{PIECE}}}+(?!{_IN})|{_IN}"
#: Slices of the hashes of one frequent id, at most.
SLICES = 1 << 12
LAST = (1 << 32) - 1
LONG = (1 << 63) - 1


def winnow(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``out``, an array of longs in text order: 31 bits of hash, then 2^32 - 1 - place."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    hashed = df.withColumn("__w", F.transform(pieces, lambda w: F.xxhash64(w)))

    def gram(i: Column) -> Column:
        h = F.xxhash64(*[F.get("__w", i + j) for j in range(k)])
        # One number orders by hash, and of equal hashes puts the later place first.
        return F.shiftleft(F.shiftrightunsigned(h, 33), 32) + (F.lit(LAST) - i)

    n = F.size("__w")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)
    hashed = hashed.withColumn("__g", F.when(n > 0, grams).otherwise(F.array().cast("array<long>")))

    def smallest(i: Column) -> Column:
        return F.least(*[F.get("__g", i + j) for j in range(window)])

    m = F.size("__g")
    chosen = F.transform(F.sequence(F.lit(0), F.greatest(m - window, F.lit(0))), smallest)
    picked = F.when(m > 0, F.array_distinct(chosen)).otherwise(F.array().cast("array<long>"))
    return hashed.withColumn(out, picked).drop("__w", "__g")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def places(fingerprint: Column) -> Column:
    """Word numbers at which the chosen hashes start."""
    return F.transform(fingerprint, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Share of the hashes of two fingerprints that both have."""
    both = df.withColumn("__a", hashes(F.col(a))).withColumn("__b", hashes(F.col(b)))
    both = both.withColumn("__n", F.size(F.array_intersect("__a", "__b")).cast("double"))
    total = F.size("__a") + F.size("__b") - F.col("__n")
    return both.withColumn(out, F.when(total > 0, F.col("__n") / total).otherwise(1.0)).drop("__a", "__b", "__n")


def digest(fingerprint: str) -> Column:
    return F.sha2(F.array_join(F.col(fingerprint).cast("array<string>"), ",").cast("binary"), 256)


def _bucketed(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, t (text), h (its hash), bucket and copies: the buckets rise with the id and, inside
    an id, against the hash. Null ids have the lowest ones."""
    measured = docs.agg(F.sum(F.octet_length(text_of(text))), F.count("*"), F.count(key)).first()
    total, rows, known = (x or 0 for x in measured)
    n = min(BUCKETS, max(1, -(-total // size)))
    ids = F.col(key).cast("long")
    cuts = min(n, CUTS)
    at = [i / cuts for i in range(cuts + 1)]
    found = docs.agg(F.percentile_approx(ids, at, 20 * CUTS)).first()[0] or [0]
    # An id at several cuts has at least the rows between them.
    often = sorted({a for a, b in zip(found, found[1:]) if a == b})
    points = sorted({*found, *often, *(x + 1 for x in often if x < LONG)})
    inner, fine = points[1:-1] if len(points) > 2 else [], -(-n // cuts)
    inner = sorted({*inner, *often, *(x + 1 for x in often if x < LONG)})
    each = docs.select(ids.alias("id"), text_of(text).alias("t"))
    each = each.withColumn("h", F.xxhash64("t"))
    part = F.size(F.filter(F.array(*map(F.lit, inner)), lambda c: c <= F.col("id"))) if inner else F.lit(0)
    each = each.withColumn("part", part)
    heavy = F.col("id").isNull() if rows > known else F.lit(False)
    if often:
        heavy = heavy | F.col("id").isin(often)
    if fine > 1:
        edges = [points[0], *inner, max(points[-1], points[0]) + 1]
        low, high = (F.get(F.array(*map(F.lit, e)), F.col("part")).cast("double") for e in (edges[:-1], edges[1:]))
        step = F.floor((F.col("id") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
        part = F.col("part") * fine + F.least(F.greatest(step, F.lit(0)), F.lit(fine - 1))
    else:
        part = F.col("part")
    # Of a frequent id the slice with the smallest hashes comes first, so it is the highest.
    slices = min(SLICES, n)
    slice_ = F.floor((F.col("h").cast("double") + 2.0**63) / 2.0**64 * slices).cast("long")
    turn = F.when(heavy, slices - 1 - F.least(F.greatest(slice_, F.lit(0)), F.lit(slices - 1))).otherwise(0)
    bucket = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(part).cast("long") * slices + turn
    each = each.select("id", "t", "h", bucket.alias("bucket"), heavy.alias("heavy"))
    single = each.filter(~F.col("heavy")).withColumn("copies", F.lit(1).cast("long")).drop("heavy")
    if not often and rows == known:
        return single
    equal = each.filter("heavy").groupBy("id", "t", "h", "bucket").agg(F.count("*").alias("copies"))
    return single.unionByName(equal)


def next_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BUCKET) -> tuple[DataFrame, W]:
    """id, t, next_t and copies of every row, and copies of the buckets' first rows (``guest``).

    Of several ``copies`` of a row next_t belongs to the last; the others are followed
    by their own text. The window goes with it: other values of the next row are read
    through it without another shuffle.
    """
    rows = _bucketed(docs, key, text, size)
    place = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not(F.col("id")).alias("down"), F.col("h").alias("h"))
    first = rows.groupBy("bucket").agg(F.min(place).alias("first"))
    everywhere = W.orderBy("bucket")  # one row per bucket
    host = F.coalesce(F.lead("bucket").over(everywhere), F.min("bucket").over(W.partitionBy()))
    hosts = first.select("bucket", "first", host.alias("host"))
    # A few numbers for each bucket, of which BUCKETS and SLICES bound the number.
    known = rows.join(F.broadcast(hosts), "bucket")
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("guest"))
    also = F.struct(F.col("host").alias("b"), F.lit(True).alias("guest"))
    is_first = place.eqNullSafe(F.col("first"))
    dealt = known.withColumn("to", F.explode(F.when(is_first, F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("to.b").alias("bucket"), F.col("to.guest").alias("guest"), "id", "t", "h", "copies")
    order = W.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "h")
    return dealt.withColumn("next_t", F.lead("t").over(order)), order


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BUCKET) -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced, and how alike they are.

    The edited text ends with the first floor(n_chars / 3) characters of the next
    document. Columns: key, n_chars, edited, prints and edited_prints (arrays),
    near_edited, near_next.
    """
    rows, order = next_documents(docs, key, text, size)
    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    rows = winnow(rows.withColumn("n_chars", n.cast("long")), "t", "prints")
    rows = rows.withColumn("next_prints", F.lead("prints").over(order)).filter("not guest")
    # The last copy of a row is followed by the next one, the others by themselves.
    last = F.struct(F.lit(1).cast("long").alias("copies"), F.col("next_t").alias("t"), F.col("next_prints").alias("prints"))
    others = F.struct((F.col("copies") - 1).alias("copies"), F.col("t").alias("t"), F.col("prints").alias("prints"))
    rows = rows.withColumn("after", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    edited = F.concat(F.substring("t", F.lit(1), n - third), F.substring(F.col("after.t"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("next_prints", F.col("after.prints"))
    rows = winnow(rows.drop("t", "next_t"), "edited", "edited_prints")
    rows = likeness(rows, "prints", "edited_prints", "near_edited")
    rows = likeness(rows, "prints", "next_prints", "near_next")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("after.copies"))))
    return rows.select(F.col("id").alias(key), "n_chars", "edited", "prints", "edited_prints", "near_edited", "near_next")
