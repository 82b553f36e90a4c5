"""7. Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = count * idf, with
idf = ln(1 + N / df) over the N different texts. All shingles are counted: blocks of
texts send their shingles to ranges of hashes, and a range sends back the number of
every shingle that other blocks hold as well, so a block knows the weights of its texts
without a table of all shingles anywhere.

Every text gets BANDS * ROWS consistent weighted samples, with the random draws
of a shingle taken from fixed tables. Documents that agree in all samples of a band
are candidates, and the weighted Jaccard similarity of their whole shingle sets
decides. Equal word sequences are one text from the start.

Inside a band's group all pairs are never emitted: first each text meets two leaders
of the group; texts that are by then in one class need no more comparison, and the
rest of a group is compared inside a task, tile by tile where it is large, with only
the links that join classes as output. So no link that changes a class is lost among
the candidates. Classes are the connected
components of the links, found by contraction of the link table.

Cases: ids are numbers, or cast to them; null texts count as empty; texts of fewer than five words are one shingle;
all texts without words are one class; a null id is larger than any; every row
gives a row, rows that repeat an id too; a class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import small_batches, stored, text_of, whole, words
from .ranges import dealt_again

WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 10, 3
#: Words of one block, and bits of a shingle's hash.
BLOCK, BITS = 1 << 19, 44
#: Bytes of shingle sets of one tile.
TILE = 16 << 20
NO_ID = np.iinfo(np.int64).max
LOW = np.uint64((1 << BITS) - 1)


def shingles(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of a block, sorted; short texts are one shingle."""
    at = packed.inside(sizes, WIDTH)
    hashes = [packed.rolling(flat, WIDTH)[at]] if len(at) else []
    ends = np.cumsum(sizes)
    docs = [np.searchsorted(ends, at, "right")]
    for n in range(1, WIDTH):
        few = np.flatnonzero(sizes == n)
        if len(few):
            hashes.append(packed.rolling(flat, n)[(ends - sizes)[few]])
            docs.append(few)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    both = np.concatenate(docs).astype(np.uint64) << np.uint64(BITS) | np.concatenate(hashes) >> np.uint64(64 - BITS)
    both.sort()
    first = packed.runs(both)
    count = np.diff([*first, len(both)])
    both = both[first]
    return (both >> np.uint64(BITS)).astype(np.int64), both & LOW, count


class Sampler:
    """Fixed draws, and the samples of weighted sets."""

    def __init__(self, size: int = BANDS * ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 1 << 16
        self.odd = rng.integers(1 << 62, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, n).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)

    def samples(self, shingle: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row per set (of at least one element): the chosen (element, step), hashed."""
        ln_w = np.log(weight).astype(np.float32)
        begin = np.cumsum(sizes) - sizes
        out = np.empty((len(sizes), len(self.odd)), np.uint64)
        for k, odd in enumerate(self.odd):
            pick = ((shingle + np.uint64(k)) * odd >> np.uint64(48)).astype(np.int32)
            r = self.r[pick]
            step = np.floor(ln_w / r + self.beta[pick])
            ln_a = self.ln_c[pick] - r * (step - self.beta[pick] + 1)
            least = np.minimum.reduceat(ln_a, begin)
            hit = np.flatnonzero(ln_a == np.repeat(least, sizes))
            chosen = hit[np.searchsorted(hit, begin)]
            out[:, k] = (shingle[chosen] ^ (step[chosen].astype(np.int64).astype(np.uint64) << np.uint64(48))) * odd
        return out


def texts_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, key) of every row, and (key, first, t) of every different text.

    Equal words in equal order are one text; t has one space between words, and first
    is its smallest (id, row).
    """
    body = text_of(text)
    one = F.array_join(words(body), " ")
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id")
    rows = docs.select(ids, F.xxhash64(body).alias("row"), one.alias("t"))
    rows = rows.select("id", "row", F.unhex(F.md5(F.col("t").cast("binary"))).alias("key"), "t")
    texts = rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.first("t").alias("t"))
    return rows.drop("t"), texts


#: A text of a block: its number, key, first row, and how many shingles it has.
TEXT = np.dtype([("rep", "<i8"), ("key", "S16"), ("id", "<i8"), ("row", "<i8"), ("shingles", "<u4")])
#: Bits of a number for the texts of a block, and for the blocks of a task.
TEXT_BITS, TURN_BITS = 20, 20


def pack_block(block: int, keys, ids, rows, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Texts of a block and their shingles: hashes in six bytes, counts where they aren't 1."""
    doc, h, tf = shingles(sizes, flat)
    texts = np.empty(len(sizes), TEXT)
    texts["rep"] = (block << TEXT_BITS) + np.arange(len(sizes))
    texts["key"], texts["id"], texts["row"] = keys, ids, rows
    texts["shingles"] = np.bincount(doc, minlength=len(sizes))
    often = np.flatnonzero(tf > 1)
    head = np.array([len(texts), len(h), len(often)], np.int64)
    low = h.view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join(x.tobytes() for x in (head, texts, often.astype(np.uint32), tf[often].astype(np.uint32), low))


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """texts, shingles (sorted inside a text) and their counts."""
    n, size, often = np.frombuffer(data, np.int64, 3).tolist()
    place = 24
    texts = np.frombuffer(data, TEXT, n, place)
    place += n * TEXT.itemsize
    at = np.frombuffer(data, np.uint32, often, place)
    place += 4 * often
    tf = np.ones(size, np.int64)
    tf[at] = np.frombuffer(data, np.uint32, often, place)
    place += 4 * often
    return texts, packed.wide(data, place, size, 6), tf


def _blocks(texts: DataFrame) -> DataFrame:
    """(block, data): the different texts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TURN_BITS
        held: list[tuple] = []

        def block():
            keys, ids, rows, sizes, flat = (np.concatenate(x) for x in zip(*held))
            data = pack_block(number, keys, ids, rows, sizes, flat)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

        for b in batches:
            # A block has fewer texts than the bits beside a shingle's hash can tell apart.
            for start in range(0, b.num_rows, 1 << 16):
                some = b.slice(start, 1 << 16)
                lists = some.column("w")
                keys = np.array(some.column("key").to_pylist(), "S16")
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                flat = lists.flatten().to_numpy().view(np.uint64)
                held.append((keys, some.column("id").to_numpy(), some.column("row").to_numpy(), sizes, flat))
                if sum(len(x[-1]) for x in held) >= BLOCK or sum(len(x[0]) for x in held) > 1 << 17:
                    yield block()
                    held.clear()
                    number += 1
        if held:
            yield block()

    hashed = texts.select("key", "first.id", "first.row", F.transform(words(F.col("t")), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.mapInArrow(run, "block long, data binary")


def _spread(h: np.ndarray) -> np.ndarray:
    """Shingles as hashes of 64 bits, in the same order."""
    return h << np.uint64(64 - BITS)


def shared_counts(blocks: DataFrame, entries: float) -> DataFrame:
    """(block, counts): the shingles of a block that others have too, by their place among the
    block's different shingles, with the number of texts that have them."""
    bits = packed.range_bits(entries)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                own, times = np.unique(unpack_block(data.as_py())[1], return_counts=True)
                at = np.arange(len(own), dtype=np.uint32)
                found = list(packed.deal(block, packed.NOBODY, _spread(own), times, at, 0, packed.FIRST))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.int64()), pa.array([block] * len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())],
                    ["range", "block", "data"],
                )

    sent = blocks.mapInArrow(send, "range long, block long, data binary")
    if bits > packed.FIRST:
        sent = dealt_again(sent, bits, entries)

    def total(group: pa.Table) -> pa.Table:
        found = counted(x.as_py() for x in group.column("data"))
        return pa.table({"block": pa.array([b for b, _ in found], pa.int64()), "data": pa.array([d for _, d in found], pa.binary())})

    back = sent.select("range", "data").groupBy("range").applyInArrow(total, "block long, data binary")
    # At most a row per range and block, of as many entries as the block has.
    return back.groupBy("block").agg(F.collect_list("data").alias("counts"))


def counted(rows) -> list[tuple[int, bytes]]:
    """(block, places and sums) of the hashes of one range that several blocks hold."""
    parts = [s for data in rows for s in packed.segments(data)]
    if not parts:
        return []
    h = np.concatenate([p[2] for p in parts])
    times = np.concatenate([p[3] for p in parts]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    first = packed.runs(h[order])
    repeats = np.diff([*first, len(h)])
    sums = np.empty(len(h), np.int64)
    sums[order] = np.repeat(np.add.reduceat(times[order], first), repeats)
    several = np.empty(len(h), bool)
    several[order] = np.repeat(repeats > 1, repeats)
    out, end = [], 0
    for block, _, _, _, at in parts:
        mine = slice(end, end + len(at))
        end += len(at)
        if several[mine].any():
            out.append((block, pack_counts(at[several[mine]], sums[mine][several[mine]])))
    return out


def pack_counts(at: np.ndarray, sums: np.ndarray) -> bytes:
    """Rising places by their steps, and sums."""
    step, steps = packed.narrow(np.diff(at))
    size, numbers = packed.narrow(sums)
    return np.array([len(at), at[0], step, size], np.uint32).tobytes() + steps + numbers


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first, step, size = np.frombuffer(data, np.uint32, 4).tolist()
    steps = packed.wide(data, 16, n - 1, step)
    at = np.cumsum(np.concatenate([np.array([first], np.uint64), steps]), dtype=np.uint64).astype(np.int64)
    return at, packed.wide(data, 16 + (n - 1) * step, n, size).astype(np.int64)


def weights(h: np.ndarray, tf: np.ndarray, counts: list[bytes], n_texts: int) -> np.ndarray:
    """Count * ln(1 + N / df) of the shingles of a block."""
    _, which, df = np.unique(h, return_inverse=True, return_counts=True)
    df = df.astype(np.int64)
    for data in counts or []:
        at, sums = unpack_counts(data)
        df[at] = sums
    return tf * np.log1p(n_texts / df)[which]


def similarity(h1, w1, h2, w2) -> float:
    """Weighted Jaccard similarity of two sets with sorted elements."""
    if len(h1) > len(h2):
        h1, w1, h2, w2 = h2, w2, h1, w1
    if not len(h1):
        return 1.0 if not len(h2) else 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    same = h2[at] == h1
    common = np.minimum(w1[same], w2[at[same]]).sum()
    return float(common / (w1.sum() + w2.sum() - common))


def _signatures(blocks: DataFrame, n_texts: int, bands: int, rows: int) -> DataFrame:
    """rep, key, id, row and band hashes of every text of (data, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows)
        for b in batches:
            for data, counts in zip(b.column("data"), b.column("counts").to_pylist()):
                texts, h, tf = unpack_block(data.as_py())
                per = texts["shingles"].astype(np.int64)
                some = per > 0
                band = np.zeros((len(texts), bands), np.uint64)
                if some.any():
                    picked = sampler.samples(h, weights(h, tf, counts, n_texts), per[some]).reshape(-1, bands, rows)
                    mixed = np.zeros(picked.shape[:2], np.uint64)
                    for j in range(rows):
                        mixed = (mixed ^ picked[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(29)
                    band[some] = mixed + np.arange(bands, dtype=np.uint64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                # As raw bytes: text of fixed size loses zeros at its end.
                keys = [x.tobytes() for x in np.ascontiguousarray(texts["key"]).view("V16")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(texts["rep"])), pa.array(keys, pa.binary()), pa.array(np.ascontiguousarray(texts["id"])), pa.array(np.ascontiguousarray(texts["row"])), lists],
                    ["rep", "key", "id", "row", "bands"],
                )

    return blocks.mapInArrow(run, "rep long, key binary, id long, row long, bands array<long>")


def _sets(blocks: DataFrame, n_texts: int) -> DataFrame:
    """rep with its shingles and weights as bytes, of (data, counts, wanted reps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, counts, wanted in zip(b.column("data"), b.column("counts").to_pylist(), b.column("wanted").to_pylist()):
                texts, h, tf = unpack_block(data.as_py())
                w = weights(h, tf, counts, n_texts).astype(np.float32)
                ends = np.cumsum(texts["shingles"].astype(np.int64))
                places = [x & ((1 << TEXT_BITS) - 1) for x in wanted]
                cuts = [slice(ends[k] - int(texts["shingles"][k]), ends[k]) for k in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted, pa.int64()), pa.array([h[c].tobytes() for c in cuts], pa.binary()), pa.array([w[c].tobytes() for c in cuts], pa.binary())],
                    ["rep", "h", "w"],
                )

    return blocks.mapInArrow(run, "rep long, h binary, w binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in ("h", "w", "h2", "w2")]
            found = []
            for h, w, h2, w2 in zip(*columns):
                found.append(similarity(
                    np.frombuffer(h.as_py(), np.uint64), np.frombuffer(w.as_py(), np.float32),
                    np.frombuffer(h2.as_py(), np.uint64), np.frombuffer(w2.as_py(), np.float32),
                ))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    both = pairs.join(sets.withColumnRenamed("rep", "a"), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("h").alias("h2"), F.col("w").alias("w2")), "b"
    )
    return both.mapInArrow(run, "a long, b long, similarity double").filter(F.col("similarity") >= least)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b): the smallest node it reaches.

    In every round each node moves to the neighbour (or stays) that comes first in an
    order of that round's own hash, and the links are rewritten; links within one node
    vanish, until none is left. As no order of the nodes lasts, chains fall together
    in few rounds, however they are numbered.
    """
    edges, moves = stored(links.select("a", "b").filter("a <> b").distinct(), "links"), []
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("best"))
        moves.append(stored(best.select("node", F.least("best", place("node"))["to"].alias("to")), "nearest"))
        left, right = (moves[-1].select(F.col("node").alias(k), F.col("to").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        edges = stored(
            edges.join(left, "a").join(right, "b").filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    nodes = moves[0].select("node", F.col("to").alias("comp"))
    for step in moves[1:]:
        nodes = nodes.join(step.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    nodes = stored(nodes, "components")
    smallest = nodes.groupBy("comp").agg(F.min("node").alias("least"))
    return stored(nodes.join(smallest, "comp").select("node", F.col("least").alias("comp")), "components")


def _leaders(members: DataFrame) -> DataFrame:
    """(bucket, leader): the first text of each bucket in two hash orders."""
    first = [F.min_by("rep", F.xxhash64("rep", "bucket", F.lit(k))) for k in range(2)]
    return members.groupBy("bucket").agg(F.array_distinct(F.array(*first)).alias("l")).select("bucket", F.explode("l").alias("leader"))


def _rest(members: DataFrame, leaders: DataFrame, comps: DataFrame) -> DataFrame:
    """What is left to compare: (bucket, rep, comp) without leaders, of buckets with several classes."""
    left = members.join(leaders.withColumnRenamed("leader", "rep"), ["bucket", "rep"], "left_anti")
    now = left.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return now.join(several.select("bucket"), "bucket")


def links_between(reps, comps, hs, ws, least: float, first: np.ndarray, second: np.ndarray) -> list[tuple[int, int, float]]:
    """Links that join the classes ``comps`` of these texts.

    Each text of ``first`` is compared with all of ``second`` outside its class, as it
    is by then; so no class stays apart from another that it has a link with.
    """
    sizes = np.array([len(h) for h in hs])
    _, code = np.unique(np.concatenate(hs), return_inverse=True)
    weight = np.concatenate(ws)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(hs)), sizes)
    total = np.bincount(doc, weight, len(hs))
    comps, lookup, found = comps.copy(), np.zeros(code.max(initial=-1) + 1), []
    on_right = np.zeros(len(hs), bool)
    on_right[second] = True
    for i in first:
        own = slice(ends[i] - sizes[i], ends[i])
        # Of sets so unlike in weight none is similar enough.
        other = on_right & (comps != comps[i]) & (np.minimum(total, total[i]) >= least * np.maximum(total, total[i]))
        if not other.any():
            continue
        lookup[code[own]] = weight[own]
        at = other[doc]
        common = np.bincount(doc[at], np.minimum(lookup[code[at]], weight[at]), len(hs))
        lookup[code[own]] = 0
        like = common / np.maximum(total + total[i] - common, 1e-12)
        for j in np.flatnonzero(other & (like >= least)):
            if comps[j] != comps[i]:
                found.append((int(reps[i]), int(reps[j]), float(like[j])))
                comps[comps == comps[j]] = comps[i]
    return found


def _remaining_links(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b, similarity) that join classes inside the buckets of ``rest``.

    A bucket whose sets have more than TILE bytes is dealt into tiles by hash, and
    every two tiles meet in a task of their own.
    """
    rows = rest.join(sets, "rep")
    tiles = rows.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("h") + F.octet_length("w")) / F.lit(TILE)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("rep"), F.greatest("tiles", F.lit(1))).cast("int")
    dealt = rows.join(tiles, "bucket").withColumn("tile", tile)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("tiles"), F.lit(1)) - 1)))
    dealt = dealt.select(
        "bucket", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "rep", "comp", "h", "w"
    )

    def compare(group: pa.Table) -> pa.Table:
        tile = group.column("tile").to_numpy()
        hs = [np.frombuffer(h.as_py(), np.uint64) for h in group.column("h")]
        ws = [np.frombuffer(w.as_py(), np.float32) for w in group.column("w")]
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        found = links_between(
            group.column("rep").to_numpy(), group.column("comp").to_numpy(), hs, ws, least, np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        )
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "b", "similarity"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long, similarity double")


def near_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """id (key, NO_ID for null), row (hash of the text), class_id and class_size of every row, stored."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed, texts = texts_of(docs, key, text)
    rows_ = stored(keyed, "rows")
    blocks = stored(_blocks(texts), "blocks")
    # The octets of the packed shingles, six each.
    entries = (blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0) / 6
    counts = stored(shared_counts(blocks, entries), "counts")
    n_texts = rows_.agg(F.countDistinct("key")).first()[0]
    known = blocks.join(counts, "block", "left")
    reps = stored(_signatures(known.select("data", "counts"), n_texts, bands, rows), "texts")

    banded = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").count().filter("count > 1").select("bucket")
    members = stored(banded.join(shared, "bucket"), "candidates")
    # At most as many as a block has texts.
    wanted = members.select("rep").distinct().groupBy(F.shiftright("rep", TEXT_BITS).alias("block")).agg(F.collect_list("rep").alias("wanted"))
    sets = stored(_sets(known.join(wanted, "block").select("data", "counts", "wanted"), n_texts), "shingle-sets")

    leaders = stored(_leaders(members), "leaders")
    pairs = members.join(leaders, "bucket").filter("rep <> leader")
    pairs = pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
    links = stored(_verified(pairs, sets, similar), "verified")
    comps = components(links)
    more = stored(_remaining_links(_rest(members, leaders, comps), sets, similar), "remaining")
    if more.head(1):
        comps = components(links.unionByName(more))

    rep_class = reps.select("key", "rep", "id").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    rep_class = rep_class.select("key", F.coalesce("comp", "rep").alias("comp"))
    found = rows_.join(rep_class, "key")
    classes = found.groupBy("comp").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("id", "row")).alias("keeper"))
    return stored(
        found.join(classes, "comp").select(
            "id", "row", "class_id", "class_size", (F.struct("id", "row") == F.col("keeper")).alias("kept")
        ),
        "near-classes",
    )


def _known(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, class_size and kept (the class's first) of every row."""
    found = near_classes(docs, key, text)
    return found.select(_known("id").alias(key), _known("class_id").alias("class_id"), "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, all columns as they were."""
    kept = near_classes(docs, key, text).filter("kept").select("id", "row").distinct()
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    tagged = docs.select(whole(docs), ids.alias("id"), F.xxhash64(text_of(text)).alias("row"))
    return tagged.join(kept, ["id", "row"]).dropDuplicates(["id", "row"]).select("__doc.*")
