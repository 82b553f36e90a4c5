"""11. Spelling variants: words that differ by one inserted, deleted or replaced character.

A word is a vector of letter counts. One edit changes it by a squared distance of 1
(inserted or deleted) or 2 (replaced); equal vectors are never one edit apart. Squared
distances of all pairs of two blocks of words come from the blocks' Gram matrix, one
NumPy product, and only pairs of distance 1 or 2 are looked at letter by letter.

A block holds words with the same number of letters of each of k classes, which fixes
their length: an edit moves at most one letter between classes or adds one, so a block
has to meet itself and only the blocks of k * (k - 1) / 2 such moves and k additions. k
follows the number of words, so blocks stay small. A block that is still large is dealt
into tiles, and every two tiles meet in a group of their own. Some hundred small groups
go to Python at once, because one call costs more than one group. Nothing is capped.

A word has few neighbours, at most its length times the alphabet, so no group of
neighbours is large either. The form of a word is so much more frequent than the word
that chains of forms are short; they are followed by doubling.

Cases: null texts have no words; a null id is written as nothing in the hash that
decides on deletions; repeated rows count as often as they are there; no words, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

#: Letters of a word, as a class of a pattern; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, FEWEST, EVERY, TIMES = 7, 2, 31, 10
#: About so many words share the classes; about so many at most are one tile.
BLOCK, TILE = 1024, 4096
#: So many words have their groups in one call.
CALL = 2048
#: Cells of one Gram matrix, pairs and letters that are compared at once.
CELLS, PAIRS, COMPARED = 1 << 18, 1 << 20, 1 << 20
#: Bits that hold the digits of all classes.
BITS = 60


def lowered(word: Column) -> Column:
    """Only A-Z in lower case; without other letters than ASCII that is ``lower``."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, upper, "".join(map(chr, range(97, 123))))
    )


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """(word, n) of all words long and frequent enough, some with a letter deleted."""
    runs = F.regexp_extract_all(text_of(text), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    each = each.select("key", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    counted = each.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= FEWEST) & (F.length("word") >= SHORTEST))


def sorted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that is never a broadcast: these tables grow with the words, and Spark takes them for
    small after an explode, a Python step or compressed files."""
    return left.join(right.hint("merge"), on, how)


def classes_for(words: int) -> int:
    """Classes of letters that leave about BLOCK words to a block.

    Words of one length of some ten letters fall into some 2 ** (k + 1) blocks that are
    well filled.
    """
    return int(min(24, max(2, math.ceil(math.log2(max(words, 1) / BLOCK) - 1))))


def blocks(words: DataFrame, k: int) -> DataFrame:
    """(word, n, own): the block is, for each class, its number of letters, one digit of a long.

    Digits go round at 2 ** (BITS // k), 4 at least. Blocks that thereby become one are met by
    the same moves, so no pair is lost or met twice.
    """
    bits = BITS // k

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = Letters(batch.column("word").to_pylist(), classes=k)
            digits = both.counts.astype(np.int64) & ((1 << bits) - 1)
            own = (digits << (bits * np.arange(k, dtype=np.int64))).sum(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["word", "n", "own"])

    return words.select("word", "n").mapInArrow(place, "word string, n long, own long")


def meetings(placed: DataFrame, k: int) -> DataFrame:
    """(own, tile, turn, guest, word, n): who meets in the group (own, tile, turn).

    Two blocks a move apart meet in the one of more words, so that few words travel. A
    group has one tile of its block and the guests of one tile number; only blocks that
    there are get guests.
    """
    sizes = placed.groupBy("own").agg(F.count("*").alias("words"))
    sizes = stored(sizes.withColumn("tiles", F.ceil(F.col("words") / TILE).cast("int")), "block-sizes")
    bits, own = BITS // k, F.col("own")
    one, mask = [1 << (bits * c) for c in range(k)], [((1 << bits) - 1) << (bits * c) for c in range(k)]
    # A digit more of class i and, where there is one, a digit less of class j.
    more = lambda i: (own + F.lit(one[i])).bitwiseAND(F.lit(mask[i]))
    less = lambda j: (own - F.lit(one[j])).bitwiseAND(F.lit(mask[j]))
    rest = lambda *at: own.bitwiseAND(F.lit(~sum(mask[c] for c in at)))
    moved = [rest(i, j).bitwiseOR(more(i)).bitwiseOR(less(j)) for i in range(k) for j in range(i + 1, k)]
    moved += [rest(i).bitwiseOR(more(i)) for i in range(k)]
    block = F.struct("words", "own", "tiles")
    met = sizes.select(block.alias("one"), F.explode(F.array(*moved)).alias("to"))
    met = sorted_join(met, sizes.select(F.col("own").alias("to"), block.alias("two")), "to")
    met = met.select(F.least("one", "two").alias("guest"), F.greatest("one", "two").alias("host"))
    ways = stored(met.select("guest.own", "guest.tiles", F.col("host.own").alias("to"), F.col("host.tiles").alias("to_tiles")), "block-moves")
    # At most one row per move or its reverse and block is collected.
    visits = ways.groupBy("own").agg(F.collect_list(F.struct("to", "to_tiles")).alias("visits"))
    turns = ways.groupBy(F.col("to").alias("own")).agg(F.max("tiles").alias("guest_tiles"))
    plan = sorted_join(sorted_join(sizes, visits, "own", "left"), turns, "own", "left")
    plan = plan.withColumn("turns", F.greatest("tiles", F.coalesce("guest_tiles", F.lit(1)))).drop("guest_tiles")
    rows = sorted_join(placed, plan, "own").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda own, tile, turn, guest: F.struct(
        own.alias("own"), tile.alias("tile"), turn.alias("turn"), F.lit(guest).alias("guest")
    )
    home = F.transform(upto(F.col("turns")), lambda t: place(F.col("own"), F.col("tile"), t, False))
    beside = F.transform(F.filter(upto(F.col("tiles")), lambda t: t < F.col("tile")), lambda t: place(F.col("own"), t, F.col("tile"), True))
    abroad = F.flatten(F.transform(
        F.coalesce("visits", F.array().cast("array<struct<to:bigint,to_tiles:int>>")),
        lambda v: F.transform(upto(v["to_tiles"]), lambda t: place(v["to"], t, F.col("tile"), True)),
    ))
    return rows.select("word", "n", F.explode(F.concat(home, beside, abroad)).alias("place")).select("place.*", "word", "n")


class Letters:
    """Words as code points and as counts of letters, or of letters by their class."""

    def __init__(self, words: list[str], classes: int = 0):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.cumsum(self.size) - self.size
        if classes:
            # Code points modulo k spread the letters.
            letter, m = self.flat.astype(np.int64) % classes, classes
        else:
            there = np.zeros(int(self.flat.max(initial=0)) + 1, bool)
            there[self.flat] = True
            letter, m = (np.cumsum(there) - 1)[self.flat], int(there.sum())
        cell = np.repeat(np.arange(len(words)) * m, self.size) + letter
        self.counts = np.bincount(cell, minlength=len(words) * m).reshape(len(words), m)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose products are the squared distances less 1.5."""
        norm = (self.counts**2).sum(1)
        # Products have to be exact.
        kind = np.float32 if norm.max(initial=0) < 1 << 22 else np.float64
        counts, norm, ones = self.counts.astype(kind), norm.astype(kind)[:, None], np.ones((len(norm), 1), kind)
        return np.hstack([-2 * counts, norm - kind(1.5), ones]), np.hstack([counts, ones, norm])

    def _cut(self, i: np.ndarray, length: int) -> np.ndarray:
        return self.flat[self.start[i][:, None] + np.arange(length)]

    def one_edit(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i are one edit from words j."""
        out = np.zeros(len(i), bool)
        i, j = np.where(self.size[i] < self.size[j], (j, i), (i, j))
        length, less = self.size[i], self.size[i] - self.size[j]
        order = np.lexsort((less, length))
        change = (np.diff(length[order]) != 0) | (np.diff(less[order]) != 0)
        for which in np.split(order, np.flatnonzero(change) + 1):
            if not len(which) or less[which[0]] > 1:
                continue
            n, shorter = int(length[which[0]]), int(less[which[0]])
            step = max(1, COMPARED // max(n, 1))
            for at in range(0, len(which), step):
                some = which[at : at + step]
                a, b = self._cut(i[some], n), self._cut(j[some], n - shorter)
                if not shorter:
                    out[some] = (a != b).sum(1) == 1
                    continue
                # Equal up to a letter, and behind it when it is left out.
                edge = np.ones((len(some), 1), bool)
                head = np.hstack([edge, np.logical_and.accumulate(a[:, :-1] == b, 1)])
                tail = np.hstack([np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], 1)[:, ::-1], edge])
                out[some] = (head & tail).any(1)
        return out


def near_pairs(words: list[str], groups: Iterable[tuple[int, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the near pairs of every group (start, guests, end, inside): of own words, before
    ``guests``, with guests and, where ``inside``, with each other."""
    both = Letters(words)
    left, right = both.sides()
    found, waiting, many = [], [], 0

    def settle() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        near = both.one_edit(i, j)
        found.append((i[near], j[near]))
        waiting.clear()

    for start, guests, end, inside in groups:
        first = start if inside else guests
        step = max(1, CELLS // max(end - first, 1))
        for a in range(start, guests, step):
            off = left[a : min(a + step, guests)] @ right[first:end].T
            i, j = np.nonzero(np.abs(off, out=off) < 1)
            i, j = i + a, j + first
            later = j > i
            waiting.append((i[later], j[later]))
            many += len(i)
            if many > PAIRS:
                settle()
                many = 0
    if waiting:
        settle()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


NEAR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every word (word, n) with every word one edit away."""
    count = words.count()
    k, calls = classes_for(count), count // CALL + 1

    def compare(group: pa.Table) -> pa.Table:
        keys = [group.column(c).to_numpy() for c in ("guest", "turn", "tile", "own")]
        order = np.lexsort(keys)
        guest, *keys = (x[order] for x in keys)
        change = np.flatnonzero(np.logical_or.reduce([np.diff(x) != 0 for x in keys])) + 1
        start, end = np.append(0, change), np.append(change, len(order))
        guests = end - np.add.reduceat(guest.astype(np.int64), start)
        groups = zip(start.tolist(), guests.tolist(), end.tolist(), (keys[0][start] == 0).tolist())
        names, n = group.column("word").combine_chunks().take(pa.array(order)), group.column("n").to_numpy()[order]
        i, j = near_pairs(names.to_pylist(), groups)
        left, right = np.concatenate([i, j]), np.concatenate([j, i])
        return pa.table([names.take(pa.array(left)), names.take(pa.array(right)), pa.array(n[right], pa.int64())], schema=NEAR)

    met = meetings(blocks(words, k), k)
    met = met.withColumn("call", F.pmod(F.xxhash64("own", "tile", "turn"), F.lit(calls)))
    return met.groupBy("call").applyInArrow(compare, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends; every round doubles the step."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(sorted_join(at, ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        at = moved.select("word", "root")
        if not moved.filter("on").head(1):
            return at


def variant_groups(words: DataFrame, times: float = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of (word, n)."""
    words = stored(words, "words")
    best = neighbours(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    with_best = sorted_join(words, best, "word", "left")
    taken = -F.col("best.less") >= F.col("n") * times
    found = stored(
        with_best.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.filter("form is not null"))
    return sorted_join(found, ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The variant groups of the words of whole texts."""
    return variant_groups(word_counts(docs, key, text))
