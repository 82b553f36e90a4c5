"""1. Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can stand last
in the encoding of that prefix. The table of these tokens is built from left to
right: a token ending here is the right one when it may follow the token stored
where it begins. The encoding is read off backwards from the end. A table can be
extended at its end without touching what is there, and after an edit only the
entries near the edit change.

Two tokens may be neighbours when, undoing their merges from the last to the
first, no merge across their border would have come before the merges that built
them. Answers are kept, since few pairs occur often.

Cases: a null text counts as empty and gives no ids; bytes without a merge give
their single-byte tokens; a vocabulary token that merges cannot reach is used only
where it is a whole piece, as in the reference libraries of such rank files.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, small_batches

#: Bytes that one Python worker spends on words, on pieces of other texts, and on token pairs.
WORD_BYTES, PIECE_BYTES, PAIR_BYTES = 144 << 20, 32 << 20, 64 << 20

#: Fixed value: the pattern whose matches begin at every space that has other characters beside it.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space behind white space and before white space or the end.
OPEN_SPACE = re.compile(r" (?=\s|\Z)(?<=\s )").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with, for every token, the two tokens whose merge made it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # Ids of the two halves, -1 where no merge makes the token.
        self.left, self.right = (array("i", [-1]) * (max(self.token) + 1) for _ in range(2))
        self.merged: dict[int, int] = {}
        self.reachable = array("i")
        for i, b in sorted(self.token.items()):
            if len(b) > 1:
                halves = self._halves(b, i)
                if halves is None:
                    continue
                self.left[i], self.right[i] = halves
                self.merged[halves[0] << 32 | halves[1]] = i
            self.reachable.append(i)
        self._forget()

    def _forget(self) -> None:
        self.fits = Memory(self._neighbours, PAIR_BYTES)
        self.words = Memory(lambda w: b"".join(map(self._piece, self.split_text(w))), WORD_BYTES)
        self.pieces = Memory(self._piece, PIECE_BYTES)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("ranks", "pattern", "token", "longest", "left", "right", "merged", "reachable")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    @cached_property
    def matches(self):
        """Finds the reachable tokens that end at each place, the longest first."""
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in self.reachable:
            found.add_word(self.token[i].decode("latin-1"), i)
        found.make_automaton()
        return found

    @cached_property
    def split_text(self):
        import regex

        return regex.compile(self.pattern).findall

    def _halves(self, b: bytes, rank: int) -> tuple[int, int] | None:
        """The two parts that stand before the last merge."""
        part = [b[i : i + 1] for i in range(len(b))]
        while len(part) > 2:
            options = [(self.ranks.get(x + y, rank), k) for k, (x, y) in enumerate(zip(part, part[1:]))]
            best, k = min(options)
            if best >= rank:
                return None
            part[k : k + 2] = [part[k] + part[k + 1]]
        return self.ranks[part[0]], self.ranks[part[1]]

    def neighbours(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a`` in an encoding?"""
        return self.fits[a << 32 | b]

    def _neighbours(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        left, right, gone = a, b, len(self.token) + len(self.merged) + 1
        left_end = right_end = gone  # when the border tokens were merged into larger ones
        while True:
            across = self.merged.get(left << 32 | right)
            # Of equal merges the left one comes first.
            if across is not None and across < left_end and across <= right_end:
                return False
            x, y = self.right[left], self.left[right]
            if x >= 0 and (y < 0 or left > right):
                left, left_end = x, left
            elif y >= 0:
                right, right_end = y, right
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(PrefixTable(self, raw).ids())

    def _piece(self, piece: str) -> bytes:
        return array("i", self.encode_piece(piece)).tobytes()

    @cached_property
    def sizes(self) -> array:
        """Bytes of each token."""
        out = array("i", [0]) * len(self.left)
        for i, b in self.token.items():
            out[i] = len(b)
        return out

    def encode(self, text: str) -> array:
        """The ids of a text, each match of the pattern encoded for itself.

        With the pattern SPACED words are looked up whole, as a match begins at every
        space; texts with other spaces, and other patterns, are split by the pattern.
        """
        if self.pattern == SPACED and OPEN_SPACE(text) is None:
            first, *rest = text.split(" ")
            get = self.words.__getitem__
            raw = get(first) + b"".join([get(" " + w) for w in rest])
        else:
            raw = b"".join(map(self.pieces.__getitem__, self.split_text(text)))
        ids = array("i")
        ids.frombytes(raw)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _fill(self, begin: int, behind: int = -1, old: list[int] = []) -> int:  # noqa: B006
        """Entries from ``begin`` on; the number computed.

        From ``behind`` on they may run into those of ``old``, counted from the end.
        """
        v, last, size = self.v, self.last, len(self.data)
        fits, sizes, moved, same = v.fits, v.sizes, size + 1 - len(old), 0
        last.extend([-1] * (size + 1 - len(last)))
        at = max(0, begin - v.longest)
        for end, token in v.matches.iter(self.data.decode("latin-1"), at):
            end += 1
            if end < begin or last[end] >= 0:
                continue
            start = end - sizes[token]
            if start == 0 or fits[last[start] << 32 | token]:
                last[end] = token
                if end > behind >= 0:
                    same = same + 1 if old[end - moved] == token else 0
                    if same >= v.longest:
                        last[end + 1 :] = old[end + 1 - moved :]
                        return end + 1 - begin
        return size + 1 - begin

    def append(self, more: bytes) -> None:
        """Entries so far stay: a longer text has the same prefixes."""
        self.data += more
        self._fill(len(self.last))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start:stop; the number of entries computed.

        Behind the edit an entry depends only on the bytes and entries within the
        longest token before it, so once that many in a row are as before, all are.
        """
        old = self.last
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        return self._fill(start + 1, start + len(new), old)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.v.token[token])
        return out[::-1]


def _added(df: DataFrame, **columns: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{k}` {v}" for k, v in columns.items())])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of a text, special tokens excluded, and, where ``decoded`` is named,
    the bytes that these ids stand for; other columns stay, those of these names are replaced.

    Both come from one pass, so that a core needs one Python worker.
    """
    added = {out: "array<int>"} | ({decoded: "binary"} if decoded else {})
    df = df.drop(*added)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ids, ends, raw = array("i"), array("i", [0]), []
            for t in batch.column(text).to_pylist():
                found = v.encode(t or "")
                ids.extend(found)
                ends.append(len(ids))
                if decoded:
                    raw.append(v.decode(found))
            flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            column = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), flat)
            more = [column, pa.array(raw, pa.binary())] if decoded else [column]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])

    return df.mapInArrow(run, _added(df, **added))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; a null list gives no bytes; a column ``out`` is replaced."""
    df = df.drop(out)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.token)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            lists = [x.values.to_numpy().tolist() if x.is_valid else () for x in batch.column(ids)]
            raw = pa.array([b"".join(map(token, x)) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], [*batch.schema.names, out])

    return df.mapInArrow(run, _added(df, **{out: "binary"}))


def token_digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return encode(text, vocabulary, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
