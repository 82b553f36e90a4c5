"""13. BPE encoding and decoding with a priority queue of merges.

A piece of text is a doubly linked list of symbols, at first its bytes. A queue holds
the merges that its neighbours allow, the lowest rank first and of equal ranks the
leftmost; a merge whose symbols have changed since it was queued is stale and is
skipped. A merge joins a symbol with the next one and queues what the new symbol allows
on both sides, so a piece of n bytes takes n log n steps. Decoding concatenates the
vocabulary's strings.

The vocabulary is read from a tokenizers file of a byte-level BPE; a file with anything
that this code does not do (normalizers, other pre-tokenizers, dropout, flags of added
tokens) is refused.

Cases: a null text counts as empty and gives no ids; the strings of added tokens inside
a text become their ids, as the library does by default; a null list of ids decodes to
an empty text; bytes that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, small_batches, text_of

#: What the byte-level pre-tokenizer takes as one piece.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of encoded pieces that one Python worker remembers.
REMEMBERED = 96 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    letter = {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letter[b] for b in range(256)]


class Merges:
    """A vocabulary with ranked merges of pairs of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
            and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and (spec.get("decoder") or {}).get("type") == "ByteLevel"
            and not spec.get("normalizer")
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids, letters = model["vocab"], byte_letters()
        self.first = [ids[c] for c in letters]
        # The rank of a pair of ids, and of a rank its pair and what it becomes.
        self.rank: dict[int, int] = {}
        self.pair, self.made = [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair.append(ids[a] << 32 | ids[b])
            self.made.append(ids[a + b])
            self.rank.setdefault(self.pair[-1], rank)
        self.added = {t["content"]: t["id"] for t in added}
        byte_of = {c: b for b, c in enumerate(letters)}
        self.token: dict[int, bytes] = {}
        for word, i in (ids | self.added).items():
            known = all(c in byte_of for c in word)
            self.token[i] = bytes(byte_of[c] for c in word) if known else word.encode()
        self._forget()

    def _forget(self) -> None:
        self.pieces = Memory(self.encode_piece, REMEMBERED)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("first", "rank", "pair", "made", "added", "token")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    @cached_property
    def _split(self):
        import regex

        return regex.compile(PIECES).findall

    @cached_property
    def _added(self):
        longest_first = sorted(self.added, key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols that stay when no merge is left."""
        n, rank, pairs, made = len(ids), self.rank, self.pair, self.made
        # An entry is a rank and the place of its left symbol, in one number.
        queue = []
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            # Stale: a symbol of the pair is gone or has grown since.
            if j >= n or ids[i] << 32 | ids[j] != pairs[r]:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = behind = after[j]
            if behind < n:
                before[behind] = i
                r = rank.get(ids[i] << 32 | ids[behind])
                if r is not None:
                    heappush(queue, r << 32 | i)
            ahead = before[i]
            if ahead >= 0:
                r = rank.get(ids[ahead] << 32 | ids[i])
                if r is not None:
                    heappush(queue, r << 32 | ahead)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit integers."""
        return array("i", self.merge([self.first[b] for b in piece.encode()])).tobytes()

    def _encode(self, text: str) -> bytes:
        get = self.pieces.__getitem__
        if self._added is None or self._added.search(text) is None:
            return b"".join(map(get, self._split(text)))
        out = []
        for part in self._added.split(text):
            if part in self.added:
                out.append(array("i", [self.added[part]]).tobytes())
            else:
                out += map(get, self._split(part))
        return b"".join(out)

    def encode(self, text: str) -> array:
        ids = array("i")
        ids.frombytes(self._encode(text))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def _columns(df: DataFrame, **added: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{k}` {v}" for k, v in added.items())])


def encode(df: DataFrame, vocabulary: Merges, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of a text as ``out`` and, where ``decoded`` is named, the text that these
    ids give; other columns stay, those of these names are replaced.

    Both come from one pass, so that a core needs one Python worker.
    """
    added = {out: "array<int>"} | ({decoded: "string"} if decoded else {})
    # The text may have the name of a new column, or another type than text.
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], text_of(f"`{text}`").alias("__text"))
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in df.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ids, ends, texts = array("i"), array("i", [0]), []
            for t in batch.column("__text").to_pylist():
                begin = len(ids)
                ids.frombytes(v._encode(t))
                ends.append(len(ids))
                if decoded:
                    texts.append(v.decode(ids[begin:]))
            flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            offsets = pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)])
            more = [pa.ListArray.from_arrays(offsets, flat), *([pa.array(texts, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *more], [*kept, *added])

    return df.mapInArrow(run, _columns(df.drop("__text"), **added))


def decode(df: DataFrame, vocabulary: Merges, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; a column ``out`` is replaced."""
    df = df.drop(out)
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [v.decode(x.values.to_pylist()) if x.is_valid else "" for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, _columns(df, **{out: "string"}))


def joined(ids: Column) -> Column:
    """Decimal ids with commas between them."""
    return F.array_join(ids.cast("array<string>"), ",")


def token_digests(docs: DataFrame, vocabulary: Merges) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    coded = encode(docs.select("doc_id", "text"), vocabulary, out="ids", decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
