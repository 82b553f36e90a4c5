"""Comparing very many hashes with few bytes for each.

A block of rows is sorted by hash and dealt into ranges of hashes. What a block has in
a range travels as one segment: the block's number, the rows that its entries belong to,
and the entries. A block is dealt into at most 2^FIRST ranges, so a segment holds
thousands of entries however large the input is; where more ranges are needed, the
segments of many blocks in one range are dealt once more, into rows of many segments.
So an entry costs about as many bytes at every size.
"""

from __future__ import annotations

import numpy as np

#: About so many entries meet in one range, and so many are dealt again at once.
RANGE, DEALT = 1 << 22, 1 << 22
#: Bits of the ranges that a single block is dealt into.
FIRST = 6
#: Bits up to which blocks of texts are dealt into all ranges at once: segments then name more
#: owners, but bytes of one dealing are on the disk and not of two.
DIRECT = 12
#: Bytes of an entry, about: the step from the hash before, more bits, and its place in the block.
ENTRY_BYTES = 11
#: A row of a block: its id and where it begins in the block.
OWNER = np.dtype([("id", "<i8"), ("start", "<u4")])
#: Of a segment: the first hash and place, and the bytes that a step, a place and a number take.
HEAD = np.dtype([
    ("block", "<i8"), ("first", "<u8"), ("at", "<u4"), ("owners", "<u4"), ("entries", "<u4"), ("step", "u1"), ("place", "u1"), ("more", "u1"),
])
NOBODY = np.zeros(0, OWNER)


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers in as few bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return width, values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def wide(data: bytes, place: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, place).reshape(n, width)
    return out.view(np.uint64).ravel()


def range_bits(entries: float) -> int:
    """Bits of a hash that name its range."""
    return min(30, max(FIRST, int(np.ceil(np.log2(max(entries, 1) / RANGE)))))


def segment(block: int, owners: np.ndarray, h: np.ndarray, more: np.ndarray, at: np.ndarray) -> bytes:
    """Entries of one range, with the rows (OWNER, in order of their starts) that they are in."""
    used = np.unique(np.searchsorted(owners["start"], at, "right") - 1) if len(owners) else []
    step, steps = narrow(np.diff(h))
    # Places that count up need no bytes.
    place, places = (0, b"") if (np.diff(at.astype(np.int64)) == 1).all() else narrow(at)
    size, numbers = narrow(more)
    head = np.array([(block, h[0], at[0], len(used), len(h), step, place, size)], HEAD)
    return b"".join([head.tobytes(), owners[used].tobytes() if len(used) else b"", steps, places, numbers])


def segments(data: bytes):
    """(block, owners, h, more, at) of each segment in a row."""
    i = 0
    while i < len(data):
        block, first, at, n_owners, n, step, place, size = np.frombuffer(data, HEAD, 1, i)[0].tolist()
        i += HEAD.itemsize
        owners = np.frombuffer(data, OWNER, n_owners, i)
        i += n_owners * OWNER.itemsize
        h = np.cumsum(np.concatenate([np.array([first], np.uint64), wide(data, i, n - 1, step)]), dtype=np.uint64)
        i += (n - 1) * step
        places = wide(data, i, n, place).astype(np.uint32) if place else np.arange(at, at + n, dtype=np.uint32)
        i += n * place
        more = wide(data, i, n, size).astype(np.uint32)
        i += n * size
        yield block, owners, h, more, places


def deal(block: int, owners: np.ndarray, h: np.ndarray, more: np.ndarray, at: np.ndarray, shift: int, bits: int):
    """(range, segment) of sorted entries by the ``bits`` below the top ``shift`` ones; ``owners`` may be none."""
    if not len(h):
        return
    top = (h << np.uint64(shift)) >> np.uint64(64 - bits)
    borders = [*runs(top), len(h)]
    for a, b in zip(borders, borders[1:]):
        yield int(top[a]), segment(block, owners, h[a:b], more[a:b], at[a:b])


def deal_again(rows, shift: int, bits: int):
    """(range, data) of rows of one range, dealt by its next bits; a row has segments of many blocks."""
    out: dict[int, list[bytes]] = {}
    for data in rows:
        for block, owners, h, more, at in segments(data):
            for where, part in deal(block, owners, h, more, at, shift, bits):
                out.setdefault(where, []).append(part)
    for where, found in out.items():
        yield where, b"".join(found)


def runs(h: np.ndarray) -> np.ndarray:
    """Where equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of every ``width`` words in a row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for j in range(width):
        h *= base
        h += words[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def inside(sizes: np.ndarray, width: int) -> np.ndarray:
    """Of texts of these sizes, laid end to end: the starts of windows within one text."""
    starts = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - width + 1, 0)
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


def rolling_more(words: np.ndarray, width: int) -> np.ndarray:
    """16 bits of another hash of every ``width`` words in a row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    high, base = (words >> np.uint64(32)).astype(np.uint32), np.uint32(0x85EBCA6B)
    h = np.zeros(n, np.uint32)
    for j in range(width):
        h *= base
        h += high[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(16)).astype(np.uint16)
