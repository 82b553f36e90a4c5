"""10. Passages that repeat across documents, by hashes of every window of words.

Every WIDTH consecutive words of a document have a Rabin-Karp hash. A window is
repeated when the same hash starts in a document of a smaller id; the words of
repeated windows go, and overlapping windows merge into maximal intervals.

The windows of a block of documents are sorted by hash. What the block itself shows
to be repeated is settled there; of every hash only the windows of the block's
smallest document go on, so a passage that a third of the documents hold reaches
its range of hashes once per block. Where a smaller document of another block covers
a window, its range sends the place back to the block, and the block's list of
documents cuts its places by document. 80 bits of a window are compared.

Cases: null texts have no words; texts shorter than a window keep all words; a null
id counts as larger than any; rows that repeat an id don't cover each other, and
every row gives a row. Repeats inside one document stay. Rows that share an id, as
those without one do, are told apart by a 64-bit hash of the text and its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import small_batches, stored, text_of, whole, words
from .ranges import dealt_again

WIDTH = 13
#: Words of one block.
BLOCK = 1 << 20
#: Bytes that a block sends on at once, about.
SENT_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
#: What tells rows of one id apart: hash and octets of the text.
ROW = np.dtype([("row", "<i8"), ("octets", "<i4")])
#: A row of a block, as its range needs it and as its result does.
DOCUMENT = np.dtype([("id", "<i8"), ("start", "<u4"), *ROW.descr])
#: What a row between the steps holds: a range's segments, a block's documents or its repeated places.
SEGMENTS, DOCUMENTS, PLACES = 0, 1, 2
SENT = pa.schema([("range", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("octets", pa.int32()), ("data", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _spans(places: np.ndarray) -> bytes:
    """Sorted places as runs (first, number)."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
    number = np.diff(np.concatenate([first, [len(places)]]))
    return np.stack([places[first], number], 1).astype(np.uint32).tobytes()


def sort_hashes(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An order in which equal (h, more) are neighbours."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], more[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((more, h))
    return order


def _covered(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of sorted windows, those that also start in a document of a smaller id."""
    if not len(h):
        return np.zeros(0, bool)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])
    begin = np.flatnonzero(new)
    smallest = np.minimum.reduceat(ids, begin)
    return ids > np.repeat(smallest, np.diff([*begin, len(h)]))


def settle(block: int, documents: np.ndarray, sizes, flat, width: int, bits: int = packed.FIRST) -> Iterator[tuple]:
    """SENT rows of one block: its documents, its repeated places and the segments to compare, of 2^bits ranges."""
    at = packed.inside(sizes, width).astype(np.uint32)
    h, more = packed.rolling(flat, width)[at], packed.rolling_more(flat, width)[at]
    order = sort_hashes(h, more).astype(np.uint32)
    h, more, at = h[order], more[order], at[order]
    del order
    ids = documents["id"][np.searchsorted(documents["start"], at, "right") - 1]
    here = _covered(h, more, ids)
    del ids
    yield -1 - block, DOCUMENTS, block, documents.tobytes()
    if here.any():
        yield -1 - block, PLACES, block, at[here].tobytes()
    owners = np.empty(len(documents), packed.OWNER)
    owners["id"], owners["start"] = documents["id"], documents["start"]
    for where, data in packed.deal(block, owners, h[~here], more[~here], at[~here], 0, bits):
        yield where, SEGMENTS, block, data


def compare(rows) -> list[tuple]:
    """(block, places) that smaller documents of other blocks cover, of the rows of one range."""
    parts = [s for data in rows for s in packed.segments(data)]
    h, more = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    ids = np.concatenate([p[1]["id"][np.searchsorted(p[1]["start"], p[4], "right") - 1] for p in parts])
    order = sort_hashes(h, more)
    hit = np.sort(order[_covered(h[order], more[order], ids[order])])
    del h, more, ids, order
    ends = np.cumsum([len(p[4]) for p in parts])
    cut = np.searchsorted(hit, [0, *ends])
    return [
        (p[0], p[4][hit[a:b] - (end - len(p[4]))].tobytes()) for p, end, a, b in zip(parts, ends, cut, cut[1:]) if b > a
    ]


def by_document(documents: np.ndarray, places: np.ndarray) -> list[tuple]:
    """FOUND rows of the documents of a block that have repeated places."""
    places = np.sort(places).astype(np.int64)
    doc = np.searchsorted(documents["start"], places, "right") - 1
    borders = [*packed.runs(doc), len(doc)]
    out = []
    for a, b in zip(borders, borders[1:]):
        d = documents[doc[a]]
        out.append((int(d["id"]), int(d["row"]), int(d["octets"]), _spans(places[a:b] - int(d["start"]))))
    return out


def _row_of(body: Column) -> list[Column]:
    return [F.xxhash64(body).alias("row"), F.octet_length(body).alias("octets")]


def repeated_places(docs: DataFrame, key: str, text: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """id, row, octets and data: binary runs (first word, number) at which repeated windows start."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0] or 0
    bits = packed.range_bits(size / 6)
    first = bits if bits <= packed.DIRECT else packed.FIRST
    body = text_of(text)
    hashed = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"),
        *_row_of(body),
        F.transform(words(body), lambda w: F.xxhash64(w)).alias("w"),
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = TaskContext.get().partitionId() << 32

        def settled():
            documents, sizes, flat = (np.concatenate(x) for x in zip(*held))
            held.clear()
            documents["start"] = np.cumsum(sizes) - sizes
            rows, octets = [], 0
            # Few bytes at a time become Arrow's, so the block isn't held twice.
            for row in settle(number, documents, sizes, flat, width, first):
                rows.append(row)
                octets += len(row[-1])
                if octets >= SENT_BYTES:
                    yield from _table(rows, SENT).to_batches()
                    rows.clear()
                    octets = 0
            if rows:
                yield from _table(rows, SENT).to_batches()

        n = 0
        for b in batches:
            lists = b.column("w")
            documents = np.empty(b.num_rows, DOCUMENT)
            for c in ("id", *ROW.names):
                documents[c] = b.column(c).to_numpy()
            flat = lists.flatten().to_numpy().view(np.uint64)
            held.append((documents, np.diff(lists.offsets.to_numpy()).astype(np.int64), flat))
            n += len(flat)
            if n >= block:
                yield from settled()
                n, number = 0, number + 1
        if held:
            yield from settled()

    sent = hashed.mapInArrow(blocks, _ddl(SENT))
    if bits > first:
        # Documents and places go with the segments: their blocks are numbered by the task that made them.
        sent = dealt_again(sent, bits, size / 6)

    def compared(group: pa.Table) -> pa.Table:
        """Segments become places; what belongs to a block passes."""
        if group.num_rows and group.column("kind")[0].as_py() != SEGMENTS:
            return group.select(["kind", "block", "data"])
        found = [(PLACES, *x) for x in compare(x.as_py() for x in group.column("data"))] if group.num_rows else []
        return _table(found, pa.schema(list(SENT)[1:]))

    def cut(group: pa.Table) -> pa.Table:
        kinds, data = group.column("kind").to_pylist(), group.column("data")
        documents = [np.frombuffer(x.as_py(), DOCUMENT) for k, x in zip(kinds, data) if k == DOCUMENTS]
        places = [np.frombuffer(x.as_py(), np.uint32) for k, x in zip(kinds, data) if k == PLACES]
        return _table(by_document(documents[0], np.concatenate(places)) if places else [], FOUND)

    back = sent.groupBy("range").applyInArrow(compared, _ddl(pa.schema(list(SENT)[1:])))
    return back.groupBy("block").applyInArrow(cut, _ddl(FOUND))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` with n_words, n_removed, spans (word intervals) and kept_text added;
    columns of these names are replaced."""
    small_batches(docs.sparkSession)
    added = {"n_words": "long", "n_removed": "long", "spans": "array<struct<start:int,end:int>>", "kept_text": "string"}
    docs = docs.drop(*added)
    found = stored(repeated_places(docs, key, text, width), "repeated-places")
    # Equal rows have equal places.
    by_row = found.groupBy("id", *ROW.names).agg(F.first("data").alias("__places"))
    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    tagged = docs.select(whole(docs), ids.alias("id"), *_row_of(text_of(text)))
    both = tagged.join(by_row, ["id", *ROW.names], "left").select("__doc.*", "__places")
    columns = docs.columns
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(r"[^\x20\x09-\x0D]+").findall
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for t, places in zip(b.column(text).to_pylist(), b.column("__places").to_pylist()):
                ws = find(t or "")
                n_words.append(len(ws))
                if not places:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(" ".join(ws))
                    continue
                runs = np.frombuffer(places, np.uint32).reshape(-1, 2).astype(np.int64)
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, runs[:, 0], 1)
                np.add.at(edge, runs[:, 0] + runs[:, 1] + width - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                n_removed.append(int(gone.sum()))
                spans.append([{"start": int(s), "end": int(e)} for s, e in turn.reshape(-1, 2)])
                cuts = [0, *turn.tolist(), len(ws)]
                kept.append(" ".join([w for s, e in zip(cuts[::2], cuts[1::2]) for w in ws[s:e]]))
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.string())]
            old = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*old, *more], [*columns, *added])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return both.mapInArrow(cut, ", ".join([*fields, *(f"{n} {t}" for n, t in added.items())]))
