"""Dealing segments of hashes into further ranges, as a Spark step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed


def dealt_again(sent: DataFrame, bits: int, entries: float) -> DataFrame:
    """(range, data) of rows (range, block, data) that were dealt by FIRST bits, now dealt by ``bits``.

    A range's rows are shared out over as many tasks as its entries need; each deals the
    segments of the blocks that it holds together. Where ``sent`` has a ``kind``, rows of
    another kind than 0 pass as they are, so that what sends both is run once, and rows are
    (range, kind, block, data).
    """
    kinds = "kind" in sent.columns
    more = bits - packed.FIRST
    tasks = max(1, round(entries / (1 << packed.FIRST) / packed.DEALT))
    placed = sent.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(tasks)))
    count = min(20_000, tasks << packed.FIRST)
    placed = placed.repartition(count, "range", "turn").sortWithinPartitions("range", "turn")
    schema = pa.schema([("range", pa.int64()), *([("kind", pa.int32()), ("block", pa.int64())] if kinds else []), ("data", pa.binary())])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None

        def dealt():
            rows = [((now[0] << more) + where, data) for where, data in packed.deal_again(held, packed.FIRST, more)]
            held.clear()
            while rows:
                some = rows[-16:]
                del rows[-16:]
                places, data = (pa.array(x, t) for x, t in zip(zip(*some), (pa.int64(), pa.binary())))
                more_columns = [pa.array([0] * len(some), pa.int32()), pa.array([-1] * len(some), pa.int64())] if kinds else []
                yield pa.RecordBatch.from_arrays([places, *more_columns, data], schema=schema)

        for b in batches:
            if kinds:
                others = pc.not_equal(b.column("kind"), 0)
                if pc.any(others).as_py():
                    yield b.filter(others).select(schema.names)
                    b = b.filter(pc.invert(others))
            for place, turn, data in zip(*(b.column(c).to_pylist() for c in ("range", "turn", "data"))):
                if held and (now != (place, turn) or size >= packed.DEALT * packed.ENTRY_BYTES):
                    yield from dealt()
                    size = 0
                now = place, turn
                held.append(data)
                size += len(data)
        if held:
            yield from dealt()

    return placed.mapInArrow(again, "range long, kind int, block long, data binary" if kinds else "range long, data binary")
