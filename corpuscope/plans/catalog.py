"""Registry of the queries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


class Entry(NamedTuple):
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that checks it."""

    def register(f: Query) -> Query:
        if f.__name__ in ENTRIES:
            raise ValueError(f"{f.__name__} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Dates and cursors are defined in UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        ENTRIES[f.__name__] = Entry(run, sql)
        return f

    return register


def once(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where a session keeps what several queries need: built once, then read."""
    mark = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    return f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{mark}"
