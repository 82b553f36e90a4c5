"""Date expressions. The session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col


def round_week(date: Column | str) -> Column:
    """Nearest Sunday: Sunday to Wednesday go down, Thursday to Saturday up."""
    shifted = F.date_add(F.to_date(as_col(date)), 3)
    return F.date_sub(shifted, F.dayofweek(shifted) - 1)


def round_month(date: Column | str) -> Column:
    """Nearest first of month; a tie goes up."""
    d = F.to_date(as_col(date))
    low = F.trunc(d, "month").cast("date")
    high = F.add_months(low, 1)
    return F.when(F.datediff(high, d) <= F.datediff(d, low), high).otherwise(low)


def round_date(date: Column | str, unit: str) -> Column:
    if unit == "week":
        return round_week(date)
    if unit == "month":
        return round_month(date)
    raise ValueError(f"unsupported unit: {unit}")


def parse_utc(stamp: Column | str) -> Column:
    """ISO-8601 UTC text to a timestamp (null when it does not parse)."""
    return F.try_to_timestamp(as_col(stamp))


def eastern_cursor(ts: Column | str) -> Column:
    """UTC timestamp to the Eastern-time text that the listing service queries by."""
    local = F.from_utc_timestamp(as_col(ts), "America/New_York")
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss")
