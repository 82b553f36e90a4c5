"""Numeric and null-handling expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is false, never null, for a null value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Anti-membership that keeps null values."""
    return ~is_in(c, values)


def log1kp(x: Column | str, k: int = 5) -> Column:
    """log10(x + 10^-k)."""
    return F.log10(as_col(x) + F.lit(10.0 ** -k))


def signed_sqrt(x: Column | str) -> Column:
    return F.sqrt(F.abs(as_col(x))) * F.signum(as_col(x))


def binary_hash(x: Column | str) -> Column:
    """Sign of a count: -1, 0 or 1."""
    return F.signum(as_col(x)).cast("int")


def int_div(a: Column | str, b: int) -> Column:
    return F.floor(as_col(a) / F.lit(b)).cast("long")


def md5_int(key: Column, digits: int = 8) -> Column:
    """First hexadecimal digits of the MD5 of a key, as a number."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")
