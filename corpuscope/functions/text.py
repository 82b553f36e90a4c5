"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMENT_URL = "https://www.regulations.gov/comment/"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_url(comment_id: Column | str) -> Column:
    return F.concat(F.lit(COMMENT_URL), as_col(comment_id).cast("string"))


def squish(text: Column | str) -> Column:
    """Collapse runs of whitespace to one space and trim both ends."""
    return F.trim(F.regexp_replace(as_col(text), r"\s+", " "))


def str_trunc(text: Column | str, width: int, ellipsis: str = "...") -> Column:
    """Shorten to ``width`` characters, the ellipsis counted in the width."""
    c = as_col(text)
    keep = width - len(ellipsis)
    if keep < 0:
        raise ValueError("width is shorter than the ellipsis")
    short = F.concat(F.substring(c, 1, keep), F.lit(ellipsis))
    return F.when(F.length(c) > width, short).otherwise(c)


def strip_html(text: Column | str) -> Column:
    """Replace each tag by one space.

    ``<[^>]*>`` finds what a lazy dot-all ``<.*?>`` finds, without backtracking.
    """
    return F.regexp_replace(as_col(text), "<[^>]*>", " ")


def strip_html_sheet(text: Column | str) -> Column:
    """Drop comments and tags with nothing in their place (for review sheets)."""
    without_comments = F.regexp_replace(as_col(text), r"(?s)<!--.*?-->", "")
    return F.regexp_replace(without_comments, r"<[^>]+>", "")


def contains_fixed(text: Column | str, phrase: str) -> Column:
    """Fixed-string search that ignores case."""
    return F.lower(as_col(text)).contains(phrase.lower())


def detect(text: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    return as_col(text).rlike(f"(?i){pattern}" if ignore_case else pattern)


def last_part(text: Column | str, sep: str = "_") -> Column:
    return F.split_part(as_col(text), F.lit(sep), F.lit(-1))


def part(text: Column | str, index: int, sep: str = "_") -> Column:
    return F.split_part(as_col(text), F.lit(sep), F.lit(index))


def file_ext(path: Column | str) -> Column:
    return F.regexp_extract(as_col(path), r"\.([A-Za-z0-9]+)$", 1)


def lower_keep_na(code: Column | str) -> Column:
    """Lower-case a code, but keep the literal code ``NA`` as it is."""
    c = as_col(code)
    return F.when(c == "NA", c).otherwise(F.lower(c))


def composite(*cols: Column | str, sep: str = ".") -> Column:
    return F.concat_ws(sep, *[as_col(c) for c in cols])


def count_with_percent(n: Column | str, total: Column | str, decimals: int = 0) -> Column:
    """Table cell such as ``1,234 (56%)``; whole counts keep halves exact."""
    count = as_col(n).cast("long")
    pct = F.format_number(F.round(count * 100 / as_col(total), decimals), decimals)
    return F.concat(F.format_number(count, 0), F.lit(" ("), pct, F.lit("%)"))
