"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import text as S
from . import inputs as I
from .catalog import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return I.table(spark, sf_dir, name)


@query(
    """SELECT doc_id, 'https://www.regulations.gov/comment/' || doc_id AS url, doc_id || '-' || lang AS joined,
  CAST(length(text) AS INTEGER) AS len FROM documents"""
)
def concat_and_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select(
        "doc_id",
        S.build_url("doc_id").alias("url"),
        F.concat_ws("-", "doc_id", "lang").alias("joined"),
        F.length("text").alias("len"),
    )


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""")
def squish_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", S.squish("text").alias("text"))


@query(
    """SELECT item_id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS dotted,
  left(text, 30) AS plain FROM benchmark"""
)
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").select(
        "item_id", S.str_trunc("text", 40).alias("dotted"), S.str_trunc("text", 30, "").alias("plain")
    )


@query(
    """SELECT page_id, regexp_replace(html, '(?s)<.*?>', ' ', 'g') AS spaced,
  regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g') AS removed FROM pages"""
)
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(
        "page_id", S.strip_html("html").alias("spaced"), S.strip_html_sheet("html").alias("removed")
    )


@query(
    """SELECT doc_id, regexp_matches(replace(text, 'The of', '#'), '(?i)the of') AS local_case,
  regexp_matches(text, '(?i)ertion|ontion') AS either FROM documents"""
)
def detect_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-ahead with its own case rule excludes one spelling at the match."""
    return t(spark, sf_dir, "documents").select(
        "doc_id",
        S.detect("text", "(?!(?-i)The of)(the of)", ignore_case=True).alias("local_case"),
        S.detect("text", "ertion|ontion", ignore_case=True).alias("either"),
    )


@query(
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, 'href="[^"]*"')) AS INTEGER) AS links,
  regexp_extract(url, '_.*|/[0-9]+', 0) AS extracted, regexp_replace(url, '^https?://', '') AS removed,
  replace(url, '/', ' ') AS replaced FROM pages"""
)
def extract_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(
        "page_id",
        F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).alias("links"),
        F.regexp_extract("url", "_.*|/[0-9]+", 0).alias("extracted"),
        F.regexp_replace("url", "^https?://", "").alias("removed"),
        F.replace("url", F.lit("/"), F.lit(" ")).alias("replaced"),
    )


@query(
    """SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', 3) AS host,
  regexp_extract(split_part(url, '?', 1), '\\.([A-Za-z0-9]+)$', 1) AS ext FROM pages"""
)
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select(
        "page_id",
        S.last_part("url", "/").alias("last"),
        S.part("url", 3, "/").alias("host"),
        S.file_ext(S.part("url", 1, "?")).alias("ext"),
    )


@query(
    """SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE regexp_matches(token, '^th.*tion$')"""
)
def subset_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("token"))
    return words.filter(F.col("token").rlike("(?s)^th.*tion\\z") & ~F.col("token").contains("\n")).distinct()


@query(
    """SELECT doc_id, CASE WHEN code = 'NA' THEN 'NA' ELSE lower(code) END AS code FROM (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'NA' WHEN quality = 1 THEN 'Y' ELSE 'N' END AS code FROM labels)"""
)
def lower_keep_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("toxic") == 1, "NA").when(F.col("quality") == 1, "Y").otherwise("N")
    return t(spark, sf_dir, "labels").select("doc_id", S.lower_keep_na(code).alias("code"))


@query(
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def replace_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"))


@query(
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS parsed,
  strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS eastern FROM events"""
)
def parse_and_shift_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parsed = D.parse_utc(iso)
    return t(spark, sf_dir, "events").select(
        "event_id",
        F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        D.eastern_cursor(parsed).alias("eastern"),
    )


@query("SELECT event_id, ts::DATE AS day, ts < TIMESTAMP '2024-01-10' AS early FROM events")
def date_of_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select(
        "event_id", F.to_date("ts").alias("day"), (F.to_date("ts") < F.lit("2024-01-10").cast("date")).alias("early")
    )


_NEAR_MONTH = """CASE WHEN date_diff('day', d, (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE) <= date_diff('day', date_trunc('month', d)::DATE, d)
  THEN (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE ELSE date_trunc('month', d)::DATE END"""


@query(
    f"""SELECT o_orderkey, CASE WHEN dayofweek(d) <= 3 THEN d - CAST(dayofweek(d) AS INTEGER) ELSE d + CAST(7 - dayofweek(d) AS INTEGER) END AS week,
  {_NEAR_MONTH} AS month FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)"""
)
def round_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest Sunday and nearest first of month."""
    return t(spark, sf_dir, "orders").select(
        "o_orderkey",
        D.round_date("o_orderdate", "week").alias("week"),
        D.round_date("o_orderdate", "month").alias("month"),
    )


@query(
    """SELECT event_id, round(log2(value + 1), 6) AS lg2, round(log10(value + 1), 6) AS lg10, round(ln(1 + value), 6) AS l1p,
  round(log10(value + 1e-5), 6) AS l1kp, round(sqrt(abs(value - 10)) * sign(value - 10), 6) AS ssqrt FROM events"""
)
def logs_and_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return t(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.log2(v + 1), 6).alias("lg2"),
        F.round(F.log10(v + 1), 6).alias("lg10"),
        F.round(F.log1p(v), 6).alias("l1p"),
        F.round(N.log1kp(v, 5), 6).alias("l1kp"),
        F.round(N.signed_sqrt(v - 10), 6).alias("ssqrt"),
    )


@query(
    """SELECT doc_id, n_chars // 250 + 1 AS pages, least(n_chars // 250 + 1, 20) AS bounded, greatest(n_chars, 1000) AS at_least FROM documents"""
)
def integer_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = N.int_div("n_chars", 250) + 1
    return t(spark, sf_dir, "documents").select(
        "doc_id",
        pages.alias("pages"),
        F.least(pages, F.lit(20).cast("long")).alias("bounded"),
        F.greatest(F.col("n_chars"), F.lit(1000).cast("long")).alias("at_least"),
    )


@query(
    """SELECT count(*) AS n, count(*) FILTER (TRY_CAST(split_part(url, '/', -1) AS INTEGER) IS NULL) AS not_integer,
  CAST(sum(TRY_CAST(split_part(url, '/', -1) AS INTEGER)) AS BIGINT) AS total FROM pages"""
)
def checked_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts that give null instead of an error, and how many did."""
    last = S.last_part("url", "/").try_cast("int")
    return t(spark, sf_dir, "pages").agg(
        F.count("*").alias("n"),
        F.sum(last.isNull().cast("long")).alias("not_integer"),
        F.sum(last).alias("total"),
    )


@query("SELECT event_id, CAST(sign(value - 20) AS INTEGER) AS hashed FROM events")
def sign_of_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", N.binary_hash(F.col("value") - 20).alias("hashed"))


@query("SELECT lang || '.' || source AS grp, count(*) AS n FROM documents GROUP BY 1")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").groupBy(S.composite("lang", "source").alias("grp")).agg(
        F.count("*").alias("n")
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return t(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"))


@query(
    """SELECT lang, format('{:,}', n) || ' (' || CAST(floor(n * 100.0 / total + 0.5) AS INTEGER) || '%)' AS cell
FROM (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1)"""
)
def count_with_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n"))
    return counts.select("lang", S.count_with_percent("n", total.scalar()).alias("cell"))
