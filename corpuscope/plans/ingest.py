"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import hash_order
from ..operators.tokens import pos_distribution
from ..operators.vocab import entropy_scores
from ..session import fresh_path
from ..sources import coding_sheets, comments, listing, tables
from . import inputs as I
from .catalog import query
from .sql import sql

# --- comment files ------------------------------------------------------------

_PUBLIC = "https://downloads.regulations.gov/"


def _landed_comments(spark: SparkSession, sf_dir: str) -> str:
    """Comment files as JSON lines; turn 0 stands for an attachment without files."""
    docs = I.table(spark, sf_dir, "documents")
    turns = I.table(spark, sf_dir, "conversations")
    url = F.concat(F.lit(_PUBLIC), F.concat_ws("-", "conv_id", "turn"))
    files = F.when(
        F.col("turn") > 0,
        F.array(
            F.struct(F.concat(url, F.when(F.col("role") == "user", ".pdf").otherwise(".docx")).alias("fileUrl")),
            F.struct(F.concat(url, F.lit(".png")).alias("fileUrl")),
        ),
    )
    included = turns.select(
        F.col("conv_id").alias("doc_id"),
        F.struct(
            F.concat_ws("-", F.lit("att"), "conv_id", "turn").alias("id"),
            F.struct(
                (F.col("turn") + 1).cast("int").alias("docOrder"), files.alias("fileFormats")
            ).alias("attributes"),
        ).alias("inc"),
    )
    grouped = included.groupBy("doc_id").agg(F.array_sort(F.collect_list("inc")).alias("included"))
    body = docs.join(grouped, "doc_id", "left").select(
        F.struct(
            F.col("doc_id").cast("string").alias("id"),
            F.struct(
                F.col("lang").alias("docketId"),
                F.col("source").alias("commentOnDocumentId"),
                F.concat(F.lit("obj"), "doc_id").alias("objectId"),
                F.col("text").alias("comment"),
            ).alias("attributes"),
        ).alias("data"),
        "included",
    )
    path = fresh_path(spark, "comments-json")
    body.write.json(path)
    return path


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.read_comments_json(spark, _landed_comments(spark, sf_dir), multi_line=False)


_FILES_SQL = f"""SELECT CAST(conv_id AS VARCHAR) AS comment_id, 'obj' || conv_id AS objectId,
  'att-' || conv_id || '-' || turn AS attachment_id, CAST(turn + 1 AS INTEGER) AS docOrder,
  CASE WHEN turn > 0 THEN '{_PUBLIC}' || conv_id || '-' || turn || ext END AS url,
  CASE WHEN turn > 0 THEN ltrim(ext, '.') END AS format
FROM (SELECT *, CASE WHEN role = 'user' THEN '.pdf' ELSE '.docx' END AS ext FROM conversations
  UNION ALL SELECT *, '.png' FROM conversations WHERE turn > 0)
WHERE conv_id IN (SELECT doc_id FROM documents)"""


@query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS "docketId", source AS "commentOnDocumentId",
  CAST(NULL AS VARCHAR) AS title, text AS comment,
  CAST(coalesce(n, 0) AS INTEGER) AS n_attachments
FROM documents LEFT JOIN (SELECT comment_id, count(*) AS n FROM ({_FILES_SQL}) GROUP BY 1)
  ON comment_id = CAST(doc_id AS VARCHAR)"""
)
def comments_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select(
        "id", "docketId", "commentOnDocumentId", "title", "comment", "n_attachments"
    )


@query(_FILES_SQL)
def attachments_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir).select(
        F.col("id").alias("comment_id"), "objectId", F.inline("attachments")
    )
    return rows.drop("restrictReasonType")


@query(
    f"""SELECT comment_id, "objectId", attachment_id, "docOrder", url, format,
  comment_id || '-' || "docOrder" || '.' || format AS file,
  'files/' || comment_id || '-' || "docOrder" || '.' || format AS path
FROM ({_FILES_SQL}) WHERE url IS NOT NULL AND format IN ('docx', 'doc', 'pdf', 'txt')"""
)
def attachment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.attachment_manifest(_parsed(spark, sf_dir), "files")


@query(
    f"""SELECT comment_id || '-' || "docOrder" || '.' || format AS file FROM ({_FILES_SQL})
WHERE url IS NOT NULL AND format IN ('docx', 'pdf') AND format <> 'pdf'"""
)
def pending_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PDF files stand for those already stored."""
    manifest = comments.attachment_manifest(_parsed(spark, sf_dir), "files").select("file", "format")
    done = manifest.filter(F.col("format") == "pdf")
    return comments.pending(manifest, done, "file").select("file")


@query(
    r"""SELECT file, comment_id, CAST(0 AS INTEGER) AS "docOrder", 'html' AS format, text,
  length(text) < 100 AS needs_ocr
FROM (SELECT page_id || '-0.html' AS file, CAST(page_id AS VARCHAR) AS comment_id,
  trim(regexp_replace(regexp_replace(html, '(?s)<.*?>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)"""
)
def attachment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("files/"), "page_id", F.lit("-0.html")).alias("path"),
        F.encode("html", "utf-8").alias("content"),
    )
    return comments.extract_attachment_text(files).drop("error")


# --- listings -------------------------------------------------------------------

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS "documentType",
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "lastModifiedDate", 'u' || user_id AS "objectId", 'docket' AS comment_on
FROM events"""
)
def flatten_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 250 items, landed as JSON and flattened."""
    item = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct(
            F.col("event_type").alias("documentType"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastModifiedDate"),
            F.concat(F.lit("u"), "user_id").alias("objectId"),
        ).alias("attributes"),
    )
    pages = (
        _events(spark, sf_dir)
        .groupBy(F.floor(F.col("event_id") / listing.PAGE_SIZE).alias("page"))
        .agg(F.collect_list(item).alias("data"))
        .select("data")
    )
    path = fresh_path(spark, "listing-json")
    pages.write.json(path)
    landed = spark.read.schema(listing.LISTING_JSON).json(path)
    flat = listing.flatten_listing(landed, "docket")
    return flat.select("id", "documentType", "lastModifiedDate", "objectId", "comment_on")


def overlapping_blocks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three blocks of the listing; each starts before the one before it ends."""
    events = _events(spark, sf_dir)
    d = F.to_date("ts")
    return [
        events.filter(d <= F.lit("2024-01-11")),
        events.filter((d >= F.lit("2024-01-10")) & (d <= F.lit("2024-01-21"))),
        events.filter(d >= F.lit("2024-01-20")),
    ]


_EVENT_COLUMNS = "event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, props"


@query(f"SELECT {_EVENT_COLUMNS} FROM events")
def dedupe_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.dedupe_blocks(*overlapping_blocks(spark, sf_dir))
    return rows.select("event_id", F.date_format("ts", _TS).alias("ts"), "user_id", "event_type", "props")


@query(
    """SELECT event_type, strftime((max(ts) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS cursor
FROM events GROUP BY 1"""
)
def next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.next_cursor(_events(spark, sf_dir), "event_type", "ts")


@query(
    """SELECT source, comments, block, block_size, least(block_size // 250 + 1, 20) AS pages FROM (
  SELECT source, comments, block, least(comments - (block - 1) * 5000, 5000) AS block_size FROM (
    SELECT source, comments, unnest(range(1, comments // 5000 + 2)) AS block
    FROM (SELECT source, CAST(sum(n_chars) AS BIGINT) AS comments FROM documents GROUP BY 1)))"""
)
def plan_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = I.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("comments"))
    return listing.plan_blocks(totals, "source")


@query(
    """SELECT event_type AS comment_on, count(*) AS announced,
  count(*) FILTER (ts::DATE <= DATE '2024-01-21') AS retrieved,
  count(*) FILTER (ts::DATE <= DATE '2024-01-21') - count(*) AS diff
FROM events GROUP BY 1"""
)
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block is held back, so differences show."""
    events = _events(spark, sf_dir)
    docs = events.groupBy(F.col("event_type").alias("objectid")).agg(F.count("*").alias("comments"))
    got = listing.dedupe_blocks(*overlapping_blocks(spark, sf_dir)[:2])
    return listing.reconcile_counts(got.withColumnRenamed("event_type", "comment_on"), docs)


# --- tables and sheets ------------------------------------------------------------


@query("SELECT doc_id, text FROM documents WHERE n_chars > 100 AND lang = 'en'")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both filters and the two columns reach the parquet scan."""
    docs = tables.scan(spark, f"{sf_dir}/documents.parquet")
    return docs.filter((F.col("n_chars") > 100) & (F.col("lang") == "en")).select("doc_id", "text")


@query(
    sql(
        "SELECT pos, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tokens GROUP BY 1",
        "tokens",
    )
)
def stored_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written under document buckets and scanned again."""
    path = fresh_path(spark, "annotations")
    tables.write_annotations(I.annotations(spark, sf_dir), path, buckets=8)
    shares = pos_distribution(tables.scan_annotations(spark, path))
    return shares.withColumn("share", F.round("share", 6))


@query(
    sql(
        "SELECT bigram, n, round(dH, 6) AS dh FROM scores",
        "scores",
    )
)
def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built only when absent; the second call only reads."""
    path = fresh_path(spark, "scores")

    def build() -> DataFrame:
        return entropy_scores(I.bigrams(spark, sf_dir), "comment_id", "bigram")

    tables.load_or_build(spark, path, build)
    again = tables.load_or_build(spark, path, build)
    return again.select("bigram", "n", F.round("dH", 6).alias("dh"))


@query(sql("SELECT coder, comment_id, url, support, notes FROM sheets", "sheets"))
def read_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coders' sheets written as CSV, one folder per coder, and read as one table."""
    path = fresh_path(spark, "sheets")
    filled = I.sheets(spark, sf_dir).select(
        "comment_id", "url", F.lit("text").alias("text"), "support", "notes", "coder"
    )
    filled.write.partitionBy("coder").option("header", True).csv(path)
    return coding_sheets.read_codings(spark, path).select(
        "coder", "comment_id", "url", "support", "notes"
    )


@query(
    sql(
        """SELECT comment_id, 'https://www.regulations.gov/comment/' || comment_id AS url,
  regexp_replace(regexp_replace(string_agg(CASE WHEN len > 750 THEN left(text, 747) || '...' ELSE text END, chr(10) || chr(10) ORDER BY docOrder),
    '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]+>', '', 'g') AS text, '' AS support, '' AS notes
FROM corpus WHERE comment_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) GROUP BY 1""",
        "corpus",
    )
)
def coding_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = I.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("comment_id"))
    return coding_sheets.coding_sheet(sample, I.corpus(spark, sf_dir))


@query(
    sql(
        """SELECT comment_id, any_value(url) AS url, any_value(mode) AS mode,
  """
        + ", ".join(f"max(support) FILTER (coder = '{c}') AS support_{c}" for c in I.CODERS)
        + ", "
        + ", ".join(f"coalesce(max(notes) FILTER (coder = '{c}'), '') AS notes_{c}" for c in I.CODERS)
        + """, false AS identical
FROM codes JOIN modes USING (comment_id) GROUP BY 1 HAVING count(DISTINCT support) > 1""",
        "codes",
        "modes",
    )
)
def discordance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding_sheets.discordance_sheet(I.coding(spark, sf_dir))


@query(
    sql(
        "SELECT comment_id, len FROM corpus WHERE docOrder = 0",
        "corpus",
    )
)
def shuffled_sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a seeded hash order, as sheets are written."""
    first = I.corpus(spark, sf_dir).filter(F.col("docOrder") == 0)
    return first.orderBy(hash_order("comment_id", 7)).select("comment_id", "len")
