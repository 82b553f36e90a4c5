"""Landed comment files and their attachments."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_ext, squish, strip_html
from .schemas import ATTRIBUTES, COMMENT_JSON

WANTED_FORMATS = ("docx", "doc", "pdf", "txt")


def read_comments_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per comment file; absent fields and JSON nulls are null.

    ``multi_line=False`` reads JSON lines, the better landing format for very
    many comments.
    """
    raw = spark.read.schema(COMMENT_JSON).json(path, multiLine=multi_line)
    return parse_comments(raw)


def parse_comments(raw: DataFrame) -> DataFrame:
    """Flatten the document and nest its files as ``attachments``.

    An attachment without file formats stays, with a null url.
    """

    def per_attachment(inc):
        files = F.coalesce(
            inc["attributes"]["fileFormats"],
            F.array(F.lit(None).cast("struct<fileUrl:string>")),
        )
        return F.transform(
            files,
            lambda f: F.struct(
                inc["id"].alias("attachment_id"),
                inc["attributes"]["docOrder"].alias("docOrder"),
                f["fileUrl"].alias("url"),
                file_ext(f["fileUrl"]).alias("format"),
                inc["attributes"]["restrictReasonType"].alias("restrictReasonType"),
            ),
        )

    attachments = F.flatten(F.transform("included", per_attachment))
    return raw.select(
        *[F.col(f"data.attributes.{a}").alias(a) for a in ATTRIBUTES],
        F.col("data.id").alias("id"),
        attachments.alias("attachments"),
    ).withColumn("n_attachments", F.coalesce(F.size("attachments"), F.lit(0)))


def attachment_manifest(comments: DataFrame, folder: str = "") -> DataFrame:
    """One row per wanted file, with the name it is stored under."""
    exploded = comments.filter(F.col("n_attachments") > 0).select(
        F.col("id").alias("comment_id"), "objectId", F.inline("attachments")
    )
    name = F.concat_ws(".", F.concat_ws("-", "comment_id", "docOrder"), "format")
    return (
        exploded.filter(F.col("url").isNotNull() & F.col("format").isin(*WANTED_FORMATS))
        .select("comment_id", "objectId", "attachment_id", "docOrder", "url", "format")
        .withColumn("file", name)
        .withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file")))
    )


def pending(manifest: DataFrame, done: DataFrame, on: str, force: bool = False) -> DataFrame:
    """Work that has no stored result yet."""
    if force:
        return manifest
    return manifest.join(done.select(on).distinct(), on, "left_anti")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = root.iter(f"{_W}p")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in paragraphs)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for content, fmt in zip(batch["content"], batch["format"]):
            text = error = None
            try:
                if fmt == "docx":
                    text = _docx_text(bytes(content))
                elif fmt in ("txt", "html", "htm"):
                    text = bytes(content).decode("utf-8", errors="replace")
                else:
                    error = f"no text decoder for {fmt}"
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                error = f"{type(e).__name__}: {e}"
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "format": batch["format"], "raw": texts, "error": errors})


def read_attachment_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )


def extract_attachment_text(files: DataFrame, ocr_threshold: int = 100) -> DataFrame:
    """Text of stored files (path, content); short or undecodable ones are ``needs_ocr``.

    Opening DOCX packages and decoding bytes is the one step that needs Python;
    everything after it is expressions. A damaged file gives a null text and its
    error. Names are ``<comment>-<docOrder>.<format>``.
    """
    typed = files.select("path", F.lower(file_ext("path")).alias("format"), "content")
    decoded = typed.mapInPandas(_decode, "path string, format string, raw string, error string")
    plain = F.when(F.col("format").isin("html", "htm"), strip_html("raw")).otherwise(F.col("raw"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = squish(plain)
    return decoded.select(
        name.alias("file"),
        F.regexp_extract(name, r"^(.*)-[0-9]+\.[^.]+$", 1).alias("comment_id"),
        F.regexp_extract(name, r"-([0-9]+)\.[^.]+$", 1).try_cast("int").alias("docOrder"),
        "format",
        text.alias("text"),
        (F.coalesce(F.length(text), F.lit(0)) < ocr_threshold).alias("needs_ocr"),
        "error",
    )


def supported_format(path: str) -> str:
    """File type of a path; raises for types outside the manifest."""
    m = re.search(r"\.([A-Za-z0-9]+)$", path)
    if not m or m.group(1).lower() not in WANTED_FORMATS:
        raise ValueError(f"not a wanted attachment type: {path}")
    return m.group(1).lower()
