"""Landed files, sheets, stored tables and streams in fresh folders."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpuscope.operators.annotate import annotate
from corpuscope.operators.corpus import build_corpus, submission_histogram
from corpuscope.sources import coding_sheets, comments, listing, tables
from corpuscope.streaming import ingest_listing_stream, submissions_stream, weekly_table
from corpuscope.streaming.listing import in_ranges, new_rows


def comment_json(cid, included):
    return {
        "data": {"id": cid, "attributes": {"docketId": "D", "objectId": "o" + cid, "comment": "text", "title": None}},
        **({"included": included} if included is not None else {}),
    }


@pytest.fixture
def landed(tmp_path):
    files = [{"fileUrl": "https://x/a.pdf"}, {"fileUrl": "https://x/a.docx"}]
    cases = {
        "c1": [{"id": "a1", "attributes": {"docOrder": 1, "fileFormats": files}},
               {"id": "a2", "attributes": {"docOrder": 2, "fileFormats": None, "restrictReasonType": "copyright"}}],
        "c2": None,
        "c3": [{"id": "a3", "attributes": {"docOrder": 1, "fileFormats": [{"fileUrl": "https://x/b.png"}]}}],
    }
    for cid, inc in cases.items():
        (tmp_path / f"{cid}.json").write_text(json.dumps(comment_json(cid, inc), indent=1))
    return str(tmp_path)


def test_comment_files(spark, landed):
    got = comments.read_comments_json(spark, landed)
    by_id = {r.id: r for r in got.collect()}
    assert {k: r.n_attachments for k, r in by_id.items()} == {"c1": 3, "c2": 0, "c3": 1}
    assert by_id["c1"].attachments[2].url is None and by_id["c1"].title is None
    manifest = comments.attachment_manifest(got, "files")
    assert sorted(r.path for r in manifest.collect()) == ["files/c1-1.docx", "files/c1-1.pdf"]
    done = spark.createDataFrame([("c1-1.pdf",)], "file string")
    assert [r.file for r in comments.pending(manifest, done, "file").collect()] == ["c1-1.docx"]
    assert comments.pending(manifest, done, "file", force=True).count() == 2


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_attachment_text(spark, tmp_path):
    (tmp_path / "EPA-1-1.docx").write_bytes(docx("First  line", "Second " + "x" * 120))
    (tmp_path / "EPA-1-2.txt").write_text(" short \n text ")
    (tmp_path / "EPA-2-1.docx").write_bytes(b"broken")
    (tmp_path / "EPA-2-2.pdf").write_bytes(b"%PDF")
    files = comments.read_attachment_files(spark, str(tmp_path))
    got = {r.file: r for r in comments.extract_attachment_text(files).collect()}
    assert got["EPA-1-1.docx"].text == "First line Second " + "x" * 120
    assert (got["EPA-1-1.docx"].comment_id, got["EPA-1-1.docx"].docOrder) == ("EPA-1", 1)
    assert not got["EPA-1-1.docx"].needs_ocr and got["EPA-1-2.txt"].needs_ocr
    assert got["EPA-1-2.txt"].text == "short text"
    assert got["EPA-2-1.docx"].text is None and "BadZipFile" in got["EPA-2-1.docx"].error
    assert got["EPA-2-2.pdf"].needs_ocr and got["EPA-2-2.pdf"].text is None
    assert comments.supported_format("a.PDF") == "pdf"
    with pytest.raises(ValueError):
        comments.supported_format("a.png")


def test_listing_pages(spark, tmp_path):
    page = {"data": [{"id": "1", "attributes": {"documentType": "Rule", "objectId": "o", "postedDate": "d", "title": "t", "lastModifiedDate": "2018-05-01T03:00:00Z"}}], "meta": {"totalElements": 1}}
    (tmp_path / "p.json").write_text(json.dumps(page))
    docs = listing.read_listing_json(spark, str(tmp_path))
    assert listing.rule_documents(docs).first().objectid == "o"
    tagged = docs.withColumn("comment_on", F.lit("x"))
    assert listing.next_cursor(tagged).first().cursor == "2018-04-30 23:00:00"


def test_block_plan(spark):
    docs = spark.createDataFrame([("a", 9292), ("b", 100), ("c", 0)], "objectid string, comments int")
    got = sorted((r.objectid, r.block, r.block_size, r.pages) for r in listing.plan_blocks(docs).collect())
    assert got == [("a", 1, 5000, 20), ("a", 2, 4292, 18), ("b", 1, 100, 1)]


def test_sheets_by_file(spark, tmp_path):
    for coder, code in (("EL", "Y"), ("CC", "NA")):
        (tmp_path / f"{coder}.csv").write_text(f'comment_id,url,text,support,notes\n1,u,"a ""b""\nc",{code},note\n')
    got = sorted((r.coder, r.support, r.notes) for r in coding_sheets.read_codings(spark, str(tmp_path)).collect())
    assert got == [("CC", "NA", "note"), ("EL", "Y", "note")]


def test_sheet_round_trip(spark, tmp_path):
    text = build_corpus(spark.createDataFrame([("1", 'said "yes",\n' + "<b>x</b>" * 200)], "comment_id string, text string"))
    sheet = coding_sheets.coding_sheet(text, text)
    coding_sheets.write_sheet(sheet, str(tmp_path / "sheet"))
    assert coding_sheets.read_codings(spark, str(tmp_path / "sheet")).count() == 1
    assert sheet.first().text.endswith("...") and "<b>" not in sheet.first().text


def test_stored_tables(spark, tmp_path):
    docs = build_corpus(spark.createDataFrame([("1", "Some words. " * 20)], "comment_id string, text string"))
    path = str(tmp_path / "ann")
    tables.write_annotations(annotate(docs), path, buckets=4)
    assert tables.scan_annotations(spark, path).count() == annotate(docs).count()
    tables.write_table(docs, str(tmp_path / "text"))
    assert tables.scan_text(spark, str(tmp_path / "text")).columns == docs.columns
    calls = []

    def build():
        calls.append(1)
        return docs

    for _ in range(2):
        tables.load_or_build(spark, str(tmp_path / "once"), build)
    assert calls == [1]


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StopWordsRemover, Tokenizer

    df = spark.createDataFrame([("a the words",)], "text string")
    model = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="t"), StopWordsRemover(inputCol="t", outputCol="w")]).fit(df)
    tables.save_model(model, str(tmp_path / "m"))
    assert tables.load_model(str(tmp_path / "m")).transform(df).first().w == ["words"]


def test_bucketed_join_needs_no_shuffle(spark):
    base = spark.range(100).select(F.col("id").cast("string").alias("comment_id"), "id")
    names = ("bucketed_left", "bucketed_right")
    for name in names:
        tables.bucketed_table(base, name, "comment_id", 4)
    a, b = (spark.table(n) for n in names)
    plan = a.hint("merge").join(b.withColumnRenamed("id", "other"), "comment_id")._jdf.queryExecution().executedPlan().toString()
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    assert "Exchange hashpartitioning" not in plan


def test_a_batch_reads_the_ranges_of_its_keys(spark, tmp_path):
    target = str(tmp_path / "target")
    for n in range(5):
        spark.range(n * 2000, (n + 1) * 2000).selectExpr("lpad(cast(id as string), 8, '0') as k", "id").write.parquet(f"{target}/batch={n}")
    known = spark.read.parquet(target)
    batch = spark.createDataFrame([(f"{k:08d}", k) for k in [*range(9900, 10040), 17, 4000]] + [(None, -1)], "k string, id long")
    near = in_ranges(known, batch, "k")
    assert near.count() == 102
    assert "PushedFilters: [Or(" in near._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in new_rows(batch, near, ["k"]).collect()) == [-1, *range(10000, 10040)]
    assert in_ranges(known, batch.limit(0), "k").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.range(400).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, CAST(id AS INT) * 3)")).alias("ts"),
    )
    land, out, state = (str(tmp_path / n) for n in ("land", "out", "state"))
    for low, high in ((0, 210), (200, 400), (390, 400)):
        events.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(land)
        ingest_listing_stream(spark, land, events.schema, out, state, "ts", ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 400
    # Another document's listing lands later with much older dates, and a row that is known.
    old = events.limit(10).withColumn("event_id", F.col("event_id") + 1000).withColumn("ts", F.col("ts") - F.expr("INTERVAL 300 DAYS"))
    old.unionByName(old).unionByName(events.limit(1)).write.mode("append").parquet(land)
    ingest_listing_stream(spark, land, events.schema, out, state, "ts", ["event_id"]).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.count() == 410 and rows.filter("event_id >= 1000").count() == 10
    events.limit(0).write.mode("append").parquet(land)
    ingest_listing_stream(spark, land, events.schema, out, state, "ts", ["event_id"]).awaitTermination()
    out, events = str(tmp_path / "again"), rows.select(*events.columns)
    events.write.parquet(out)
    weekly, wstate = str(tmp_path / "weekly"), str(tmp_path / "wstate")
    submissions_stream(spark, out, events.schema, weekly, wstate, "ts").awaitTermination()
    batch = submission_histogram(events, "ts", "week")
    assert sorted(map(tuple, weekly_table(spark, weekly).collect())) == sorted(map(tuple, batch.collect()))
    closed, cstate = str(tmp_path / "closed"), str(tmp_path / "cstate")
    submissions_stream(spark, out, events.schema, closed, cstate, "ts", "1 day", closed_only=True).awaitTermination()
    assert set(map(tuple, spark.read.parquet(closed).collect())) < set(map(tuple, batch.collect()))
