"""Table reads and writes between steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import ANNOTATIONS, TEXT


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Lazy parquet scan of a file or folder; filters and columns reach the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path, TEXT)


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Documents that could not be parsed are rows with nulls beside ``doc_id``."""
    return scan(spark, path, ANNOTATIONS)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_annotations(df: DataFrame, path: str, buckets: int = 64, mode: str = "append") -> None:
    """Append annotations under hash buckets of the document.

    Bucket folders hold a file per run however many documents and tasks there
    are. Appending skips documents that are stored already, so that a repeated
    run adds nothing.
    """
    bucketed = df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    if mode == "append":
        try:
            stored = df.sparkSession.read.parquet(path).select("doc_id").distinct()
            bucketed = bucketed.join(stored, "doc_id", "left_anti").select(*df.columns, "doc_bucket")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    bucketed.repartition(buckets, "doc_bucket").write.mode(mode).partitionBy("doc_bucket").parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """Saved table whose later joins on ``key`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read a stored table; build and store it only when it is absent.

    It is written beside and renamed when it is whole, so a run that was killed leaves
    nothing that a later one would take for the table. Of two that build at once the
    first to end wins.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    beside = f"{path}-{uuid.uuid4().hex}"
    build().write.parquet(beside)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(of(path)) or not files.rename(of(beside), of(path)):
        files.delete(of(beside), True)
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
