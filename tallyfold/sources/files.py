"""Uploaded files: read, admit, route, and recognise copies."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.groups import attach

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def scan_files(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Files of a folder with name, size and content hash, as a batch or a stream."""
    reader = spark.readStream.schema(FILE_SCHEMA) if streaming else spark.read
    found = reader.format("binaryFile").load(folder)
    return found.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.col("modificationTime").alias("created_at"),
        "content",
    )


def upload_suffix(filename: Column) -> Column:
    return F.lower(F.substring_index(filename, ".", -1))


def admit(files: DataFrame) -> DataFrame:
    """Files with ``rejected``: the reason they are not taken, or NULL.

    Files: ``file_id, org_id, batch_id, filename, size``.
    """
    sizes = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_files"))
    counted = attach(files, sizes, ["batch_id"])
    reason = (
        F.when(F.col("batch_files") > fixed.MOST_FILES_PER_BATCH, "batch_too_large")
        .when(~upload_suffix(F.col("filename")).isin(*fixed.UPLOAD_SUFFIXES), "unsupported_format")
        .when(F.col("size") > fixed.MOST_UPLOAD_BYTES, "file_too_large")
    )
    return counted.withColumn("rejected", reason)


def route(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Way of each file: text layer, scan, or none for its format."""
    readable = blocks.select(F.col("doc_id").alias("file_id")).distinct().withColumn(
        "_text", F.lit(True)
    )
    suffix = F.lower(F.regexp_extract("filename", r"[^./][^/]*(\.[^./]+)$", 1))
    way = (
        F.when((suffix == ".pdf") & F.col("_text").isNotNull(), "digital")
        .when(suffix == ".pdf", "scan")
        .when(suffix.isin(*["." + s for s in fixed.IMAGE_SUFFIXES]), "scan")
        .otherwise("unsupported")
    )
    return files.join(readable, "file_id", "left").withColumn("route", way).drop("_text")


def object_key(org_id: Column, file_id: Column, filename: Column) -> Column:
    """Storage key; NULL where the name would leave the tenant's folder."""
    escapes = filename.contains("..") | filename.startswith("/")
    return F.when(~escapes, F.concat_ws("/", org_id, file_id, filename))


def mark_copies(files: DataFrame) -> DataFrame:
    """Files with ``duplicate_of``: the first upload of the same bytes by the same tenant.

    Files: ``file_id, org_id, sha256, created_at``.  The first by time, then id, is a minimum
    that combines before the shuffle; a content with very many copies is never gathered.
    """
    keys = ["org_id", "sha256"]
    first = files.groupBy(*keys).agg(
        F.min_by("file_id", F.struct("created_at", "file_id")).alias("_first")
    )
    marked = attach(files, first, keys)
    return marked.withColumn(
        "duplicate_of", F.when(F.col("_first") != F.col("file_id"), F.col("_first"))
    ).drop("_first")


def not_stored(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose content the tenant has not uploaded before."""
    keys = ["org_id", "sha256"]
    return files.join(stored.select(*keys).distinct(), keys, "left_anti")
