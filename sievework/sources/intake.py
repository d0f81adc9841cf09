"""Intake: which files of a folder become jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.paths import base_name, extension, folder_prefix, report_uid, source_key, summary_key
from sievework.functions.text import col
from sievework.layout import AUDIT_SCHEMA, MAX_UPLOAD_BYTES

# Accepted extensions.
EXTENSIONS = [".csv", ".xlsx"]


def refusal(name: Column | str, size: Column | str, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """Why a file is not accepted; null when it is."""
    name, size = col(name), col(size)
    return (
        F.when(name.isNull() | size.isNull() | (size == 0), F.lit("empty"))
        .when(size > max_bytes, F.lit("too_large"))
        .when(~extension(name).isin(EXTENSIONS), F.lit("unsupported_format"))
    )


def list_files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """One row per file; contents are never read (only metadata columns are selected).

    A scan has no task for an empty file, so those come from the file index, which the driver
    holds for any scan.
    """
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listed = scan.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    known = spark.createDataFrame([(p,) for p in scan.inputFiles()], "file_path STRING")
    # The two listings write the slashes after a scheme differently.
    same = F.regexp_replace("file_path", "^([a-z0-9]+):/+", "$1:/").alias("same_path")
    seen = listed.select(same)
    empty = known.withColumn("same_path", same).join(seen, "same_path", "left_anti").select(
        "file_path", F.lit(0).cast("bigint").alias("file_size_bytes"), F.lit(None).cast("timestamp").alias("modified_at")
    )
    return listed.unionByName(empty)


def workbook_listing(books: DataFrame) -> DataFrame:
    """The listing intake sees for in-memory workbooks."""
    return books.select(
        "file_path",
        F.length("content").cast("bigint").alias("file_size_bytes"),
        F.lit(None).cast("timestamp").alias("modified_at"),
    )


def intake_manifest(
    files: DataFrame,
    received: Column,
    max_bytes: int = MAX_UPLOAD_BYTES,
    job_id: Column | None = None,
) -> DataFrame:
    """Accept or refuse every listed file and give the accepted ones their job id and keys.

    The id follows from the path and the time the file was last written (the time of receipt where a listing has none), so
    a replay gives the same file the same id.
    """
    named = files.withColumns({"inbound_file_name": base_name("file_path"), "received_at": received})
    reason = refusal("inbound_file_name", "file_size_bytes", max_bytes)
    uid = job_id if job_id is not None else report_uid("file_path", F.coalesce("modified_at", "received_at"))
    return (
        named.withColumn("refusal", reason)
        .withColumn("accepted", F.col("refusal").isNull())
        .withColumn("report_uid", F.when(F.col("accepted"), uid))
        .withColumn("file_format", F.ltrim(extension("inbound_file_name"), F.lit(".")))
        .withColumn("folder_prefix", folder_prefix("report_uid", "received_at"))
        .withColumn("source_key", source_key("report_uid", "inbound_file_name", "received_at"))
        .withColumn("summary_key", summary_key("report_uid", "received_at"))
    )


def intake_metadata_json(manifest: DataFrame) -> DataFrame:
    """The eight-field JSON record of every accepted file."""
    record = F.struct(
        F.col("report_uid").alias("ReportUid"),
        F.col("inbound_file_name").alias("InboundFileName"),
        F.col("file_size_bytes").alias("FileSizeBytes"),
        F.col("file_format").alias("FileFormat"),
        F.col("folder_prefix").alias("S3FolderPath"),
        F.col("source_key").alias("SourceFilePath"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("UploadedAtUtc"),
        F.lit("Uploaded").alias("Status"),
    )
    return manifest.where("accepted").select(
        F.col("report_uid").alias("job_id"), "summary_key", F.to_json(record).alias("document")
    )


def started_jobs(manifest: DataFrame) -> DataFrame:
    """Job records of newly accepted files."""
    values = {
        "job_id": F.col("report_uid"),
        "report_uid": F.col("report_uid"),
        "inbound_file_name": F.col("inbound_file_name"),
        "file_size_bytes": F.col("file_size_bytes"),
        "file_format": F.col("file_format"),
        "s3_folder_path": F.col("folder_prefix"),
        "source_file_path": F.col("file_path"),
        "metadata_json_path": F.col("summary_key"),
        "archived_file_path": F.col("source_key"),
        "processing_summary_path": F.col("summary_key"),
        "uploaded_by": F.lit("system"),
        "user_name": F.lit("system"),
        "started_by": F.lit("system"),
        "start_timestamp_utc": F.col("received_at"),
        "status": F.lit("Started"),
        "trigger_type": F.lit("Manual"),
        "ingestion_mode": F.lit("Full"),
    }
    return manifest.where("accepted").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA]
    )
