"""Per-job summary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import json_date
from sievework.layout import pascal

# Document field -> job column.
SUMMARY_FIELDS = [
    ("JobId", "job_id"),
    ("InboundFileName", "inbound_file_name"),
    ("SourceSystem", "source_system"),
    ("TriggerType", "trigger_type"),
    ("IngestionMode", "ingestion_mode"),
    ("StartedAtUtc", "start_timestamp_utc"),
    ("CompletedAtUtc", "end_timestamp_utc"),
    ("ProcessingStartTimeUtc", "start_timestamp_utc"),
    ("ProcessingEndTimeUtc", "end_timestamp_utc"),
    ("PayloadRecordCount", "payload_record_count"),
    ("TotalRowsProcessed", "total_records"),
    ("SuccessfulRows", "success_count"),
    ("FailedRows", "reject_count"),
    ("ValidationFailureCount", "validation_failure_count"),
    ("BatchSize", "batch_size"),
    ("TotalBatches", "total_batches"),
    ("PersistedBatchCount", "persisted_batch_count"),
    ("LastSuccessfulBatchNumber", "last_successful_batch_number"),
    ("LastProcessedRecordCount", "last_processed_record_count"),
    ("CheckpointingEnabled", "checkpointing_enabled"),
    ("BatchPersistenceRetryCount", "batch_persistence_retry_count"),
    ("MaxBatchPersistenceRetryCount", "max_batch_persistence_retry_count"),
    ("WorkingFileFormat", "working_file_format"),
    ("WorkingFilePath", "working_file_path"),
    ("WorkingFileRecordCount", "working_file_record_count"),
    ("IsResumeEligible", "is_resume_eligible"),
    ("LastCheckpointUtc", "last_checkpoint_utc"),
    ("CheckpointMessage", "checkpoint_message"),
    ("FinalJobStatus", "status"),
    ("Message", "message"),
    ("ArchivedFilePath", "archived_file_path"),
]


def summary_documents(jobs: DataFrame) -> DataFrame:
    """One JSON document per job; its rejected rows follow as list parts."""
    types = dict(jobs.dtypes)
    fields = []
    for label, name in SUMMARY_FIELDS:
        c = F.col(name) if name in types else F.lit(None).cast("string")
        fields.append((json_date(c) if types.get(name) == "timestamp" else c).alias(label))
    return jobs.select(
        "job_id", F.lit(0).cast("bigint").alias("part"), F.to_json(F.struct(*fields)).alias("document")
    )


def rejected_documents(lists: DataFrame) -> DataFrame:
    """The rejected rows of a job as JSON list parts; together they are the whole list."""
    entry = F.transform(
        "rejected_rows",
        lambda r: F.struct(
            *[
                (json_date(r[n]) if n == "error_date_utc" else r[n]).alias(pascal(n))
                for n in (
                    "rejected_row_id",
                    "source_record_id",
                    "finding_file_name",
                    "finding_type",
                    "user_name",
                    "row_number",
                    "field_name",
                    "rejected_value",
                    "error_reason",
                    "error_category",
                    "error_date_utc",
                    "raw_row_json",
                )
            ]
        ),
    )
    return lists.select("job_id", (F.col("part") + 1).alias("part"), F.to_json(F.struct(entry.alias("RejectedRows"))).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Write documents as text lines under their job; only these jobs are replaced.

    A job is a file of its own, so a small table of many jobs is dealt over all tasks: one task would open them one by one.
    """
    tasks = documents.sparkSession.sparkContext.defaultParallelism
    documents.select("job_id", "document").repartition(tasks, "job_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("job_id").text(path)


# Rejected records beyond which a list is no longer kept as plain text, about a megabyte of it.
LONG_LIST = 1000


def write_rejected_documents(documents: DataFrame, path: str, packed: bool) -> None:
    """As :func:`write_documents`, for list parts: each task writes the parts it has made, which are too long to be dealt anew.

    ``packed`` lists are gzip files; readers go by the name.
    """
    documents.select("job_id", "document").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "gzip" if packed else "none"
    ).partitionBy("job_id").text(path)


def read_documents(spark, path: str) -> DataFrame:
    return spark.read.schema("document STRING, job_id STRING").option("basePath", path).text(path)
