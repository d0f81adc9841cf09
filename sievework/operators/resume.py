"""Checkpoints, resume and retry as columns and small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import col, first_not_blank, is_blank
from sievework.layout import AUDIT_SCHEMA, CHECKPOINT_SCHEMA
from sievework.operators.numbering import batch_count, batch_number
from sievework.operators.tables import key_of

# Failures worth another attempt.
RETRYABLE = ["io", "timeout", "invalid_operation"]
NOT_ELIGIBLE = "The job cannot be resumed."


def resume_eligible(status: Column | str, success: Column | str, processed: Column | str, flag: Column | str) -> Column:
    """A failed job with valid rows left to write, or one that was marked by hand."""
    left = (col(success) > 0) & (col(processed) < col(success))
    return (col(status) == "Failed") & (left | F.coalesce(col(flag), F.lit(False)))


def eligible_now() -> Column:
    """:func:`resume_eligible` over a checkpoint row."""
    return resume_eligible("status", "success_count", "last_processed_record_count", "is_resume_eligible")


def resume_state(checkpoints: DataFrame, batch_size: int, max_retries: int, now: Column) -> DataFrame:
    """Starting state of a resume; batch size and total fall back to the configuration."""
    size = F.when(F.col("batch_size") > 0, F.col("batch_size")).otherwise(F.lit(batch_size).cast("bigint"))
    total = F.col("success_count") + F.col("reject_count")
    sized = checkpoints.withColumn("batch_size", size)
    return sized.withColumns(
        {
            "total_batches": F.when(F.col("total_batches") > 0, F.col("total_batches")).otherwise(
                batch_count(F.col("success_count"), F.col("batch_size"))
            ),
            "trigger_type": F.lit("Resume"),
            "is_resume_eligible": eligible_now(),
            "started_at_utc": now,
            "total_records": total,
            "payload_record_count": total,
            "validation_failure_count": F.col("reject_count"),
            "max_batch_persistence_retry_count": F.lit(max_retries).cast("bigint"),
            "checkpoint_message": F.concat(
                F.lit("Resuming with batch "),
                (F.col("last_successful_batch_number") + 1).cast("string"),
                F.lit("."),
            ),
        }
    ).withColumn("status", F.lit("Started"))


def not_eligible_result(checkpoints: DataFrame, now: Column) -> DataFrame:
    """Echo of the checkpoints that cannot be resumed; nothing is processed."""
    total = F.col("success_count") + F.col("reject_count")
    return checkpoints.where(~eligible_now()).withColumns(
        {
            "trigger_type": F.lit("Resume"),
            "is_resume_eligible": F.lit(False),
            "total_records": total,
            "started_at_utc": now,
            "completed_at_utc": now,
            "checkpoint_message": F.col("failure_reason"),
            "message": F.lit(NOT_ELIGIBLE),
        }
    )


def resume_job_records(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """Combine the resume state with the job record; a missing record is built from the state."""
    record = jobs.select([F.col(c).alias(f"a_{c}") for c in jobs.columns])
    joined = state.join(record, key_of("job_id") == key_of("a_job_id"), "left")
    path = first_not_blank("working_file_path", "a_working_file_path")
    fmt = first_not_blank("working_file_format", "a_working_file_format")
    rows = F.greatest(F.col("working_file_record_count"), F.coalesce("a_working_file_record_count", F.lit(0)))
    cols = {
        "job_id": F.coalesce("a_job_id", "job_id"),
        "report_uid": F.coalesce("a_report_uid", "job_id"),
        "inbound_file_name": F.coalesce("a_inbound_file_name", "inbound_file_name"),
        "file_format": F.coalesce("a_file_format", F.lit("")),
        "s3_folder_path": F.coalesce("a_s3_folder_path", F.lit("")),
        "source_file_path": F.coalesce("a_source_file_path", F.lit("")),
        "metadata_json_path": F.coalesce("a_metadata_json_path", F.lit("")),
        "archived_file_path": F.coalesce("a_archived_file_path", "a_source_file_path"),
        "processing_summary_path": F.coalesce("a_processing_summary_path", "a_metadata_json_path"),
        "file_size_bytes": F.coalesce("a_file_size_bytes", F.lit(0)),
        "uploaded_by": F.coalesce("a_uploaded_by", "user_name"),
        "user_name": F.coalesce("a_user_name", "user_name"),
        "started_by": F.coalesce("a_started_by", "user_name"),
        "start_timestamp_utc": F.col("started_at_utc"),
        "end_timestamp_utc": F.col("a_end_timestamp_utc"),
        "error_message": F.col("a_error_message"),
        "failure_reason": F.col("a_failure_reason"),
        "source_system": F.coalesce("a_source_system", "source_system"),
        "finding_type_counts": F.col("a_finding_type_counts"),
        "checkpointing_enabled": F.lit(True),
        "working_file_path": path,
        "working_file_format": fmt,
        "working_file_record_count": rows,
    }
    return joined.select(
        *[cols.get(f.name, F.col(f.name) if f.name in state.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in AUDIT_SCHEMA]
    )


def resume_source(
    parquet_enabled: Column,
    fmt: Column,
    path: Column,
    recorded_rows: Column,
    parquet_rows_after: Column,
    staged_rows: Column,
    staged_rows_after: Column,
    last: Column,
    success: Column,
) -> Column:
    """Where the remaining rows of a job come from.

    ``parquet_rows_after`` is null when the working copy cannot be read.
    """
    candidate = parquet_enabled & (F.lower(fmt) == "parquet") & ~is_blank(path) & (recorded_rows > 0)
    usable = candidate & parquet_rows_after.isNotNull() & ((parquet_rows_after > 0) | (last >= recorded_rows))
    return (
        F.when(F.coalesce(usable, F.lit(False)), F.lit("parquet"))
        .when(F.coalesce(staged_rows, F.lit(0)) == 0, F.lit("error_no_data"))
        .when((F.coalesce(staged_rows_after, F.lit(0)) == 0) & (last < success), F.lit("error_no_rows_left"))
        .otherwise(F.lit("staging"))
    )


def remaining_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows past the saved position; numbering goes on after the last good batch.

    ``state`` has one row per job: ``job_id``, ``last_processed_record_count``,
    ``last_successful_batch_number``, ``batch_size``.
    """
    position = state.select(
        F.col("job_id"),
        F.col("last_processed_record_count").alias("_last"),
        F.col("last_successful_batch_number").alias("_batch"),
        F.col("batch_size").alias("_size"),
    )
    joined = rows.drop("batch_number").join(position, "job_id").where("sequence_number > _last")
    return joined.withColumn(
        "batch_number", F.col("_batch") + batch_number(F.col("sequence_number") - F.col("_last"), F.col("_size"))
    ).drop("_last", "_batch", "_size")


def resumed_status(rejected: Column) -> Column:
    """Status of a job after a complete resume."""
    return F.when(rejected > 0, F.lit("PartialSuccess")).otherwise(F.lit("Success"))


def checkpoint_rows(state: DataFrame, status: Column, now: Column, failure: Column | None = None) -> DataFrame:
    """Checkpoint of a job state, ready to be merged."""
    failed = status == "Failed"
    left = (F.col("success_count") > 0) & (F.col("last_processed_record_count") < F.col("success_count"))
    values = {
        "status": status,
        "is_resume_eligible": failed & left,
        "failure_reason": failure if failure is not None else F.lit(None),
        "created_at_utc": now,
        "last_checkpoint_utc": now,
    }
    return state.select(
        *[
            values.get(f.name, F.col(f.name) if f.name in state.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CHECKPOINT_SCHEMA
        ]
    )


def checkpoint_message(eligible: Column, processed: Column) -> Column:
    """Progress text that goes with a checkpoint."""
    return F.when(
        eligible, F.concat(F.lit("Stopped behind record "), processed.cast("string"), F.lit("."))
    ).otherwise(F.lit("Checkpoint written."))


def working_store(enabled: Column, primary: Column, fallback: Column, parquet_failed: Column, rows: Column) -> Column:
    """Which working stores a job gets: parquet, staging, both, none or error."""
    parquet_ok = enabled & ~parquet_failed
    return (
        F.when(rows <= 0, F.lit("none"))
        .when(~primary & parquet_ok, F.lit("both"))
        .when(~primary, F.lit("staging"))
        .when(parquet_ok, F.lit("parquet"))
        .when(fallback, F.lit("staging"))
        .otherwise(F.lit("error"))
    )


def retry_outcome(kind: Column, failures: Column, max_retries: Column) -> dict[str, Column]:
    """Attempts, retries and outcome of a write that fails a number of times."""
    again = kind.isin(RETRYABLE)
    allowed = F.when(again, F.greatest(max_retries, F.lit(0))).otherwise(F.lit(0))
    retries = F.least(failures, allowed)
    return {
        "retry_count": retries.cast("bigint"),
        "attempts": (retries + 1).cast("bigint"),
        "succeeded": failures <= allowed,
    }


def failed_state(state: DataFrame, message: Column, now: Column) -> DataFrame:
    """Job rows after an error: failed, with the reason, still resumable while rows are left."""
    left = (F.col("success_count") > 0) & (F.col("last_processed_record_count") < F.col("success_count"))
    return state.withColumns(
        {
            "status": F.lit("Failed"),
            "error_message": message,
            "failure_reason": message,
            "end_timestamp_utc": now,
            "source_system": F.coalesce("source_system", F.lit("Unknown")),
            "is_resume_eligible": left,
            "checkpoint_message": checkpoint_message(left, F.col("last_processed_record_count")),
        }
    )


def merged_job_records(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Overlay results on job records.

    Every column of ``results`` replaces the record's value, except that a null path keeps the
    old path and an empty count map keeps the old counts.
    """
    keep_old = {"source_file_path", "metadata_json_path", "inbound_file_name", "uploaded_by", "user_name", "started_by"}
    new = results.select([F.col(c).alias(f"n_{c}") for c in results.columns])
    joined = jobs.join(new, key_of("job_id") == key_of("n_job_id"), "inner")
    cols = []
    for f in AUDIT_SCHEMA:
        n, old = f"n_{f.name}", F.col(f.name)
        if n not in new.columns or f.name == "job_id":
            cols.append(old.cast(f.dataType).alias(f.name))
        elif f.name == "finding_type_counts":
            cols.append(F.when(F.size(n) > 0, F.col(n)).otherwise(old).alias(f.name))
        elif f.name in keep_old:
            cols.append(F.coalesce(F.col(n), old).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(n).cast(f.dataType).alias(f.name))
    return joined.select(*cols)


def cleanup_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs whose staged rows are no longer needed."""
    return jobs.where(F.col("status").isin("Success", "PartialSuccess")).select("job_id")
