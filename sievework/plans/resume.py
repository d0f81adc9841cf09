"""Resume of failed jobs from their checkpoints, many jobs at a time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import workspace as ws
from sievework.layout import AUDIT_SCHEMA
from sievework.operators import counts as ct
from sievework.operators import resume as rs
from sievework.operators import tables as tb
from sievework.plans import ingest as ing
from sievework.plans.isolation import united


def _rows_after(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows stored, and rows past the saved position, per job.

    Partition pruning on the job and the position column are all that is read.
    """
    position = state.select("job_id", "last_processed_record_count")
    joined = rows.select("job_id", "sequence_number").join(position, "job_id")
    return joined.groupBy("job_id").agg(
        F.count("*").alias("stored"), F.count_if(F.col("sequence_number") > F.col("last_processed_record_count")).alias("after")
    )


def _readable(rows: Callable[[], DataFrame], state: DataFrame, empty: DataFrame) -> DataFrame:
    """Stored and remaining counts; a store that cannot be read counts as absent."""
    counted = _rows_after(rows(), state)
    try:
        return ws.materialise(counted, "after")
    except AnalysisException:
        raise
    except PySparkException:
        return empty


def choose_sources(store: ing.Store, state: DataFrame, options: ing.Options) -> DataFrame:
    """Add ``resume_source`` to the resume states."""
    empty = store.spark.createDataFrame([], "job_id STRING, stored BIGINT, after BIGINT")
    working = _readable(store.read_working, state, empty).select(
        "job_id", F.col("after").alias("_working_after")
    )
    staged = _readable(store.read_staged, state, empty).select(
        "job_id", F.col("stored").alias("_staged"), F.col("after").alias("_staged_after")
    )
    source = rs.resume_source(
        F.lit(options.parquet_working),
        F.col("working_file_format"),
        F.col("working_file_path"),
        F.col("working_file_record_count"),
        F.col("_working_after"),
        F.col("_staged"),
        F.col("_staged_after"),
        F.col("last_processed_record_count"),
        F.col("success_count"),
    )
    joined = state.join(working, "job_id", "left").join(staged, "job_id", "left")
    return joined.withColumn("resume_source", source).drop("_working_after", "_staged", "_staged_after")


# Texts for jobs that have nothing to resume from.
NO_DATA = {
    "error_no_data": "There is neither a Parquet copy nor a staged copy of the rows; the report has to be handed in again.",
    "error_no_rows_left": "All staged rows lie before the checkpoint; nothing is left to resume.",
}


def resume_jobs(
    store: ing.Store,
    wanted: DataFrame,
    now: datetime,
    options: ing.Options = ing.Options(),
    write_batch_group: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """Resume the wanted jobs (column ``job_id``); returns one result row per known job."""
    with ws.scratch(store.spark):
        return _resume(store, wanted, now, options, write_batch_group)


def _resume(
    store: ing.Store,
    wanted: DataFrame,
    now: datetime,
    options: ing.Options,
    write_batch_group: Callable[[DataFrame, str], None] | None,
) -> DataFrame:
    spark, at = store.spark, F.lit(now)
    ws.tune(spark)
    clock = ing.Clock(store, now.isoformat())
    checkpoints = ws.materialise(tb.lookup_jobs(store.read_checkpoints(), wanted), "checkpoints")
    refused = ws.materialise(
        rs.not_eligible_result(checkpoints, at).select("job_id", "status", "message"), "refused", keep=True
    )
    state = rs.resume_state(checkpoints.where(rs.eligible_now()), options.size, options.max_retries, at)
    known = rs.resume_job_records(state, store.read_jobs())
    state = ws.materialise(choose_sources(store, known, options), "resume_states")

    lost = state.where(F.col("resume_source").startswith("error"))
    good = state.where(~F.col("resume_source").startswith("error"))
    results = [refused]
    if not lost.isEmpty():
        reason = F.element_at(F.create_map(*[F.lit(x) for p in NO_DATA.items() for x in p]), F.col("resume_source"))
        failed = ws.materialise(
            rs.failed_state(lost, reason, at)
            .withColumn("is_resume_eligible", F.lit(False))
            .withColumn("message", F.col("failure_reason")),
            "failed",
            keep=True,
        )
        rows = rs.checkpoint_rows(failed, F.lit("Failed"), at, F.col("failure_reason"))
        store.save_checkpoints(rows.withColumn("is_resume_eligible", F.lit(False)), at)
        store.save_jobs(failed)
        results.append(failed.select("job_id", "status", "message"))
    if not good.isEmpty():
        results.append(_write_remaining(store, good, options, at, write_batch_group, clock))
    clock.save()
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _write_remaining(
    store: ing.Store,
    state: DataFrame,
    options: ing.Options,
    at: Column,
    write: Callable[[DataFrame, str], None] | None,
    clock: ing.Clock,
) -> DataFrame:
    jobs = state.select("job_id", "resume_source")
    rows = store.read_working().join(jobs.where("resume_source = 'parquet'").select("job_id"), "job_id", "left_semi")
    if not jobs.where("resume_source = 'staging'").isEmpty():
        staged = ing.from_staged(store.read_staged()).join(
            jobs.where("resume_source = 'staging'").select("job_id"), "job_id", "left_semi"
        )
        rows = rows.unionByName(staged)
    left = rs.remaining_rows(rows, state)
    done, lost = ing.write_groups(store, lambda group: left, state, options, at, write, clock, resume=True)
    results = []
    if lost:
        failed = ing.finish_failed(store, united(lost), F.col("_why"), at)
        results.append(failed.select("job_id", "status", F.concat(F.lit("Not resumed: "), "failure_reason").alias("message")))
    if done.isEmpty():
        return united(results)
    finished = ws.materialise(
        done.withColumns(
            {
                "status": rs.resumed_status(F.col("reject_count")),
                "end_timestamp_utc": at,
                "is_resume_eligible": F.lit(False),
                "checkpoint_message": F.lit("Resume finished."),
                "message": F.lit("The remaining rows were taken in."),
                "error_message": F.lit(None).cast("string"),
                "failure_reason": F.lit(None).cast("string"),
            }
        ).withColumn("response_class", ct.response_class(F.col("status"), F.col("total_records"))),
        "finished",
        keep=True,
    )
    store.save_checkpoints(rs.checkpoint_rows(finished, F.col("status"), at), at)
    store.save_jobs(rs.merged_job_records(store.read_jobs(), finished.select(*AUDIT_SCHEMA.names)))
    ing.write_summaries(store, finished)
    ing.clean_staging(store, finished)
    ing.record_events(store, finished, at, "IngestionJobResumed")
    return united([*results, finished.select("job_id", "status", "message")])
