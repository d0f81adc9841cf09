"""The access paths of the stored tables as parameterised queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.tables import key_of


def _between(df: DataFrame, c: str, start: Column | None, end: Column | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(c) >= start)
    return df.where(F.col(c) < end) if end is not None else df


def findings_by(
    findings: DataFrame, column: str, value: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Findings with one value in an indexed column inside a load-date range.

    Equality and range both reach the Parquet scan.
    """
    return _between(findings.where(F.col(column) == value), "load_date_utc", start, end)


def jobs_by_status(
    jobs: DataFrame, status: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Jobs in one status that started inside a range."""
    return _between(jobs.where(F.col("status") == status), "start_timestamp_utc", start, end)


def rejected_by_job(
    rejected: DataFrame, job_id: str, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Rejected rows of one job inside an error-date range."""
    return _between(rejected.where(key_of("job_id") == job_id.lower()), "error_date_utc", start, end)


def latest_per_source_record(findings: DataFrame, tie: str = "id") -> DataFrame:
    """Newest version of every source record.

    ``max_by`` combines map-side, so a record with very many versions costs one row per
    task in the shuffle where a ranking window would put them all into one task.
    """
    newest = F.max_by(F.struct(*findings.columns), F.struct("load_date_utc", tie))
    grouped = findings.where(F.col("source_record_id").isNotNull()).groupBy("source_record_id")
    return grouped.agg(newest.alias("r"), F.count("*").alias("versions")).select("r.*", "versions")


def status_history(
    rows: DataFrame,
    key: str,
    at: str,
    status: str,
    tie: str,
    bucket: Column | None = None,
) -> DataFrame:
    """Every change of status per key over time, with the status before it.

    Rows are compared inside (key, time bucket); the first row of a bucket is compared with
    the last row of the key's previous bucket, which comes from a per-bucket aggregate.  So
    no task ever holds all rows of a busy key.  ``bucket`` defaults to the hour.
    """
    bucket = F.date_trunc("hour", at) if bucket is None else bucket
    sliced = rows.withColumn("_bucket", bucket)
    last = sliced.groupBy(key, "_bucket").agg(F.max_by(status, F.struct(at, tie)).alias("_last"))
    carried = last.select(
        key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried")
    )
    previous = F.lag(status).over(Window.partitionBy(key, "_bucket").orderBy(at, tie))
    first = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(at, tie)) == 1
    compared = sliced.join(carried, [key, "_bucket"]).withColumn(
        "previous_status", F.when(first, F.col("_carried")).otherwise(previous)
    )
    return compared.where(~F.col(status).eqNullSafe(F.col("previous_status"))).drop("_bucket", "_carried")
