"""Per-job counts, source system, status and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import null_if_blank
from sievework.layout import REJECTED_BATCH_SIZE


# The big aggregates below keep only numbers in their buffers (counts, smallest record number)
# and group by the texts themselves: such aggregates run hash-based, while a text in a buffer
# would make Spark sort all rows first.  Texts are picked in a second, tiny aggregate.
# Invalid and blank rows are told apart by a condition inside the aggregate; a filter would be
# pushed below the typed projection and repeat its parsing.


def finding_type_counts(checked: DataFrame) -> DataFrame:
    """Valid rows per finding type, any case, labelled with the first spelling seen."""
    valid = F.col("is_valid")
    spelled = checked.groupBy("job_id", F.when(valid, F.col("finding_type")).alias("_type")).agg(
        F.count_if(valid).alias("_n"), F.min("row_number").alias("_at")
    )
    return (
        spelled.where("_n > 0")
        .groupBy("job_id", F.lower("_type").alias("_key"))
        .agg(F.min_by("_type", "_at").alias("finding_type"), F.sum("_n").alias("row_count"))
        .drop("_key")
    )


def record_counts(checked: DataFrame) -> DataFrame:
    """Rows (not errors) per job that passed, failed, and together; blank rows do not count."""
    return checked.groupBy("job_id").agg(
        F.count_if("is_valid").alias("success_count"),
        F.count_if(_rejected()).alias("reject_count"),
        F.count_if(~F.col("blank")).alias("total_records"),
    )


def _rejected() -> Column:
    return ~F.col("is_valid") & ~F.col("blank")


def source_systems(checked: DataFrame) -> DataFrame:
    """Originating system per job: Unknown, the one there is, or Multiple.

    Smallest and largest lower-cased name tell one from many, so no distinct set is built.
    """
    spelled = checked.groupBy("job_id", _system().alias("_system")).agg(F.min("row_number").alias("_at"))
    return spelled.groupBy("job_id").agg(*_system_parts()).select("job_id", _system_label().alias("source_system"))


def _system() -> Column:
    return F.when(~F.col("malformed"), null_if_blank("originating_data_system"))


def _system_parts() -> list[Column]:
    named_at = F.when(F.col("_system").isNotNull(), F.col("_at"))
    return [
        F.min(F.lower("_system")).alias("_low"),
        F.max(F.lower("_system")).alias("_high"),
        F.min_by("_system", named_at).alias("_first"),
    ]


def _system_label() -> Column:
    return (
        F.when(F.col("_low").isNull(), F.lit("Unknown"))
        .when(F.col("_low") == F.col("_high"), F.col("_first"))
        .otherwise(F.lit("Multiple"))
    )


def job_status(success: Column, rejected: Column) -> Column:
    """Outcome of a job from its counts; a job without rows has failed."""
    return (
        F.when((success > 0) & (rejected == 0), F.lit("Success"))
        .when(success > 0, F.lit("PartialSuccess"))
        .otherwise(F.lit("Failed"))
    )


def job_message(status: Column, success: Column, rejected: Column) -> Column:
    """Sentence that goes with the outcome."""
    partial = F.format_string(
        "Taken in: %d rows; turned down: %d rows.", success, rejected
    )
    return (
        F.when(status == "Success", F.lit("All rows were taken in."))
        .when(status == "PartialSuccess", partial)
        .when(status == "Failed", F.lit("No row was fit to be taken in."))
        .otherwise(F.lit("The run has ended."))
    )


def response_class(status: Column, total: Column) -> Column:
    """Was there nothing readable at all?"""
    return F.when((status == "Failed") & (total == 0), F.lit("unprocessable")).otherwise(F.lit("ok"))


def job_totals(checked: DataFrame) -> DataFrame:
    """All per-job aggregates from one pass over the checked rows.

    Rows are first grouped by job, finding type of valid rows, and system: few groups, combined
    map-side, so a hot job is already tiny when it is shuffled.
    """
    valid = F.col("is_valid")
    spelled = checked.groupBy(
        "job_id", F.when(valid, F.col("finding_type")).alias("_type"), _system().alias("_system")
    ).agg(
        F.count_if(valid).alias("_ok"),
        F.count_if(_rejected()).alias("_bad"),
        F.min("row_number").alias("_at"),
        F.sum("coerced_null_fields").alias("_coerced"),
    )
    by_type = spelled.groupBy("job_id", F.lower("_type").alias("_kind")).agg(
        F.min_by("_type", "_at").alias("_type"),
        F.sum("_ok").alias("_ok"),
        F.sum("_bad").alias("_bad"),
        F.min(F.lower("_system")).alias("_low"),
        F.max(F.lower("_system")).alias("_high"),
        F.min(F.when(F.col("_system").isNotNull(), F.struct("_at", "_system"))).alias("_first_at"),
        F.sum("_coerced").alias("_coerced"),
    )
    # At most one entry per allowed finding type.
    entries = F.collect_list(F.when(F.col("_kind").isNotNull(), F.struct("_type", "_ok")))
    return (
        by_type.groupBy("job_id")
        .agg(
            F.sum("_ok").alias("success_count"),
            F.sum("_bad").alias("reject_count"),
            F.min("_low").alias("_low"),
            F.max("_high").alias("_high"),
            F.min("_first_at").getField("_system").alias("_first"),
            F.map_from_entries(F.array_sort(entries)).alias("finding_type_counts"),
            F.sum("_coerced").alias("coerced_null_fields"),
        )
        .select(
            "job_id",
            "success_count",
            "reject_count",
            (F.col("success_count") + F.col("reject_count")).alias("total_records"),
            _system_label().alias("source_system"),
            "finding_type_counts",
            "coerced_null_fields",
        )
    )


def rejected_lists(rejected: DataFrame, chunk_rows: int = REJECTED_BATCH_SIZE) -> DataFrame:
    """Rejected rows nested for the job summary, in row and rule order.

    A job's list is cut into parts of ``chunk_rows`` consecutive record numbers.  Every
    rejected row is in exactly one part; no part grows with the job.
    """
    entry = F.struct(
        "row_number",
        "rule_id",
        "rejected_row_id",
        "source_record_id",
        "finding_file_name",
        "finding_type",
        "user_name",
        "field_name",
        "rejected_value",
        "error_reason",
        "error_category",
        "error_date_utc",
        "raw_row_json",
    )
    part = F.floor(F.col("row_number") / chunk_rows).cast("bigint")
    return rejected.groupBy("job_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("rejected_rows")
    )
