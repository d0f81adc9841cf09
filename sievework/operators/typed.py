"""Inbound text rows -> typed findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import status as st
from sievework.functions.paths import row_id
from sievework.functions.text import (
    clean_text,
    digits_overflow,
    json_date,
    long_from_digits,
    signed_digits,
    timestamp_from_trimmed,
    utc_text,
)
from sievework.layout import DATES, FINDING_SCHEMA, OPTIONAL_TEXT, RAW_COLUMNS, REQUIRED_TEXT, SIZE, pascal

# A row with nothing in any of these columns is skipped.
BLANK_TEST_TEXT = [
    "source_record_id",
    "finding_file_name",
    "finding_file_format",
    "current_file_location",
    "finding_type",
    "originating_data_system",
    "originating_vendor_tool",
    "original_file_location",
    "site_owner",
    "file_owner",
]
BLANK_TEST_TYPED = ["finding_file_size_bytes", "quarantine_date_utc"]

# Order of the fields in the raw-row JSON.
RAW_JSON_FIELDS = [
    "source_record_id",
    "finding_file_name",
    "finding_file_format",
    "finding_file_size_bytes",
    "current_file_location",
    "finding_type",
    "data_system",
    "originating_data_system",
    "originating_vendor_tool",
    "original_file_location",
    "quarantine_date_utc",
    "last_modified_date_utc",
    "created_date_utc",
    "last_accessed_date_utc",
    "site_owner",
    "file_owner",
    "business_unit",
    "division",
    "department",
    "region",
    "country",
    "policy_name",
    "policy_id",
    "finding_reason",
    "risk_level",
    "sensitivity_label",
    "detection_date_utc",
    "recommended_action",
    "restoration_ticket_identifier",
    "restoration_requestor_email",
    "restoration_comment",
]


def with_all_raw_columns(df: DataFrame) -> DataFrame:
    """Add the known columns a report does not have, as empty text."""
    return df.withColumns({c: F.lit("") for c in RAW_COLUMNS if c not in df.columns})


def _lineage(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def typed_findings(df: DataFrame, load_time: Column | None = None) -> DataFrame:
    """One projection from inbound text to the finding layout.

    ``df`` carries ``job_id``, ``row_number`` and any of the known text columns; lineage
    columns (``inbound_file_name``, ``user_name``, ``load_date_utc``, ``malformed``) are
    used when present.  An ``exception_date`` text column is honoured when a caller
    supplies one, although no inbound header feeds it.
    """
    extra = [c for c in ("file_path", "block_start", "line_id") if c in df.columns]
    loaded = _lineage(df, "load_date_utc", load_time if load_time is not None else F.current_timestamp())
    df = with_all_raw_columns(df)
    exception = ["exception_date"] if "exception_date" in df.columns else []
    # First trim every text once; the parsers below look at each value several times.
    trimmed = df.select(
        "job_id",
        "row_number",
        *extra,
        row_id("job_id", "row_number").alias("id"),
        _lineage(df, "source_file_name", F.concat("job_id", F.lit(".csv"))).alias("inbound_file_name"),
        _lineage(df, "user_name", F.lit("system")).alias("user_name"),
        loaded.alias("load_date_utc"),
        _lineage(df, "malformed", F.lit(False)).alias("malformed"),
        *[clean_text(c).alias(f"_{c}") for c in RAW_COLUMNS + exception],
        signed_digits(SIZE[1]).alias("_digits"),
    )
    null = F.lit(None)
    cols: dict[str, Column] = {
        "id": F.col("id"),
        "record_version_id": F.lit(1),
        "ingestion_job_id": F.col("job_id"),
        "inbound_file_name": F.col("inbound_file_name"),
        "user_name": F.col("user_name"),
        "load_date_utc": F.col("load_date_utc"),
        "last_update_date_utc": F.col("load_date_utc"),
        SIZE[0]: long_from_digits("_digits"),
        "error_category": null.cast("string"),
        "exception_date_utc": timestamp_from_trimmed("_exception_date") if exception else null.cast("timestamp"),
        "restored_date_utc": null.cast("timestamp"),
        "deleted_date_utc": null.cast("timestamp"),
        "status": st.initial_status("_finding_type"),
        "status_text": st.initial_status_text("_finding_type"),
    }
    cols |= {out: F.col(f"_{raw}") for out, raw in REQUIRED_TEXT.items()}
    cols |= {out: F.nullif(F.col(f"_{raw}"), F.lit("")) for out, raw in OPTIONAL_TEXT.items()}
    cols |= {out: timestamp_from_trimmed(f"_{raw}") for out, raw in DATES.items()}
    kept = [f"_{raw}" for raw in [SIZE[1], *DATES.values()]]
    parsed = trimmed.select(
        "job_id",
        "row_number",
        *extra,
        *[cols[f.name].alias(f.name) for f in FINDING_SCHEMA if f.name in cols],
        "malformed",
        "_digits",
        *kept,
    )
    unread = [F.when((F.col(f"_{raw}") != "") & F.col(out).isNull(), 1).otherwise(0) for out, raw in [SIZE, *DATES.items()]]
    return parsed.withColumns(
        {
            "malformed": F.col("malformed") | F.coalesce(digits_overflow("_digits", SIZE[0]), F.lit(False)),
            # Size and date texts that were given but could not be read.
            "coerced_null_fields": reduce(lambda a, b: a + b, unread),
        }
    ).drop("_digits", *kept)


def blank_row() -> Column:
    """True where a typed row (already trimmed) has nothing in any of the twelve tested columns."""
    tests = [F.coalesce(F.col(c), F.lit("")) == "" for c in BLANK_TEST_TEXT]
    tests += [F.col(c).isNull() for c in BLANK_TEST_TYPED]
    return reduce(lambda a, b: a & b, tests)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Skip blank rows of a checked (best: written) table; they are counted nowhere."""
    return df.where("NOT blank")


def raw_row_json() -> Column:
    """JSON of a rejected row: 31 fields in fixed order, nulls left out, empty texts kept."""
    fields = []
    for name in RAW_JSON_FIELDS:
        # The data-system field repeats the originating system (both names share one value).
        c = F.col("originating_data_system" if name == "data_system" else name)
        fields.append((json_date(c) if name in DATES else c).alias(pascal(name)))
    return F.to_json(F.struct(*fields))


def compat_view(df: DataFrame) -> DataFrame:
    """The findings under their older names, with the older defaults."""
    return df.select(
        "id",
        F.coalesce("error_reason", F.lit("")).alias("error_reason"),
        F.col("finding_file_name").alias("file_name"),
        F.col("current_file_location").alias("file_path"),
        F.col("originating_data_system").alias("source_system"),
        F.coalesce("finding_file_size_bytes", F.lit(0)).alias("file_size"),
        st.quarantine_path("status", "current_file_location").alias("quarantine_path"),
        F.coalesce("last_modified_date_utc", F.lit("0001-01-01 00:00:00").cast("timestamp")).alias(
            "last_modified_date"
        ),
        F.col("ingestion_job_id").alias("ingestion_id"),
        F.coalesce("user_name", F.lit("System")).alias("uploaded_by"),
        F.col("load_date_utc").alias("load_date"),
        F.col("last_update_date_utc").alias("updated_date"),
        F.col("quarantine_date_utc").alias("quarantine_date"),
        F.col("originating_data_system").alias("data_system"),
    )


# Columns of the all-text interchange layout, in order.
TEXT_LAYOUT = [
    "id",
    "record_version_id",
    "source_record_id",
    "ingestion_job_id",
    "inbound_file_name",
    "user_name",
    "load_date_utc",
    "last_update_date_utc",
    "finding_file_name",
    "finding_file_format",
    "finding_file_size_bytes",
    "current_file_location",
    "finding_type",
    "source_system_platform",
    "originating_data_system",
    "originating_vendor_tool",
    "status",
    "status_text",
    "error_category",
    "error_reason",
    "last_modified_date_utc",
    "created_date_utc",
    "last_accessed_date_utc",
    "detection_date_utc",
    "site_owner",
    "file_owner",
    "business_unit",
    "division",
    "department",
    "region",
    "country",
    "policy_name",
    "policy_id",
    "finding_reason",
    "risk_level",
    "sensitivity_label",
    "recommended_action",
    "original_file_location",
    "quarantine_date_utc",
    "restored_date_utc",
    "exception_date_utc",
    "deleted_date_utc",
    "restoration_ticket_identifier",
    "restoration_requestor_email",
    "restoration_comment",
]
_KEPT_EMPTY = {"record_version_id", "inbound_file_name", "error_reason", *REQUIRED_TEXT}


def to_text_layout(findings: DataFrame) -> DataFrame:
    """Findings as 45 text columns with ISO dates, for interchange."""
    dates = {f.name for f in FINDING_SCHEMA if f.dataType.typeName() == "timestamp"}
    return findings.select(
        *[(utc_text(c) if c in dates else F.col(c).cast("string")).alias(c) for c in TEXT_LAYOUT]
    )


def from_text_layout(rows: DataFrame, now: Column) -> DataFrame:
    """Typed findings from the text layout.

    Dates that are no date become null (``now`` for the two load dates), a blank user becomes
    ``System``, and the status text wins over the status.
    """
    dates = {f.name for f in FINDING_SCHEMA if f.dataType.typeName() == "timestamp"}
    text = F.when(clean_text("status_text") == "", F.col("status")).otherwise(F.col("status_text"))
    cols = {}
    for c in TEXT_LAYOUT:
        if c in dates:
            value = F.col(c).try_cast("timestamp")
            cols[c] = F.coalesce(value, now) if c in ("load_date_utc", "last_update_date_utc") else value
        elif c in _KEPT_EMPTY:
            cols[c] = F.coalesce(F.col(c), F.lit(""))
        else:
            cols[c] = F.nullif(clean_text(c), F.lit(""))
    cols["id"] = F.col("id")
    cols["record_version_id"] = F.coalesce(F.col("record_version_id").try_cast("int"), F.lit(1))
    cols["finding_file_size_bytes"] = F.col("finding_file_size_bytes").try_cast("bigint")
    cols["user_name"] = F.when(clean_text("user_name") == "", F.lit("System")).otherwise(F.col("user_name"))
    cols["status"] = st.stored_status(text)
    cols["status_text"] = F.when(clean_text(text) == "", st.stored_status(text)).otherwise(text)
    return rows.select(*[value.alias(c) for c, value in cols.items()])
