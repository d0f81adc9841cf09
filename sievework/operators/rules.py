"""Row validation: a registry of rules evaluated as one bit mask per row.

A rule is a boolean column expression that says when a row fails.  All rules run on every
row; the result is one BIGINT whose bit *i* is rule *i*.  Rows travel with this small number
instead of an array of error structs, and the errors are only spelled out for rejected rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.classify import validation_category
from sievework.functions.paths import row_id
from sievework.functions.text import is_blank, one_of, round_trip_text, utf16_length
from sievework.layout import (
    DATA_SYSTEMS,
    FINDING_TYPES,
    MALFORMED_FIELD,
    REJECTED_SCHEMA,
    RISK_LEVELS,
    pascal,
)
from sievework.operators.typed import blank_row, raw_row_json

MAX_RULES = 63


@dataclass(frozen=True)
class Rule:
    """One check: ``fails(as_of)`` is the condition under which a row is rejected."""

    id: str
    field: str
    message: str
    fails: Callable[[Column], Column]
    shows_value: bool = True

    @property
    def field_name(self) -> str:
        return pascal(self.field)

    def rejected_value(self) -> Column:
        if not self.shows_value:
            return F.lit(None).cast("string")
        if self.field.endswith("_date_utc"):
            return round_trip_text(self.field)
        return F.col(self.field).cast("string")


def _required(label: str) -> str:
    return f"A value for {label} is required."


def _too_long(label: str, limit: int) -> str:
    return f"{label} is longer than {limit} characters."


def _allowed(label: str, values: Sequence[str]) -> str:
    return f"{label} must be one of these: {', '.join(values)}."


def _empty(field: str) -> Column:
    # Typed texts are already trimmed, so blank means empty.
    return F.coalesce(F.col(field), F.lit("")) == ""


def _blank(field: str) -> Callable[[Column], Column]:
    return lambda as_of: _empty(field)


def _longer(field: str, limit: int) -> Callable[[Column], Column]:
    return lambda as_of: F.coalesce(utf16_length(field) > limit, F.lit(False))


def _is_type(name: str) -> Column:
    return F.coalesce(F.lower(F.col("finding_type")) == name.lower(), F.lit(False))


def _future(field: str) -> Callable[[Column], Column]:
    return lambda as_of: F.coalesce(F.col(field) > as_of + F.expr("INTERVAL 1 DAY"), F.lit(False))


def _bad_email(as_of: Column) -> Column:
    c = F.col("restoration_requestor_email")
    marks = F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit("")))
    good = (marks == 1) & ~c.startswith("@") & ~c.endswith("@")
    return ~_empty("restoration_requestor_email") & ~F.coalesce(good, F.lit(False))


DEFAULT_RULES: list[Rule] = [
    Rule("V01", "finding_file_name", _required("Finding_File_Name"), _blank("finding_file_name")),
    Rule("V02", "finding_file_name", _too_long("Finding_File_Name", 512), _longer("finding_file_name", 512)),
    Rule("V03", "finding_file_format", _required("Finding File Format"), _blank("finding_file_format")),
    Rule("V04", "finding_file_format", _too_long("Finding File Format", 50), _longer("finding_file_format", 50)),
    Rule("V05", "current_file_location", _required("Current_File_Location"), _blank("current_file_location")),
    Rule(
        "V06",
        "current_file_location",
        _too_long("Current_File_Location", 4000),
        _longer("current_file_location", 4000),
    ),
    Rule("V07", "originating_data_system", _required("Originating_Data_System"), _blank("originating_data_system")),
    Rule(
        "V08",
        "originating_data_system",
        _allowed("Originating_Data_System", DATA_SYSTEMS),
        lambda as_of: ~one_of(F.col("originating_data_system"), DATA_SYSTEMS),
    ),
    Rule("V09", "originating_vendor_tool", _required("Originating_Vendor_Tool"), _blank("originating_vendor_tool")),
    Rule(
        "V10",
        "originating_vendor_tool",
        _too_long("Originating_Vendor_Tool", 100),
        _longer("originating_vendor_tool", 100),
    ),
    Rule("V11", "finding_type", _required("Finding_Type"), _blank("finding_type")),
    Rule(
        "V12",
        "finding_type",
        f"Finding_Type has an invalid value; it may be one of: {', '.join(FINDING_TYPES)}.",
        lambda as_of: ~one_of(F.col("finding_type"), FINDING_TYPES),
    ),
    Rule(
        "V13",
        "original_file_location",
        "A quarantined finding is required to name its Original_File_Location.",
        lambda as_of: _is_type("Quarantined") & _empty("original_file_location"),
    ),
    Rule(
        "V14",
        "quarantine_date_utc",
        "A quarantined finding is required to have a Quarantine_Date.",
        lambda as_of: _is_type("Quarantined") & F.col("quarantine_date_utc").isNull(),
    ),
    Rule(
        "V15",
        "exception_date_utc",
        "An exception finding is required to have an Exception_Date.",
        lambda as_of: _is_type("Exception") & F.col("exception_date_utc").isNull(),
    ),
    Rule(
        "V16",
        "finding_file_size_bytes",
        "Finding_File_Size is a negative size.",
        lambda as_of: F.coalesce(F.col("finding_file_size_bytes") < 0, F.lit(False)),
    ),
    Rule(
        "V17",
        "last_modified_date_utc",
        "Last_Modified_Date lies more than a day ahead.",
        _future("last_modified_date_utc"),
    ),
    Rule("V18", "created_date_utc", "Created_Date lies more than a day ahead.", _future("created_date_utc")),
    Rule(
        "V19",
        "last_accessed_date_utc",
        "Last_Accessed_Date lies more than a day ahead.",
        _future("last_accessed_date_utc"),
    ),
    # The value lookup knows neither the detection date nor the risk level.
    Rule(
        "V20",
        "detection_date_utc",
        "Detection_Date lies more than a day ahead.",
        _future("detection_date_utc"),
        shows_value=False,
    ),
    Rule(
        "V21",
        "risk_level",
        _allowed("Risk_Level", RISK_LEVELS),
        lambda as_of: ~_empty("risk_level") & ~one_of(F.col("risk_level"), RISK_LEVELS),
        shows_value=False,
    ),
    Rule(
        "V22",
        "restoration_requestor_email",
        "Restoration_Requestor_Email does not look like an address.",
        _bad_email,
    ),
]


def failed_mask(as_of: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """Bit mask of failed rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules fit one mask, got {len(rules)}")
    bits = [F.when(rule.fails(as_of), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, rule in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _hit(i: int) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def validate(df: DataFrame, as_of: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add ``failed_rules``, ``is_valid`` and ``blank``.

    Malformed rows are invalid but fail no rule, and are never blank.  Blank rows are marked
    here and skipped later: a filter at this point would be pushed below the typed projection
    and parse everything twice.
    """
    masked = df.withColumn(
        "failed_rules",
        F.when(F.col("malformed"), F.lit(0).cast("bigint")).otherwise(failed_mask(as_of, rules)),
    )
    return masked.withColumns(
        {
            "is_valid": (F.col("failed_rules") == 0) & ~F.col("malformed"),
            "blank": ~F.col("malformed") & blank_row(),
        }
    )


def error_summary(rules: Sequence[Rule] = DEFAULT_RULES) -> Column:
    """All messages of a row in rule order, joined with a comma."""
    return F.array_join(
        F.array_compact(F.array(*[F.when(_hit(i), F.lit(r.message)) for i, r in enumerate(rules)])), ", "
    )


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where("is_valid").withColumn("error_reason", F.lit(""))


def rejected_records(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rejected input rows, one each, with their joined error text."""
    return df.where("NOT is_valid").withColumn("error_reason", error_summary(rules))


def explode_rejections(
    df: DataFrame, error_time: Column, rules: Sequence[Rule] = DEFAULT_RULES
) -> DataFrame:
    """One output row per failed rule of a row."""
    errors = F.array_compact(
        F.array(
            *[
                F.when(
                    _hit(i),
                    F.struct(
                        F.lit(r.id).alias("rule_id"),
                        F.lit(r.field_name).alias("field_name"),
                        r.rejected_value().alias("rejected_value"),
                        F.lit(r.message).alias("error_reason"),
                    ),
                )
                for i, r in enumerate(rules)
            ]
        )
    )
    exploded = df.where("failed_rules <> 0").select("*", F.explode(errors).alias("e"), raw_row_json().alias("raw_row_json"))
    return exploded.select(
        F.sha2(F.concat_ws("|", "id", "e.rule_id"), 256).alias("rejected_row_id"),
        "job_id",
        "inbound_file_name",
        "source_record_id",
        "finding_file_name",
        "finding_type",
        "user_name",
        "row_number",
        "e.rule_id",
        "e.field_name",
        "e.rejected_value",
        "e.error_reason",
        F.lit("Others").alias("error_category"),
        validation_category("e.error_reason").alias("resolved_category"),
        error_time.alias("error_date_utc"),
        "raw_row_json",
    )


def malformed_rejections(df: DataFrame, error_time: Column) -> DataFrame:
    """Unreadable records as rejected rows: one fixed field, no raw JSON."""
    null = F.lit(None).cast("string")
    return df.where("malformed").select(
        F.sha2(F.concat_ws("|", row_id("job_id", "row_number"), F.lit(MALFORMED_FIELD)), 256).alias("rejected_row_id"),
        "job_id",
        "inbound_file_name",
        null.alias("source_record_id"),
        null.alias("finding_file_name"),
        null.alias("finding_type"),
        "user_name",
        "row_number",
        null.alias("rule_id"),
        F.lit(MALFORMED_FIELD).alias("field_name"),
        null.alias("rejected_value"),
        F.lit("The row is not well-formed CSV.").alias("error_reason"),
        F.lit("Others").alias("error_category"),
        F.lit("MalformedInputRow").alias("resolved_category"),
        error_time.alias("error_date_utc"),
        null.alias("raw_row_json"),
    )


def rejected_rows(df: DataFrame, error_time: Column, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rule failures and malformed records in one table."""
    return explode_rejections(df, error_time, rules).unionByName(malformed_rejections(df, error_time))


def rejected_detail(df: DataFrame, as_of: Column) -> DataFrame:
    """Stored form of rejected rows: missing ids and error dates are filled."""
    filled = df.withColumns(
        {
            "rejected_row_id": F.when(
                is_blank("rejected_row_id"),
                F.sha2(F.concat_ws("|", "job_id", F.col("row_number").cast("string"), "field_name", "error_reason"), 256),
            ).otherwise(F.col("rejected_row_id")),
            "error_date_utc": F.coalesce("error_date_utc", as_of),
        }
    )
    return filled.select(*[F.col(f.name).cast(f.dataType) for f in REJECTED_SCHEMA])
