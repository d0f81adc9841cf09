"""Every validation rule at its boundary."""

import pytest
from pyspark.sql import functions as F

from sievework.layout import FINDING_TYPES
from sievework.operators import rules as ru
from sievework.operators import typed as ty

GOOD = {
    "id": "R1",
    "finding_file_name": "a.txt",
    "finding_file_format": "txt",
    "current_file_location": "/a",
    "finding_type": "Obsolete",
    "originating_data_system": "smb",
    "originating_vendor_tool": "TLA",
}


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


CASES = [
    ({}, ""),
    ({"finding_file_name": " "}, "V01"),
    ({"finding_file_name": "n" * 512}, ""),
    ({"finding_file_name": "n" * 513}, "V02"),
    ({"finding_file_name": "\U0001f600" * 257}, "V02"),
    ({"finding_file_format": ""}, "V03"),
    ({"finding_file_format": "f" * 51}, "V04"),
    ({"current_file_location": " "}, "V05"),
    ({"current_file_location": "l" * 4001}, "V06"),
    ({"originating_data_system": ""}, "V07 V08"),
    ({"originating_data_system": "Blob"}, "V08"),
    ({"originating_vendor_tool": ""}, "V09"),
    ({"originating_vendor_tool": "v" * 101}, "V10"),
    ({"finding_type": ""}, "V11 V12"),
    ({"finding_type": "NotObsolete"}, "V12"),
    ({"finding_type": " not obsolete "}, ""),
    ({"finding_type": "QUARANTINED"}, "V13 V14"),
    ({"finding_type": "Quarantined", "original_file_location": "/o", "quarantine_date": "2025-01-01"}, ""),
    ({"finding_type": "Exception"}, "V15"),
    ({"finding_type": "Exception", "exception_date": "2025-01-01"}, ""),
    ({"finding_file_size": "-1"}, "V16"),
    ({"finding_file_size": "0"}, ""),
    ({"last_modified_date": "2026-01-02 00:00:00"}, ""),
    ({"last_modified_date": "2026-01-02 00:00:01"}, "V17"),
    ({"created_date": "2999-01-01"}, "V18"),
    ({"last_accessed_date": "2999-01-01"}, "V19"),
    ({"detection_date": "2999-01-01"}, "V20"),
    ({"risk_level": "Severe"}, "V21"),
    ({"risk_level": "critical"}, ""),
    ({"restoration_requestor_email": "bad"}, "V22"),
    ({"restoration_requestor_email": "a@b@c"}, "V22"),
    ({"restoration_requestor_email": "@x"}, "V22"),
    ({"restoration_requestor_email": "a@b"}, ""),
    ({"finding_file_name": "", "risk_level": "x", "restoration_requestor_email": "x@"}, "V01 V21 V22"),
]


@pytest.fixture(scope="module")
def checked(spark):
    names = sorted({k for change, _ in CASES for k in change} | set(GOOD))
    rows = [("J", i, *[{**GOOD, **change}.get(n, "") for n in names]) for i, (change, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows, "job_id STRING, row_number BIGINT, " + ", ".join(f"{n} STRING" for n in names))
    return ru.validate(ty.typed_findings(raw, as_of()), as_of()).cache()


def test_rules_fire_in_order(checked):
    hits = F.array_compact(
        F.array(*[F.when(F.col("failed_rules").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(r.id)) for i, r in enumerate(ru.DEFAULT_RULES)])
    )
    got = {r.row_number: r.hits for r in checked.select("row_number", F.array_join(hits, " ").alias("hits")).collect()}
    for i, (change, want) in enumerate(CASES):
        assert got[i] == want, (change, got[i])


def test_every_allowed_type_is_accepted(spark):
    rows = [("J", i, t) for i, t in enumerate(FINDING_TYPES)]
    df = spark.createDataFrame(rows, "job_id STRING, row_number BIGINT, finding_type STRING")
    for name, value in GOOD.items():
        if name != "finding_type":
            df = df.withColumn(name, F.lit(value))
    checked = ru.validate(ty.typed_findings(df, as_of()), as_of())
    bad = {r.finding_type for r in checked.where("NOT is_valid").collect()}
    assert bad == {"Quarantined", "Exception"}


def test_one_rejected_row_per_failed_rule(checked):
    rows = ru.rejected_rows(checked, as_of()).where("row_number = 16").orderBy("rule_id").collect()
    assert [(r.field_name, r.rejected_value, r.error_category, r.resolved_category) for r in rows] == [
        ("OriginalFileLocation", None, "Others", "MissingRequiredField"),
        ("QuarantineDateUtc", None, "Others", "MissingRequiredField"),
    ]
    assert rows[0].raw_row_json == rows[1].raw_row_json
    assert '"FindingType":"QUARANTINED"' in rows[0].raw_row_json and "QuarantineDateUtc" not in rows[0].raw_row_json


def test_blank_rows_need_all_twelve_columns(spark):
    rows = [("J", 1, "", "Low", ""), ("J", 2, "", "", "owner"), ("J", 3, "", "", "")]
    raw = spark.createDataFrame(rows, "job_id STRING, row_number BIGINT, id STRING, risk_level STRING, site_owner STRING")
    checked = ru.validate(ty.typed_findings(raw, as_of()), as_of())
    assert {r.row_number: r.blank for r in checked.collect()} == {1: True, 2: False, 3: True}


def test_overflowing_size_is_malformed(spark):
    raw = spark.createDataFrame([("J", 2, "9" * 20)], "job_id STRING, row_number BIGINT, finding_file_size STRING")
    checked = ru.validate(ty.typed_findings(raw, as_of()), as_of())
    rows = ru.rejected_rows(checked, as_of()).collect()
    assert [(r.field_name, r.rule_id) for r in rows] == [("CSV_ROW", None)]


def test_own_rules_can_be_added(spark, checked):
    own = ru.Rule("X01", "site_owner", "A value for Site_Owner is required.", lambda as_of: F.col("site_owner").isNull())
    again = ru.validate(checked.drop("failed_rules", "is_valid", "blank"), as_of(), [*ru.DEFAULT_RULES, own])
    assert again.where("is_valid").count() == 0
    with pytest.raises(ValueError):
        ru.failed_mask(as_of(), [own] * 64)
