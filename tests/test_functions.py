"""Scalar helpers on literal rows."""

from pyspark.sql import functions as F

from sievework.functions import classify as cl
from sievework.functions import paths as pa
from sievework.functions import status as st
from sievework.functions import text as tx


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def one(spark, texts, c):
    return [r[0] for r in values(spark, [(t,) for t in texts], "t STRING", c)]


def test_trim_strips_all_unicode_white_space(spark):
    assert one(spark, ["\t a ", "　b c ", " ", None], tx.clean_text("t")) == ["a", "b c", "", ""]
    assert one(spark, ["  ", " ", " x "], tx.null_if_blank("t")) == [None, None, "x"]


def test_parse_long(spark):
    texts = ["1,024", " 7 ", "-5", "5-", "+5", "2.5", "3.5", "-2.5", ".5", "5.", "1e3", "abc", "", None, "1.2.3"]
    assert one(spark, texts, tx.parse_long("t")) == [1024, 7, -5, -5, 5, 2, 4, -2, 0, 5, None, None, None, None, None]
    assert one(spark, ["9223372036854775807", "2.50000000001"], tx.parse_long("t")) == [9223372036854775807, 3]


def test_overflow_is_a_readable_number_that_does_not_fit(spark):
    digits = tx.signed_digits("t")
    texts = ["9223372036854775808", "99999999999999999999", "9" * 29, "12", "abc" * 9]
    assert one(spark, texts, tx.digits_overflow(digits, tx.parse_long("t"))) == [True, True, False, False, False]


def test_parse_timestamp(spark):
    texts = {
        "2020-05-06": "2020-05-06 00:00:00",
        "2020-05-06 07:08": "2020-05-06 07:08:00",
        "2020-05-06T07:08:09Z": "2020-05-06 07:08:09",
        "2020-05-06T07:08:09+02:00": "2020-05-06 05:08:09",
        "5/6/2020": "2020-05-06 00:00:00",
        "5/6/2020 7:08 PM": "2020-05-06 19:08:00",
        "5/6/2020 7:08:09 am": "2020-05-06 07:08:09",
        "5/6/2020 17:08": "2020-05-06 17:08:00",
        "5-6-2020": "2020-05-06 00:00:00",
        "2020/5/6 7:08:09": "2020-05-06 07:08:09",
        "6 May 2020": "2020-05-06 00:00:00",
        "6-Jun-2020": "2020-06-06 00:00:00",
        "Jun 6, 2020": "2020-06-06 00:00:00",
        "June 6, 2020": "2020-06-06 00:00:00",
        "2020": None,
        "not a date": None,
        "13/45/2020": None,
        "2020-02-31": None,
        "": None,
    }
    got = one(spark, list(texts), F.date_format(tx.parse_timestamp("t"), "yyyy-MM-dd HH:mm:ss"))
    assert dict(zip(texts, got)) == texts


def test_utf16_length_counts_surrogates(spark):
    assert one(spark, ["abc", "a\U0001f600", "é"], tx.utf16_length("t")) == [3, 3, 1]


def test_date_texts(spark):
    ts = F.col("t").cast("timestamp")
    got = values(spark, [("2020-05-06 07:08:09.5",), ("2020-05-06 07:08:10",)], "t STRING", tx.json_date(ts), tx.utc_text(ts))
    assert got == [
        ("2020-05-06T07:08:09.5", "2020-05-06T07:08:09.5000000Z"),
        ("2020-05-06T07:08:10", "2020-05-06T07:08:10.0000000Z"),
    ]


def test_initial_status(spark):
    cases = [
        (None, "NotYetStarted", "NotYetStarted"),
        ("", "NotYetStarted", "NotYetStarted"),
        ("Obsolete", "NotYetStarted", "NotYetStarted"),
        (" obsolete ", "NotYetStarted", "NotYetStarted"),
        ("Quarantined", "Quarantined", "Quarantined"),
        ("Total Pending Quarantined", "TotalPendingQuarantined", "Total Pending Quarantined"),
        ("total_pending_quarantined", "TotalPendingQuarantined", "total_pending_quarantined"),
        ("Restoration", "Restoration", "Restoration"),
        ("Restored", "Restored", "Restored"),
        ("Deleted", "Deleted", "Deleted"),
        ("Exception", "Exception", "Exception"),
        ("Exclusion", "Exclusion", "Exclusion"),
        ("Not-Obsolete", "NotObsolete", "Not-Obsolete"),
        ("Error", "Error", "Error"),
        ("FutureType", "NotYetStarted", "FutureType"),
        ("-", "NotYetStarted", "-"),
    ]
    got = values(spark, [(c[0],) for c in cases], "t STRING", st.initial_status("t"), st.initial_status_text("t"))
    assert got == [c[1:] for c in cases]


def test_stored_status_and_guard(spark):
    texts = [None, "", "Quarantined", "not obsolete", "TOTAL_PENDING_QUARANTINED", "unknown", "8", "55"]
    want = ["NotYetStarted", "NotYetStarted", "Quarantined", "NotObsolete", "TotalPendingQuarantined", "NotYetStarted", "DeletionComplete", "NotYetStarted"]
    assert one(spark, texts, st.stored_status("t")) == want
    rows = [("QuarantineComplete", "QuarantineComplete"), ("NotYetStarted", "notyetstarted"), ("NotYetStarted", "Other")]
    got = values(spark, rows, "s STRING, x STRING", st.guarded_status("s", "x", F.lit("Restoration")))
    assert [g[0] for g in got] == ["QuarantineComplete", "Restoration", "NotYetStarted"]
    assert values(spark, rows[:1], "s STRING, x STRING", st.quarantine_path("s", F.lit("/q"))) == [("/q",)]


def test_error_categories(spark):
    cases = [
        ("access_denied", "denied", "PermissionDenied"),
        ("io", "Sharing Violation", "FileLockedOrCheckedOut"),
        ("io", "checked out by another user", "FileLockedOrCheckedOut"),
        ("io", "readonly file", "ReadOnlyOrSystemProtected"),
        ("io", "access is denied", "ReadOnlyOrSystemProtected"),
        ("io", "network path unavailable", "AuthenticationOrCertificateFailure"),
        ("io", "token expired", "AuthenticationOrCertificateFailure"),
        ("io", "HTTP 429", "RateLimitingOrThrottling"),
        ("not_supported", "unsupported", "UnsupportedFileType"),
        ("timeout", "timeout", "AuthenticationOrCertificateFailure"),
        ("cancelled", "cancelled", "RetryExhausted"),
        ("invalid_operation", "service unavailable", "RestorationSystemUnavailable"),
        ("invalid_operation", "target already exists", "RestorationTargetConflict"),
        ("invalid_operation", "whatever", "Others"),
        ("invalid_data", "bad row", "MalformedInputRow"),
        ("other", "unknown", "Others"),
        ("io", "generic I/O failure", "Others"),
        ("io", None, "Others"),
    ]
    got = values(spark, [c[:2] for c in cases], "k STRING, m STRING", cl.error_category("k", "m"))
    assert [g[0] for g in got] == [c[2] for c in cases]


def test_validation_categories(spark):
    cases = {
        "Value is required": "MissingRequiredField",
        "Value must not be empty": "MissingRequiredField",
        "Value is invalid": "InvalidAllowedValue",
        "Value must be one of A, B": "InvalidAllowedValue",
        "Date is invalid": "InvalidAllowedValue",
        "Expected number": "InvalidDataType",
        "Invalid size format": "InvalidAllowedValue",
        "": "ValidationError",
    }
    assert one(spark, list(cases), cl.validation_category("t")) == list(cases.values())


def test_paths(spark):
    got = values(
        spark,
        [("a/b.tar.csv", "ING-1"), (" ", "ING-2")],
        "n STRING, u STRING",
        pa.source_key("u", "n", F.lit("2026-06-16").cast("timestamp")),
        pa.working_key("u", "n", F.lit("2026-06-16").cast("timestamp")),
    )
    assert got == [
        ("2026/06/ING-1/a_b.tar.csv", "ingestion-working/2026/06/16/ING-1/b.tar.parquet"),
        ("2026/06/ING-2/uploaded-file", "ingestion-working/2026/06/16/ING-2/ingestion-working.parquet"),
    ]
    assert one(spark, ["file:/x/a%20b+c.CSV"], pa.base_name("t")) == ["a b+c.CSV"]
