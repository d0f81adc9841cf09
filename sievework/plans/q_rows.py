"""Registered queries over report rows: cleaning, typing, rules, rejects, classes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import classify as cl
from sievework.functions import paths as pa
from sievework.functions import status as st
from sievework.functions import text as tx
from sievework.layout import FINDING_SCHEMA, SIZE
from sievework.operators import counts as ct
from sievework.operators import numbering as nb
from sievework.operators import rules as ru
from sievework.operators import typed as ty
from sievework.plans import oracle as orc
from sievework.plans.registry import query
from sievework.plans.rig import AS_OF, inbound_rig, table
from sievework.workspace import materialise, tune

# Small enough that the smallest supplied scale has several batches and slices.
BATCH, SLICE = 500, 4096


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def rig(spark: SparkSession, sf: str) -> DataFrame:
    return inbound_rig(tune(spark), sf).withColumnRenamed("loaded_at", "load_date_utc")


def typed(spark: SparkSession, sf: str) -> DataFrame:
    return ty.typed_findings(rig(spark, sf), as_of())


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Typed rows with their failed rules, blank rows only marked: one pass for aggregates."""
    return ru.validate(typed(spark, sf), as_of())


def checked_table(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Checked rows, written once: what every consumer of a real ingest reads."""
    rows = marked(spark, sf)
    if columns:
        rows = rows.select(*columns, "blank")
    return ty.drop_blank_rows(materialise(rows, "checked")).drop("blank")


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    return ru.rejected_rows(checked_table(spark, sf), as_of())


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    valid = ru.valid_rows(checked_table(spark, sf)).select("job_id", "row_number", *FINDING_SCHEMA.names)
    return nb.sequence_numbers(valid, slice_rows=SLICE)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return ct.job_totals(marked(spark, sf))


def when_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# --- cleaning ---------------------------------------------------------------------------
_WS = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TRIMMED = "regexp_replace(chr(9) || ' ' || text || chr(160) || chr(10), '^{w}|{w}$', '', 'g')".format(w=_WS)


@query(f"SELECT doc_id, {_TRIMMED} AS cleaned FROM documents")
def clean_text(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit("\xa0\n"))
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(padded).alias("cleaned"))


@query(
    orc.over_rig(
        "SELECT job_id, row_number, nullif(trim(id), '') AS source_record_id, "
        "nullif(trim(originating_data_system), '') AS originating_data_system, "
        "nullif(trim(risk_level), '') AS risk_level FROM rig"
    )
)
def null_if_blank(spark, sf):
    return rig(spark, sf).select(
        "job_id",
        "row_number",
        tx.null_if_blank("id").alias("source_record_id"),
        tx.null_if_blank("originating_data_system").alias("originating_data_system"),
        tx.null_if_blank("risk_level").alias("risk_level"),
    )


_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_PRICE_TEXT = (
    f"CASE o_orderkey % 4 WHEN 0 THEN {_PRICE} WHEN 1 THEN {_PRICE} || '-' WHEN 2 THEN '1e3' "
    "ELSE ' ' || CAST(o_orderkey AS STRING) || ',500 ' END"
)


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 "
    "WHEN 0 THEN CAST(round_even(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), 0) AS BIGINT) "
    "WHEN 1 THEN -CAST(round_even(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE), 0) AS BIGINT) "
    "WHEN 2 THEN NULL ELSE o_orderkey * 1000 + 500 END AS parsed FROM orders"
)
def parse_long(spark, sf):
    texts = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PRICE_TEXT} AS size_text")
    return texts.select("o_orderkey", tx.parse_long("size_text").alias("parsed"))


_DAY = "CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING)"
_YMD = "CAST(year(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING)"
_DATE_TEXT = (
    "CASE o_orderkey % 7 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T03:04:05Z' "
    f"WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 03:04:05+02:00' WHEN 3 THEN {_DAY} WHEN 4 THEN {_DAY} || ' 3:04 PM' "
    f"WHEN 5 THEN {_YMD} || ' 3:04' ELSE CAST(year(o_orderdate) AS STRING) END"
)


@query(
    "SELECT o_orderkey, strftime(CASE o_orderkey % 7 WHEN 0 THEN d WHEN 1 THEN d + INTERVAL '3 hours 4 minutes 5 seconds' "
    "WHEN 2 THEN d + INTERVAL '1 hours 4 minutes 5 seconds' WHEN 3 THEN d WHEN 4 THEN d + INTERVAL '15 hours 4 minutes' "
    "WHEN 5 THEN d + INTERVAL '3 hours 4 minutes' END, '%Y-%m-%d %H:%M:%S') AS parsed "
    "FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d FROM orders) t"
)
def parse_timestamp(spark, sf):
    texts = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_DATE_TEXT} AS date_text")
    parsed = tx.parse_timestamp("date_text")
    return texts.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(orc.over_rig("SELECT job_id, row_number, trim(finding_type) AS finding_type FROM rig"))
def clean_finding_type(spark, sf):
    return rig(spark, sf).select("job_id", "row_number", tx.clean_text("finding_type").alias("finding_type"))


@query(
    "SELECT o_orderkey, CASE WHEN trim(o_orderstatus) <> 'F' THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS label, "
    "greatest(o_orderkey, o_custkey, 100) AS highest FROM orders"
)
def first_not_blank(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "*",
        "CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderstatus END AS first",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS second",
    )
    return orders.select(
        "o_orderkey",
        tx.first_not_blank("first", "second").alias("label"),
        F.greatest("o_orderkey", "o_custkey", F.lit(100)).alias("highest"),
    )


# --- typing -----------------------------------------------------------------------------
_FINDING_TEXT = [
    "source_record_id",
    *orc.REQUIRED,
    *orc.OPTIONAL,
    "status",
    "status_text",
]
_FINDING_DATES = ["load_date_utc", *[f"{d}_utc" for d in orc.DATES]]


@query(
    orc.over_rig(
        f"SELECT job_id, row_number, id, {', '.join(_FINDING_TEXT)}, finding_file_size_bytes, "
        f"{', '.join(f'{orc.ts_text(d)} AS {d}' for d in _FINDING_DATES)} FROM typed"
    )
)
def finding_typed(spark, sf):
    return typed(spark, sf).select(
        "job_id", "row_number", "id", *_FINDING_TEXT, SIZE[0], *[when_text(d) for d in _FINDING_DATES]
    )


@query(
    orc.over_rig(
        "SELECT job_id AS ingestion_job_id, row_number, inbound_file_name, user_name, "
        f"{orc.ts_text('load_date_utc')} AS load_date_utc, {orc.ts_text('load_date_utc')} AS last_update_date_utc FROM typed"
    )
)
def lineage_columns(spark, sf):
    return typed(spark, sf).select(
        "ingestion_job_id",
        "row_number",
        "inbound_file_name",
        "user_name",
        when_text("load_date_utc"),
        when_text("last_update_date_utc"),
    )


@query(orc.over_rig("SELECT job_id, row_number, id, record_version_id FROM typed"))
def finding_id(spark, sf):
    return typed(spark, sf).select("job_id", "row_number", "id", "record_version_id")


_PATH = "'/in/' || CAST(o_custkey AS STRING) || '/report ' || CAST(o_orderkey AS STRING) || '.CSV'"


@query(
    f"SELECT o_orderkey, 'ING-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '-' || upper(substr(sha256({_PATH}), 1, 32)) AS report_uid FROM orders"
)
def report_uid(spark, sf):
    files = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", f"{_PATH} AS path")
    return files.select("o_orderkey", pa.report_uid("path", "o_orderdate").alias("report_uid"))


_NAME = "CASE o_orderkey % 3 WHEN 0 THEN 'a/b' || CAST(o_orderkey AS STRING) || '.csv' WHEN 1 THEN '  ' ELSE 'plain ' || CAST(o_orderkey AS STRING) || '.xlsx' END"


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/') || 'U-' || o_orderkey || '/' AS folder, "
    "strftime(o_orderdate, '%Y/%m/') || 'U-' || o_orderkey || '/' || CASE o_orderkey % 3 WHEN 0 THEN 'a_b' || o_orderkey || '.csv' "
    "WHEN 1 THEN 'uploaded-file' ELSE 'plain ' || o_orderkey || '.xlsx' END AS source_key, "
    "strftime(o_orderdate, '%Y/%m/') || 'U-' || o_orderkey || '/report-metadata.json' AS summary_key FROM orders"
)
def archive_paths(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "'U-' || CAST(o_orderkey AS STRING) AS uid", f"{_NAME} AS name"
    )
    return files.select(
        "o_orderkey",
        pa.folder_prefix("uid", "o_orderdate").alias("folder"),
        pa.source_key("uid", "name", "o_orderdate").alias("source_key"),
        pa.summary_key("uid", "o_orderdate").alias("summary_key"),
    )


@query(
    "SELECT o_orderkey, 'ingestion-working/' || strftime(o_orderdate, '%Y/%m/%d/') || 'U-' || o_orderkey || '/' || CASE o_orderkey % 3 "
    "WHEN 0 THEN 'b' || o_orderkey WHEN 1 THEN 'ingestion-working' ELSE 'plain ' || o_orderkey END || '.parquet' AS working_key FROM orders"
)
def working_path(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "'U-' || CAST(o_orderkey AS STRING) AS uid", f"{_NAME} AS name"
    )
    return files.select("o_orderkey", pa.working_key("uid", "name", "o_orderdate").alias("working_key"))


# --- status -----------------------------------------------------------------------------
_TYPE_VARIANT = (
    "CASE o_orderkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Obsolete' WHEN 3 THEN ' obsolete ' WHEN 4 THEN 'Quarantined' "
    "WHEN 5 THEN 'Total Pending Quarantined' WHEN 6 THEN 'total_pending_quarantined' WHEN 7 THEN 'Restoration' WHEN 8 THEN 'Restored' "
    "WHEN 9 THEN 'Deleted' WHEN 10 THEN 'Exception' WHEN 11 THEN 'Exclusion' WHEN 12 THEN 'Not-Obsolete' WHEN 13 THEN 'Error' "
    "WHEN 14 THEN 'FutureType' ELSE 'Type ' || CAST(o_orderkey AS STRING) END"
)
_V_STATUS = (
    "CASE o_orderkey % 16 WHEN 4 THEN 'Quarantined' WHEN 5 THEN 'TotalPendingQuarantined' WHEN 6 THEN 'TotalPendingQuarantined' "
    "WHEN 7 THEN 'Restoration' WHEN 8 THEN 'Restored' WHEN 9 THEN 'Deleted' WHEN 10 THEN 'Exception' WHEN 11 THEN 'Exclusion' "
    "WHEN 12 THEN 'NotObsolete' WHEN 13 THEN 'Error' ELSE 'NotYetStarted' END"
)
_V_TEXT = f"CASE WHEN o_orderkey % 16 < 4 THEN 'NotYetStarted' ELSE trim({_TYPE_VARIANT}) END"


@query(f"SELECT o_orderkey, {_V_STATUS} AS status FROM orders")
def initial_status(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_TYPE_VARIANT} AS t")
    return rows.select("o_orderkey", st.initial_status("t").alias("status"))


@query(f"SELECT o_orderkey, {_V_TEXT} AS status_text FROM orders")
def initial_status_text(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_TYPE_VARIANT} AS t")
    return rows.select("o_orderkey", st.initial_status_text("t").alias("status_text"))


_STORED = (
    "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'quarantinecomplete' WHEN 2 THEN 'not obsolete' WHEN 3 THEN 'TOTAL_PENDING_QUARANTINED' "
    "WHEN 4 THEN '8' WHEN 5 THEN 'unknown' WHEN 6 THEN '101' WHEN 7 THEN 'Failed' WHEN 8 THEN 'Restored' ELSE 'x' || CAST(o_orderkey AS STRING) END"
)


@query(
    "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'QuarantineComplete' WHEN 2 THEN 'NotObsolete' WHEN 3 THEN 'TotalPendingQuarantined' "
    "WHEN 4 THEN 'DeletionComplete' WHEN 6 THEN 'Quarantined' WHEN 7 THEN 'Failed' WHEN 8 THEN 'Restored' ELSE 'NotYetStarted' END AS status FROM orders"
)
def stored_status(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_STORED} AS s")
    return rows.select("o_orderkey", st.stored_status("s").alias("status"))


_LIFE = "CASE o_orderstatus WHEN 'F' THEN 'QuarantineComplete' WHEN 'O' THEN 'NotYetStarted' ELSE 'Deleted' END"


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN {_V_STATUS} ELSE {_LIFE} END AS status, "
    f"CASE WHEN o_orderstatus = 'O' THEN {_V_TEXT} ELSE {_LIFE} END AS status_text FROM orders"
)
def lifecycle_guard(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_TYPE_VARIANT} AS t", f"{_LIFE} AS s")
    return rows.select(
        "o_orderkey",
        st.guarded_status("s", "s", "t").alias("status"),
        st.guarded_status_text("s", "s", "t").alias("status_text"),
    )


@query(
    f"SELECT o_orderkey, CASE WHEN {_LIFE} = 'QuarantineComplete' THEN '/q/' || o_orderkey END AS quarantine_path FROM orders"
)
def quarantine_path(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", f"{_LIFE} AS s", "'/q/' || CAST(o_orderkey AS STRING) AS location"
    )
    return rows.select("o_orderkey", st.quarantine_path("s", "location").alias("quarantine_path"))


_COMPAT_DATES = ["last_modified_date", "load_date", "updated_date", "quarantine_date"]


@query(
    orc.over_rig(
        "SELECT id, '' AS error_reason, finding_file_name AS file_name, current_file_location AS file_path, "
        "originating_data_system AS source_system, coalesce(finding_file_size_bytes, 0) AS file_size, CAST(NULL AS VARCHAR) AS quarantine_path, "
        "coalesce(strftime(last_modified_date_utc, '%Y-%m-%d %H:%M:%S'), '0001-01-01 00:00:00') AS last_modified_date, "
        f"job_id AS ingestion_id, user_name AS uploaded_by, {orc.ts_text('load_date_utc')} AS load_date, "
        f"{orc.ts_text('load_date_utc')} AS updated_date, {orc.ts_text('quarantine_date_utc')} AS quarantine_date, "
        "originating_data_system AS data_system FROM checked WHERE is_valid"
    )
)
def compat_view(spark, sf):
    view = ty.compat_view(ru.valid_rows(checked_table(spark, sf)))
    return view.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in _COMPAT_DATES})


_TL_DATES = [c for c in ty.TEXT_LAYOUT if c.endswith("_utc")]
_TL_KEEP = ["id", "finding_file_size_bytes", *_FINDING_TEXT]


@query(
    orc.over_rig(
        f"SELECT {', '.join(_TL_KEEP)}, {', '.join(f'{orc.ts_text(c)} AS {c}' for c in _FINDING_DATES)} FROM checked WHERE is_valid"
    )
)
def working_row(spark, sf):
    text = ty.to_text_layout(ru.valid_rows(checked_table(spark, sf)))
    back = ty.from_text_layout(text, as_of())
    return back.select(*_TL_KEEP, *[when_text(c) for c in _FINDING_DATES])


# --- blank rows, rules, rejects ------------------------------------------------------------
@query(orc.over_rig("SELECT job_id, row_number FROM checked"))
def drop_blank_rows(spark, sf):
    return checked_table(spark, sf, "job_id", "row_number")


@query(orc.over_rig("SELECT job_id, is_valid, count(*) AS row_count, min(row_number) AS first_row, max(row_number) AS last_row FROM checked GROUP BY ALL"))
def is_valid_split(spark, sf):
    return (
        checked_table(spark, sf, "job_id", "row_number", "is_valid")
        .groupBy("job_id", "is_valid")
        .agg(
            F.count("*").alias("row_count"),
            F.min("row_number").alias("first_row"),
            F.max("row_number").alias("last_row"),
        )
    )


_RULE_LIST = "array_to_string([" + ", ".join(f"CASE WHEN {r[0]} THEN '{r[0]}' END" for r in orc.RULES) + "], ' ')"


@query(orc.over_rig(f"SELECT job_id, row_number, is_valid, coalesce({_RULE_LIST}, '') AS failed FROM checked"))
def validate(spark, sf):
    names = F.array_compact(
        F.array(*[F.when(F.col("failed_rules").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(r.id)) for i, r in enumerate(ru.DEFAULT_RULES)])
    )
    rows = checked_table(spark, sf, "job_id", "row_number", "is_valid", "failed_rules")
    return rows.select("job_id", "row_number", "is_valid", F.array_join(names, " ").alias("failed"))


@query(orc.over_rig("SELECT job_id, rule_id, count(*) AS row_count FROM errors GROUP BY ALL"))
def rule_hit_counts(spark, sf):
    return rejected(spark, sf).groupBy("job_id", "rule_id").agg(F.count("*").alias("row_count"))


@query(
    orc.over_rig(
        "SELECT job_id, row_number, rule_id, field_name, error_reason, source_record_id, finding_file_name, finding_type, "
        "'Others' AS error_category, sha256(id || '|' || rule_id) AS rejected_row_id FROM errors"
    )
)
def explode_rejections(spark, sf):
    return ru.explode_rejections(checked_table(spark, sf), as_of()).select(
        "job_id",
        "row_number",
        "rule_id",
        "field_name",
        "error_reason",
        "source_record_id",
        "finding_file_name",
        "finding_type",
        "error_category",
        "rejected_row_id",
    )


@query(orc.over_rig("SELECT job_id, row_number, rule_id, rejected_value FROM errors"))
def rejected_value(spark, sf):
    return rejected(spark, sf).select("job_id", "row_number", "rule_id", "rejected_value")


_MESSAGES = "array_to_string([" + ", ".join(f"CASE WHEN {r[0]} THEN '{r[4]}' END" for r in orc.RULES) + "], ', ')"


@query(orc.over_rig(f"SELECT job_id, row_number, {_MESSAGES} AS error_reason FROM checked WHERE NOT is_valid"))
def error_summary(spark, sf):
    return ru.rejected_records(checked_table(spark, sf)).select("job_id", "row_number", "error_reason")


def _iso(c: str) -> str:
    return f"'\"' || strftime({c}, '%Y-%m-%dT%H:%M:%S') || '\"'"


_RAW_PAIRS = []
for _name in ty.RAW_JSON_FIELDS:
    _source = "originating_data_system" if _name == "data_system" else _name
    if _name.endswith("_date_utc"):
        _value = _iso(_source)
    elif _name == "finding_file_size_bytes":
        _value = f"CAST({_source} AS VARCHAR)"
    else:
        _value = orc.json_text(_source)
    _RAW_PAIRS.append(("".join(p.capitalize() for p in _name.split("_")), _value))


@query(orc.over_rig(f"SELECT job_id, row_number, {orc.json_sql(_RAW_PAIRS)} AS raw_row_json FROM checked WHERE NOT is_valid"))
def raw_row_json(spark, sf):
    bad = ru.rejected_records(checked_table(spark, sf))
    return bad.select("job_id", "row_number", ty.raw_row_json().alias("raw_row_json"))


@query(
    orc.over_rig(
        "SELECT job_id, row_number, field_name, error_reason, sha256(job_id || '|' || row_number || '|' || field_name || '|' || error_reason) AS rejected_row_id, "
        f"'{AS_OF}' AS error_date_utc FROM errors"
    )
)
def rejected_detail(spark, sf):
    bare = rejected(spark, sf).withColumns(
        {"rejected_row_id": F.lit(" "), "error_date_utc": F.lit(None).cast("timestamp")}
    )
    return ru.rejected_detail(bare, as_of()).select(
        "job_id", "row_number", "field_name", "error_reason", "rejected_row_id", when_text("error_date_utc")
    )


# --- classification ------------------------------------------------------------------------
_KIND = (
    "CASE doc_id % 8 WHEN 0 THEN 'access_denied' WHEN 1 THEN 'io' WHEN 2 THEN 'not_supported' WHEN 3 THEN 'timeout' "
    "WHEN 4 THEN 'cancelled' WHEN 5 THEN 'invalid_operation' WHEN 6 THEN 'invalid_data' ELSE 'io' END"
)


def _any(c: str, phrases: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p.strip()}')" for p in phrases.split(";")) + ")"


_CLASSIFIED = f"""SELECT doc_id, CASE WHEN kind = 'access_denied' THEN 'PermissionDenied'
  WHEN kind = 'io' AND {_any('m', 'sharing violation;locked;checked out;in use;being used by another process')} THEN 'FileLockedOrCheckedOut'
  WHEN kind = 'io' AND {_any('m', 'read-only;readonly;write protected;access is denied')} THEN 'ReadOnlyOrSystemProtected'
  WHEN kind = 'io' AND {_any('m', 'network;unreachable;no such host;cannot access;unc;host not found;connection refused;certificate;token')} THEN 'AuthenticationOrCertificateFailure'
  WHEN kind = 'io' AND {_any('m', 'throttl;rate limit;too many requests;429')} THEN 'RateLimitingOrThrottling'
  WHEN kind = 'not_supported' THEN 'UnsupportedFileType' WHEN kind = 'timeout' THEN 'AuthenticationOrCertificateFailure'
  WHEN kind = 'cancelled' THEN 'RetryExhausted'
  WHEN kind = 'invalid_operation' AND {_any('m', 'unavailable;not available')} THEN 'RestorationSystemUnavailable'
  WHEN kind = 'invalid_operation' AND {_any('m', 'conflict;already exists;duplicate target')} THEN 'RestorationTargetConflict'
  WHEN kind = 'invalid_data' THEN 'MalformedInputRow' ELSE 'Others' END AS category
  FROM (SELECT doc_id, lower(text) AS m, {_KIND} AS kind FROM documents) t"""


@query(_CLASSIFIED)
def classify_error(spark, sf):
    failures = table(spark, sf, "documents").selectExpr("doc_id", "text", f"{_KIND} AS kind")
    return failures.select("doc_id", cl.error_category("kind", "text").alias("category"))


@query(
    orc.over_rig(
        f"SELECT job_id, row_number, rule_id, {orc.CATEGORY.format(m='error_reason')} AS resolved_category FROM errors "
        f"UNION ALL SELECT 'doc', doc_id, NULL, {orc.CATEGORY.format(m='text')} FROM documents"
    )
)
def classify_validation(spark, sf):
    rules = rejected(spark, sf).select("job_id", "row_number", "rule_id", "resolved_category")
    texts = table(spark, sf, "documents").select(
        F.lit("doc").alias("job_id"),
        F.col("doc_id").alias("row_number"),
        F.lit(None).cast("string").alias("rule_id"),
        cl.validation_category("text").alias("resolved_category"),
    )
    return rules.unionByName(texts)


_CONDITIONS = [
    "malformed_row",
    "source_file_missing",
    "quarantine_file_missing",
    "target_path_missing",
    "metadata_integrity_failure",
    "duplicate_restore_attempt",
    "partial_restore_failure",
    "restore_target_conflict",
    "retention_not_met",
    "delete_quarantine_file_missing",
    "duplicate_delete_attempt",
    "partial_delete_failure",
]
_CONDITION = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CONDITIONS)) + " ELSE 'other' END"


@query(
    "SELECT o_orderkey, CASE o_orderkey % 13 WHEN 0 THEN 'MalformedInputRow' WHEN 1 THEN 'MissingAtSource' WHEN 2 THEN 'RestorationQuarantineFileMissing' "
    "WHEN 3 THEN 'RestorationTargetPathMissing' WHEN 4 THEN 'RestorationMetadataIntegrityFailure' WHEN 5 THEN 'RestorationDuplicateRestoreAttempt' "
    "WHEN 6 THEN 'RestorationPartialRestoreFailure' WHEN 7 THEN 'RestorationTargetConflict' WHEN 8 THEN 'DeletionRetentionNotMet' "
    "WHEN 9 THEN 'DeletionQuarantineFileMissing' WHEN 10 THEN 'DeletionDuplicateAttempt' WHEN 11 THEN 'DeletionPartialFailure' END AS category FROM orders"
)
def precheck_category(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_CONDITION} AS condition")
    return cl.with_precheck_category(rows).select("o_orderkey", F.col("precheck_category").alias("category"))


@query(
    orc.over_rig(
        "SELECT job_id, resolved_category, actionable, priority, count(*) AS row_count FROM "
        f"(SELECT job_id, {orc.CATEGORY.format(m='error_reason')} AS resolved_category, true AS actionable, CAST(NULL AS VARCHAR) AS priority FROM errors) t "
        "GROUP BY ALL"
    )
)
def category_dimension(spark, sf):
    # The dimension joins the few aggregated rows, not the rejected rows themselves.
    counts = rejected(spark, sf).groupBy("job_id", "resolved_category").agg(F.count("*").alias("row_count"))
    return cl.with_category_details(counts).select("job_id", "resolved_category", "actionable", "priority", "row_count")


# --- counts -----------------------------------------------------------------------------
@query(
    orc.over_rig(
        "SELECT job_id, arg_min(finding_type, row_number) AS finding_type, count(*) AS row_count FROM checked WHERE is_valid "
        "GROUP BY job_id, lower(finding_type)"
    )
)
def finding_type_counts(spark, sf):
    return ct.finding_type_counts(marked(spark, sf))


@query(orc.over_rig("SELECT job_id, success_count, reject_count, total_records FROM totals"))
def record_counts(spark, sf):
    return ct.record_counts(marked(spark, sf))


@query(orc.over_rig("SELECT job_id, source_system FROM totals"))
def source_system(spark, sf):
    return ct.source_systems(marked(spark, sf))


@query(orc.over_rig(f"SELECT job_id, {orc.STATUS_OF} AS status FROM totals"))
def job_status(spark, sf):
    return totals(spark, sf).select("job_id", ct.job_status(F.col("success_count"), F.col("reject_count")).alias("status"))


@query(orc.over_rig(f"SELECT job_id, {orc.MESSAGE_OF} AS message FROM totals"))
def job_message(spark, sf):
    success, bad = F.col("success_count"), F.col("reject_count")
    return totals(spark, sf).select("job_id", ct.job_message(ct.job_status(success, bad), success, bad).alias("message"))


@query(orc.over_rig(f"SELECT job_id, CAST(ceil(success_count / {BATCH}.0) AS BIGINT) AS batches FROM totals"))
def batch_count(spark, sf):
    return totals(spark, sf).select("job_id", nb.batch_count(F.col("success_count"), F.lit(BATCH)).alias("batches"))


@query(
    orc.over_rig(
        f"SELECT job_id, CASE WHEN {orc.STATUS_OF} = 'Failed' AND total_records = 0 THEN 'unprocessable' ELSE 'ok' END AS response_class FROM totals"
    )
)
def response_class(spark, sf):
    t = totals(spark, sf)
    status = ct.job_status(F.col("success_count"), F.col("reject_count"))
    return t.select("job_id", ct.response_class(status, F.col("total_records")).alias("response_class"))


@query(
    orc.over_rig(
        "SELECT job_id, row_number // 5000 AS part, count(*) AS entries, "
        "sha256(string_agg(row_number || ':' || rule_id, ' ' ORDER BY row_number, rule_id)) AS digest FROM errors GROUP BY ALL"
    )
)
def rejected_list(spark, sf):
    lists = ct.rejected_lists(rejected(spark, sf))
    labels = F.transform("rejected_rows", lambda r: F.concat_ws(":", r["row_number"].cast("string"), r["rule_id"]))
    return lists.select(
        "job_id",
        "part",
        F.size("rejected_rows").cast("bigint").alias("entries"),
        F.sha2(F.array_join(labels, " "), 256).alias("digest"),
    )


# --- numbering ----------------------------------------------------------------------------
@query(orc.over_rig("SELECT job_id, row_number, sequence_number FROM numbered"))
def sequence_number(spark, sf):
    return numbered(spark, sf).select("job_id", "row_number", "sequence_number")


_SIZES = "CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN o_orderkey ELSE 99999 END"


@query(
    orc.over_rig(f"SELECT job_id, row_number, (sequence_number - 1) // {BATCH} + 1 AS batch_number FROM numbered")
)
def batch_number(spark, sf):
    return nb.with_batches(numbered(spark, sf), BATCH).select("job_id", "row_number", "batch_number")


@query(f"SELECT o_orderkey, greatest(least({_SIZES}, 10000), 100) AS batch_size FROM orders")
def batch_size_clamp(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SIZES} AS wanted")
    return rows.select("o_orderkey", nb.clamp_batch_size(F.col("wanted")).alias("batch_size"))


_PROGRESS = f"""SELECT job_id, batch_number, batch_rows, row_number() OVER w AS batches_done,
  CAST(sum(batch_rows) OVER w AS BIGINT) AS records_done FROM (SELECT job_id, (sequence_number - 1) // {BATCH} + 1 AS batch_number, count(*) AS batch_rows
  FROM numbered GROUP BY ALL) t WINDOW w AS (PARTITION BY job_id ORDER BY batch_number)"""


@query(orc.over_rig(_PROGRESS))
def batch_progress(spark, sf):
    return nb.batch_progress(numbered(spark, sf), BATCH)


@query(
    orc.over_rig(
        "SELECT job_id, batch_number, batch_number % 3 = 0 OR batch_number = max(batch_number) OVER (PARTITION BY job_id) AS writes_progress FROM "
        f"(SELECT DISTINCT job_id, (sequence_number - 1) // {BATCH} + 1 AS batch_number FROM numbered) t"
    )
)
def progress_cadence(spark, sf):
    progress = nb.batch_progress(numbered(spark, sf), BATCH)
    total = progress.groupBy("job_id").agg(F.max("batch_number").alias("total"))
    due = nb.reports_progress(F.col("batch_number"), F.col("total"), F.lit(3))
    return progress.join(total, "job_id").select("job_id", "batch_number", due.alias("writes_progress"))


@query(
    orc.over_rig(
        "SELECT job_id, batch_number, batch_rows = least(500, success_count - (batch_number - 1) * 500) AS complete FROM "
        f"(SELECT job_id, (sequence_number - 1) // {BATCH} + 1 AS batch_number, count(*) AS batch_rows FROM numbered GROUP BY ALL) b JOIN totals USING (job_id)"
    )
)
def batch_completeness(spark, sf):
    rows = checked_table(spark, sf, "job_id", "row_number", "is_valid")
    valid = rows.where("is_valid").select("job_id", "row_number")
    progress = nb.batch_progress(nb.sequence_numbers(valid, slice_rows=SLICE), BATCH)
    expected = rows.groupBy("job_id").agg(F.count_if("is_valid").alias("success_count"))
    due = F.least(F.lit(BATCH), F.col("success_count") - (F.col("batch_number") - 1) * BATCH)
    return progress.join(expected, "job_id").select(
        "job_id", "batch_number", (F.col("batch_rows") == due).alias("complete")
    )


@query(orc.over_rig("SELECT job_id, sequence_number, source_record_id FROM numbered ORDER BY job_id, sequence_number"))
def ordered_read(spark, sf):
    rows = numbered(spark, sf).select("job_id", "sequence_number", "source_record_id")
    return rows.orderBy("job_id", "sequence_number")


@query(orc.over_rig("SELECT job_id, sequence_number, source_record_id FROM numbered WHERE sequence_number > 1000"))
def skip_n(spark, sf):
    written = materialise(numbered(spark, sf).select("job_id", "sequence_number", "source_record_id"), "working")
    return nb.rows_after(written, 1000)
