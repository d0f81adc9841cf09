"""Registered queries over job state: checkpoints, resume, merges, access paths and items.

Every order stands for one job whose checkpoint and job record follow from the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.layout import AUDIT_SCHEMA, CHECKPOINT_SCHEMA, REJECTED_SCHEMA
from sievework.operators import lookups as lk
from sievework.operators import numbering as nb
from sievework.operators import resume as rs
from sievework.operators import rules as ru
from sievework.operators import tables as tb
from sievework.plans import oracle as orc
from sievework.plans import q_rows as qr
from sievework.plans.registry import query
from sievework.plans.rig import AS_OF, table
from sievework.sources import items as it
from sievework.workspace import fresh_path, materialise

K = "o_orderkey"
_JOB = f"'Job-' || CAST({K} AS STRING)"
_STATUS = f"CASE {K} % 5 WHEN 0 THEN 'Started' WHEN 1 THEN 'Success' WHEN 2 THEN 'PartialSuccess' ELSE 'Failed' END"
# One expression per checkpoint column; the same text runs in Spark and in DuckDB.
CHECKPOINT = {
    "job_id": _JOB,
    "inbound_file_name": f"'report ' || CAST({K} AS STRING) || '.csv'",
    "user_name": "'user' || CAST(o_custkey AS STRING)",
    "source_system": "CASE o_orderstatus WHEN 'F' THEN 'SMB' WHEN 'O' THEN 'Multiple' END",
    "trigger_type": "'StepFunction'",
    "ingestion_mode": "'Full'",
    "batch_size": f"CASE WHEN {K} % 4 = 0 THEN 0 ELSE 100 END",
    "total_batches": f"CASE WHEN {K} % 3 = 0 THEN 0 ELSE CAST(ceil(({K} % 1000) / 100.0) AS BIGINT) END",
    "last_successful_batch_number": f"({K} % 7) % CAST(1 + ceil(({K} % 1000) / 100.0) AS BIGINT)",
    "last_processed_record_count": f"least({K} % 1000, 100 * (({K} % 7) % CAST(1 + ceil(({K} % 1000) / 100.0) AS BIGINT)))",
    "persisted_batch_count": f"({K} % 7) % CAST(1 + ceil(({K} % 1000) / 100.0) AS BIGINT)",
    "success_count": f"{K} % 1000",
    "reject_count": f"{K} % 6",
    "batch_persistence_retry_count": f"{K} % 4",
    "status": _STATUS,
    "is_resume_eligible": f"{K} % 11 = 0",
    "created_at_utc": "o_orderdate",
    "last_checkpoint_utc": "o_orderdate + INTERVAL 1 HOUR",
    "failure_reason": f"CASE WHEN {_STATUS} = 'Failed' THEN 'write failed' END",
    "working_file_path": f"CASE {K} % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE '/work/' || CAST({K} AS STRING) END",
    "working_file_format": f"CASE WHEN {K} % 3 = 2 THEN 'Parquet' END",
    "working_file_record_count": f"CASE WHEN {K} % 3 = 2 THEN {K} % 1000 ELSE 0 END",
}
# Only the queries about missing records leave some out.
_HAS_RECORD = "o_orderstatus <> 'P'"
AUDIT = {
    **{f.name: CHECKPOINT[f.name] for f in AUDIT_SCHEMA if f.name in CHECKPOINT},
    "job_id": f"upper({_JOB})",
    "report_uid": f"upper({_JOB})",
    "file_size_bytes": f"{K} * 10",
    "file_format": "'csv'",
    "s3_folder_path": f"'2026/01/' || CAST({K} AS STRING) || '/'",
    "source_file_path": f"'2026/01/' || CAST({K} AS STRING) || '/in.csv'",
    "metadata_json_path": f"'2026/01/' || CAST({K} AS STRING) || '/report-metadata.json'",
    "archived_file_path": f"CASE WHEN {K} % 2 = 0 THEN '/archive/' || CAST({K} AS STRING) END",
    "processing_summary_path": "CAST(NULL AS STRING)",
    "working_file_path": f"CASE WHEN {K} % 2 = 0 THEN '/old/' || CAST({K} AS STRING) END",
    "working_file_format": f"CASE WHEN {K} % 2 = 0 THEN 'parquet' END",
    "working_file_record_count": f"CASE WHEN {K} % 2 = 0 THEN {K} % 50 ELSE 0 END",
    "uploaded_by": "'user' || CAST(o_custkey AS STRING)",
    "started_by": "'user' || CAST(o_custkey AS STRING)",
    "start_timestamp_utc": "o_orderdate",
    "end_timestamp_utc": f"CASE WHEN {K} % 5 > 0 THEN o_orderdate + INTERVAL 2 HOUR END",
    "error_message": f"CASE WHEN {_STATUS} = 'Failed' THEN 'write failed' END",
    "payload_record_count": f"{K} % 1000 + {K} % 6",
    "total_records": f"{K} % 1000 + {K} % 6",
    "validation_failure_count": f"{K} % 6",
    "checkpointing_enabled": "true",
    "max_batch_persistence_retry_count": "3",
    "checkpoint_message": "CAST(NULL AS STRING)",
}


def _frame(df: DataFrame, columns: dict[str, str], schema) -> DataFrame:
    cols = []
    for f in schema:
        if f.name == "finding_type_counts":
            c = F.when(F.expr(f"{K} % 3 > 0"), F.create_map(F.lit("Obsolete"), F.expr(f"{K} % 1000"), F.lit("Error"), F.expr(f"{K} % 6")))
            cols.append(F.coalesce(c, F.create_map().cast("map<string,bigint>")).alias(f.name))
        else:
            cols.append(F.expr(columns[f.name]).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(table(spark, sf, "orders"), CHECKPOINT, CHECKPOINT_SCHEMA)


def jobs(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    return _frame(table(spark, sf, "orders").where(_HAS_RECORD if gaps else "true"), AUDIT, AUDIT_SCHEMA)


def _select(columns: dict[str, str], where: str = "true") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM orders WHERE {where}"


def over_state(select: str, gaps: bool = False) -> str:
    """A SELECT over checkpoints (cp) and job records (au)."""
    return f"WITH cp AS ({_select(CHECKPOINT)}), au AS ({_select(AUDIT, _HAS_RECORD if gaps else 'true')}) {select}"


def now():
    return F.lit(AS_OF).cast("timestamp")


# --- resume -----------------------------------------------------------------------------
_ELIGIBLE = "status = 'Failed' AND ((success_count > 0 AND last_processed_record_count < success_count) OR is_resume_eligible)"


@query(over_state(f"SELECT job_id, {_ELIGIBLE} AS eligible FROM cp"))
def resume_eligible(spark, sf):
    return checkpoints(spark, sf).select("job_id", rs.eligible_now().alias("eligible"))


_SIZE = "CASE WHEN batch_size > 0 THEN batch_size ELSE 5000 END"
_STATE = f"""SELECT job_id, CAST({_SIZE} AS BIGINT) AS batch_size,
  CAST(CASE WHEN total_batches > 0 THEN total_batches ELSE ceil(success_count / CAST({_SIZE} AS DOUBLE)) END AS BIGINT) AS total_batches,
  'Resume' AS trigger_type, 'Started' AS status, success_count + reject_count AS total_records,
  'Resuming with batch ' || (last_successful_batch_number + 1) || '.' AS checkpoint_message, {_ELIGIBLE} AS is_resume_eligible FROM cp"""


@query(over_state(_STATE))
def resume_state(spark, sf):
    return rs.resume_state(checkpoints(spark, sf), 5000, 3, now()).select(
        "job_id",
        "batch_size",
        "total_batches",
        "trigger_type",
        "status",
        "total_records",
        "checkpoint_message",
        "is_resume_eligible",
    )


@query(
    over_state(
        "SELECT job_id, status, false AS is_resume_eligible, success_count + reject_count AS total_records, failure_reason AS checkpoint_message, "
        f"'The job cannot be resumed.' AS message FROM cp WHERE NOT ({_ELIGIBLE})"
    )
)
def not_eligible_result(spark, sf):
    return rs.not_eligible_result(checkpoints(spark, sf), now()).select(
        "job_id", "status", "is_resume_eligible", "total_records", "checkpoint_message", "message"
    )


_JOINED = "cp LEFT JOIN au ON lower(cp.job_id) = lower(au.job_id)"


@query(
    over_state(
        "SELECT coalesce(au.job_id, cp.job_id) AS job_id, cp.job_id AS checkpoint_job, coalesce(au.uploaded_by, cp.user_name) AS uploaded_by, "
        "coalesce(au.source_file_path, '') AS source_file_path, coalesce(au.archived_file_path, au.source_file_path) AS archived_file_path, "
        "CASE WHEN trim(coalesce(cp.working_file_path, '')) <> '' THEN cp.working_file_path ELSE au.working_file_path END AS working_file_path, "
        "coalesce(cp.working_file_format, au.working_file_format) AS working_file_format, "
        "CAST(greatest(cp.working_file_record_count, coalesce(au.working_file_record_count, 0)) AS BIGINT) AS working_file_record_count, "
        f"cp.success_count, cp.reject_count FROM {_JOINED}",
        gaps=True,
    )
)
def job_checkpoint_join(spark, sf):
    state = rs.resume_state(checkpoints(spark, sf), 5000, 3, now())
    known = rs.resume_job_records(state.withColumn("failure_reason", F.col("job_id")), jobs(spark, sf, gaps=True).withColumn("failure_reason", F.lit(None).cast("string")))
    key = F.concat(F.lit("Job-"), F.regexp_extract("job_id", r"(\d+)$", 1))
    return known.select(
        "job_id",
        key.alias("checkpoint_job"),
        "uploaded_by",
        "source_file_path",
        "archived_file_path",
        "working_file_path",
        "working_file_format",
        "working_file_record_count",
        "success_count",
        "reject_count",
    )


@query(
    "SELECT DISTINCT l_orderkey, CASE WHEN o_orderkey IS NULL THEN 'unknown_job' ELSE 'ok' END AS verdict FROM lineitem "
    "LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') j ON l_orderkey = o_orderkey"
)
def job_for_rows(spark, sf):
    # Files are named after orders; those whose order has no job record are errors.
    files = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    known = table(spark, sf, "orders").where(_HAS_RECORD).select(F.col(K).alias("l_orderkey"))
    bad = files.join(known, "l_orderkey", "left_anti").withColumn("verdict", F.lit("unknown_job"))
    return files.join(known, "l_orderkey", "left_semi").withColumn("verdict", F.lit("ok")).unionByName(bad)


_SOURCE_ARGS = {
    "enabled": f"{K} % 8 <> 0",
    "fmt": f"CASE {K} % 3 WHEN 0 THEN 'parquet' WHEN 1 THEN 'PARQUET' ELSE 'avro' END",
    "path": f"CASE WHEN {K} % 10 = 0 THEN ' ' ELSE '/w/' || CAST({K} AS STRING) END",
    "recorded": f"{K} % 1000",
    "parquet_after": f"CASE WHEN {K} % 7 = 0 THEN NULL ELSE greatest({K} % 1000 - o_custkey, 0) END",
    "staged": f"{K} % 4 * 10",
    "staged_after": f"{K} % 2 * 5",
    "last": "o_custkey",
    "success": f"{K} % 1000",
}
_SOURCE = """CASE WHEN enabled AND lower(fmt) = 'parquet' AND trim(path) <> '' AND recorded > 0 AND parquet_after IS NOT NULL
  AND (parquet_after > 0 OR last >= recorded) THEN 'parquet' WHEN staged = 0 THEN 'error_no_data'
  WHEN staged_after = 0 AND last < success THEN 'error_no_rows_left' ELSE 'staging' END"""


@query(f"SELECT {K}, {_SOURCE} AS resume_source FROM ({_select({K: K, **_SOURCE_ARGS})}) t")
def choose_source(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(K, *[f"{e} AS {n}" for n, e in _SOURCE_ARGS.items()])
    return rows.select(K, rs.resume_source(*[F.col(n) for n in _SOURCE_ARGS]).alias("resume_source"))


@query(
    orc.over_rig(
        "SELECT job_id, sequence_number, 2 + (sequence_number - 1000 - 1) // 300 + 1 AS batch_number FROM numbered WHERE sequence_number > 1000"
    )
)
def remaining_rows(spark, sf):
    rows = materialise(qr.numbered(spark, sf).select("job_id", "sequence_number"), "working")
    state = rows.select("job_id").distinct().selectExpr(
        "job_id",
        "1000L AS last_processed_record_count",
        "2L AS last_successful_batch_number",
        "300L AS batch_size",
    )
    return rs.remaining_rows(rows, state)


@query(over_state("SELECT job_id, CASE WHEN reject_count > 0 THEN 'PartialSuccess' ELSE 'Success' END AS status FROM cp"))
def resume_complete(spark, sf):
    return checkpoints(spark, sf).select("job_id", rs.resumed_status(F.col("reject_count")).alias("status"))


_LEFT = "success_count > 0 AND last_processed_record_count < success_count"


@query(
    over_state(
        f"SELECT job_id, status, status = 'Failed' AND {_LEFT} AS is_resume_eligible, last_processed_record_count, '{AS_OF}' AS last_checkpoint_utc, "
        f"CASE WHEN status = 'Failed' AND {_LEFT} THEN 'Stopped behind record ' || last_processed_record_count || '.' ELSE 'Checkpoint written.' END AS progress FROM cp"
    )
)
def checkpoint_row(spark, sf):
    rows = rs.checkpoint_rows(checkpoints(spark, sf), F.col("status"), now(), F.col("failure_reason"))
    return rows.select(
        "job_id",
        "status",
        "is_resume_eligible",
        "last_processed_record_count",
        qr.when_text("last_checkpoint_utc"),
        rs.checkpoint_message(F.col("is_resume_eligible"), F.col("last_processed_record_count")).alias("progress"),
    )


_STORE_ARGS = {
    "enabled": f"{K} % 2 = 0",
    "primary_store": f"{K} % 3 = 0",
    "fallback": f"{K} % 5 < 3",
    "failed": f"{K} % 7 < 3",
    "n": f"{K} % 11",
}


@query(
    f"SELECT {K}, CASE WHEN n = 0 THEN 'none' WHEN NOT primary_store THEN CASE WHEN enabled AND NOT failed THEN 'both' ELSE 'staging' END "
    "WHEN enabled AND NOT failed THEN 'parquet' WHEN fallback THEN 'staging' ELSE 'error' END AS working_store FROM "
    f"({_select({K: K, **_STORE_ARGS})}) t"
)
def working_store_choice(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(K, *[f"{e} AS {n}" for n, e in _STORE_ARGS.items()])
    return rows.select(K, rs.working_store(*[F.col(n) for n in _STORE_ARGS]).alias("working_store"))


_RETRY_KIND = f"CASE {K} % 4 WHEN 0 THEN 'io' WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid_operation' ELSE 'invalid_data' END"


@query(
    f"SELECT {K}, least(f, k) AS retry_count, least(f, k) + 1 AS attempts, f <= k AS succeeded FROM "
    f"(SELECT {K}, o_custkey % 6 AS f, CASE WHEN {K} % 4 = 3 THEN 0 ELSE 3 END AS k FROM orders) t"
)
def retry_accounting(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(K, f"{_RETRY_KIND} AS kind", "o_custkey % 6 AS failures")
    outcome = rs.retry_outcome(F.col("kind"), F.col("failures"), F.lit(3))
    return rows.select(K, *[c.alias(n) for n, c in outcome.items()])


@query(
    over_state(
        f"SELECT job_id, 'Failed' AS status, 'disk full' AS error_message, coalesce(source_system, 'Unknown') AS source_system, {_LEFT} AS is_resume_eligible FROM au"
    )
)
def failure_state(spark, sf):
    return rs.failed_state(jobs(spark, sf), F.lit("disk full"), now()).select(
        "job_id", "status", "error_message", "source_system", "is_resume_eligible"
    )


@query(over_state("SELECT job_id FROM au WHERE status IN ('Success', 'PartialSuccess')"))
def staging_cleanup(spark, sf):
    return rs.cleanup_jobs(jobs(spark, sf))


# --- keyed tables -------------------------------------------------------------------------
def _new_versions(old: DataFrame, stamp: str) -> DataFrame:
    """Later rows for the failed jobs, with the id in another case."""
    again = old.where("status = 'Failed'")
    return again.withColumns({"job_id": F.lower("job_id"), "status": F.lit("Started"), stamp: now()})


def _upserted(spark: SparkSession, old: DataFrame, new: DataFrame, label: str, merge=None) -> DataFrame:
    """The old rows as a stored table, and the new ones merged into it."""
    path = fresh_path(spark, label)
    tb.upsert_keyed(spark, path, old, old.schema)
    tb.upsert_keyed(spark, path, new, old.schema, merge)
    return tb.read_keyed(spark, path, old.schema)


@query(
    over_state(
        "SELECT CASE WHEN status = 'Failed' THEN lower(job_id) ELSE job_id END AS job_id, CASE WHEN status = 'Failed' THEN 'Started' ELSE status END AS status, "
        "success_count FROM au"
    )
)
def upsert_job(spark, sf):
    old = jobs(spark, sf)
    return _upserted(spark, old, _new_versions(old, "start_timestamp_utc"), "jobs").select("job_id", "status", "success_count")


@query(
    over_state(
        "SELECT CASE WHEN status = 'Failed' THEN lower(job_id) ELSE job_id END AS job_id, CASE WHEN status = 'Failed' THEN 'Started' ELSE status END AS status, "
        f"{orc.ts_text('created_at_utc')} AS created_at_utc, CASE WHEN status = 'Failed' THEN '{AS_OF}' ELSE {orc.ts_text('last_checkpoint_utc')} END AS last_checkpoint_utc FROM cp"
    )
)
def upsert_checkpoint(spark, sf):
    old = checkpoints(spark, sf)
    new = _new_versions(old, "created_at_utc")
    newest = tb.newest_per_job(new.unionByName(new), "last_checkpoint_utc")
    return _upserted(spark, old, newest, "checkpoints", lambda before, rows: tb.merged_checkpoints(before, rows, now())).select(
        "job_id", "status", qr.when_text("created_at_utc"), qr.when_text("last_checkpoint_utc")
    )


@query(
    over_state(
        "SELECT job_id, status, success_count FROM cp WHERE lower(job_id) IN (SELECT lower('JOB-' || o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT')"
    )
)
def job_lookup(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    ids = wanted.selectExpr(f"'JOB-' || CAST({K} AS STRING) AS job_id").unionByName(wanted.selectExpr("'  ' AS job_id"))
    return tb.lookup_jobs(checkpoints(spark, sf), ids).select("job_id", "status", "success_count")


@query(
    over_state(
        "SELECT au.job_id, 'Success' AS status, cp.success_count + 1 AS success_count, au.source_file_path, "
        f"coalesce(cp.working_file_path, NULL) AS working_file_path FROM {_JOINED} WHERE au.job_id IS NOT NULL"
    )
)
def audit_from_result(spark, sf):
    results = checkpoints(spark, sf).select(
        "job_id",
        F.lit("Success").alias("status"),
        (F.col("success_count") + 1).alias("success_count"),
        F.lit(None).cast("string").alias("source_file_path"),
        "working_file_path",
        F.create_map().cast("map<string,bigint>").alias("finding_type_counts"),
    )
    merged = rs.merged_job_records(jobs(spark, sf), results)
    return merged.select("job_id", "status", "success_count", "source_file_path", "working_file_path")


# --- access paths ---------------------------------------------------------------------------
_LOADED = "load_date_utc >= TIMESTAMP '1996-01-01' AND load_date_utc < TIMESTAMP '1999-01-01'"


def _range():
    return F.lit("1996-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp")


def findings_table(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["id", "job_id", "row_number", "source_record_id", "finding_type", "originating_data_system", "load_date_utc"]
    return qr.checked_table(spark, sf, *wanted, "is_valid").where("is_valid").select(*wanted)


_FOUND = "id, finding_type, originating_data_system, strftime(load_date_utc, '%Y-%m-%d %H:%M:%S') AS load_date_utc"


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "finding_type", "originating_data_system", qr.when_text("load_date_utc"))


@query(orc.over_rig(f"SELECT {_FOUND} FROM checked WHERE is_valid AND finding_type = 'Restored' AND {_LOADED}"))
def findings_by_type(spark, sf):
    return _found(lk.findings_by(findings_table(spark, sf), "finding_type", "Restored", *_range()))


@query(orc.over_rig(f"SELECT {_FOUND} FROM checked WHERE is_valid AND originating_data_system = 'SMB' AND {_LOADED}"))
def findings_by_system(spark, sf):
    return _found(lk.findings_by(findings_table(spark, sf), "originating_data_system", "SMB", *_range()))


@query(orc.over_rig(f"SELECT {_FOUND} FROM checked WHERE is_valid AND job_id = 'JOB-3' AND {_LOADED}"))
def findings_by_job(spark, sf):
    return _found(lk.findings_by(findings_table(spark, sf), "job_id", "JOB-3", *_range()))


@query(
    orc.over_rig(
        "SELECT source_record_id, id, versions FROM (SELECT source_record_id, id, row_number() OVER (PARTITION BY source_record_id ORDER BY load_date_utc DESC, id DESC) AS r, "
        "count(*) OVER (PARTITION BY source_record_id) AS versions FROM (SELECT *  REPLACE (CASE WHEN source_record_id IS NOT NULL THEN 'R' || CAST(TRY_CAST(source_record_id AS BIGINT) % 500 AS VARCHAR) END AS source_record_id) "
        "FROM checked WHERE is_valid) f WHERE source_record_id IS NOT NULL) t WHERE r = 1"
    )
)
def findings_by_source_record(spark, sf):
    # Several findings share a record: the record id is cut to its last digits.
    rows = findings_table(spark, sf)
    shared = rows.withColumn("source_record_id", F.concat(F.lit("R"), (F.col("source_record_id").cast("bigint") % 500).cast("string")))
    return lk.latest_per_source_record(shared).select("source_record_id", "id", "versions")


@query(
    over_state(
        "SELECT job_id, strftime(start_timestamp_utc, '%Y-%m-%d %H:%M:%S') AS start_timestamp_utc FROM au WHERE status = 'Failed' "
        "AND start_timestamp_utc >= TIMESTAMP '1996-01-01' AND start_timestamp_utc < TIMESTAMP '1999-01-01'"
    )
)
def jobs_by_status(spark, sf):
    found = lk.jobs_by_status(jobs(spark, sf), "Failed", *_range())
    return found.select("job_id", qr.when_text("start_timestamp_utc"))


@query(orc.over_rig(f"SELECT job_id, row_number, rule_id FROM errors WHERE job_id = 'JOB-2' AND TIMESTAMP '{AS_OF}' >= TIMESTAMP '2025-12-31'"))
def rejected_by_job(spark, sf):
    rows = materialise(qr.rejected(spark, sf), "rejected")
    found = lk.rejected_by_job(rows, "job-2", F.lit("2025-12-31").cast("timestamp"))
    return found.select("job_id", "row_number", "rule_id")


@query(
    "SELECT user_id, event_id, event_type AS status, previous AS previous_status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) t "
    "WHERE event_type IS DISTINCT FROM previous"
)
def finding_history(spark, sf):
    changes = lk.status_history(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id")
    return changes.select("user_id", "event_id", F.col("event_type").alias("status"), "previous_status")


# --- items --------------------------------------------------------------------------------
def _typed_pairs(pairs: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    out = []
    for name, kind, value in pairs:
        if kind == "S":
            out.append((name, f"'{{\"S\":' || CAST(to_json({value}) AS VARCHAR) || '}}'"))
        elif kind == "N":
            out.append((name, f"'{{\"N\":\"' || CAST({value} AS VARCHAR) || '\"}}'"))
        elif kind == "B":
            out.append((name, f"'{{\"BOOL\":' || CASE WHEN {value} THEN 'true' ELSE 'false' END || '}}'"))
        else:
            out.append((name, f"'{{\"S\":\"' || strftime({value}, '%Y-%m-%dT%H:%M:%S.%f') || '0Z\"}}'"))
    return [(n, f"CASE WHEN ({p[2]}) IS NOT NULL THEN {v} END") for (n, v), p in zip(out, pairs)]


_FINDING_SQL = {
    **{c: c for _, _, c in it.FINDING_ITEM},
    "ingestion_job_id": "job_id",
    "last_update_date_utc": "load_date_utc",
    "error_category": "''",
    "error_reason": "''",
    "restored_date_utc": "CAST(NULL AS TIMESTAMP)",
    "deleted_date_utc": "CAST(NULL AS TIMESTAMP)",
}
_FINDING_PAIRS = _typed_pairs([(n, k, _FINDING_SQL[c]) for n, k, c in it.FINDING_ITEM])
# An item is long; a digest compares it whole.


@query(orc.over_rig(f"SELECT job_id, id, {orc.json_sql(_FINDING_PAIRS)} AS item FROM checked WHERE is_valid"))
def finding_to_item(spark, sf):
    items = it.to_items(ru.valid_rows(qr.checked_table(spark, sf)), "finding")
    return items.select("job_id", it.get_text("item", "id").alias("id"), F.to_json("item").alias("item"))


_AUDIT_SQL = {c: c if c in AUDIT else "CAST(NULL AS VARCHAR)" for _, _, c in it.AUDIT_ITEM}
_COUNTS = f"CASE WHEN n % 3 > 0 THEN '{{\"Obsolete\":' || n % 1000 || ',\"Error\":' || n % 6 || '}}' END"
_AUDIT_SQL["finding_type_counts"] = _COUNTS
_AUDIT_ITEM_SQL = f"SELECT job_id, {orc.json_sql(_typed_pairs([(n, k, _AUDIT_SQL[c]) for n, k, c in it.AUDIT_ITEM]))} AS item FROM (SELECT *, CAST(substr(job_id, 5) AS BIGINT) AS n FROM au) t"


@query(over_state(_AUDIT_ITEM_SQL))
def audit_to_item(spark, sf):
    return it.to_items(jobs(spark, sf), "audit").select("job_id", F.to_json("item").alias("item"))


_STORED = {f.name for f in REJECTED_SCHEMA}
_REJECTED_SQL = {
    # Columns that only infrastructure errors fill stay out of the item.
    **{c: c if c in _STORED else "CAST(NULL AS TIMESTAMP)" if k == "D" else "CAST(NULL AS VARCHAR)" for _, k, c in it.REJECTED_ITEM},
    "rejected_row_id": "sha256(id || '|' || rule_id)",
    "quarantine_date": "''",
    "status": "'Error'",
    "record_version_id": "0",
    "error_date_utc": f"TIMESTAMP '{AS_OF}'",
    "error_category": "'Others'",
}
_REJECTED_PAIRS = _typed_pairs([(n, k, _REJECTED_SQL[c]) for n, k, c in it.REJECTED_ITEM if c != "raw_row_json"])


@query(orc.over_rig(f"SELECT job_id, row_number, rule_id, {orc.json_sql(_REJECTED_PAIRS)} AS item FROM errors"))
def rejected_to_item(spark, sf):
    rows = qr.rejected(spark, sf).drop("raw_row_json")
    items = it.to_items(rows, "rejected")
    # The row's keys come back from its item.
    number = it.get_number("item", "rowNumber")
    shown = items.select("job_id", number.alias("row_number"), it.get_text("item", "id").alias("rejected_row_id"), F.to_json("item").alias("item"))
    keys = rows.select("rejected_row_id", "rule_id")
    return shown.join(keys, "rejected_row_id").select("job_id", "row_number", "rule_id", "item")


_CP_PAIRS = _typed_pairs(it.CHECKPOINT_ITEM)


@query(over_state(f"SELECT job_id, {orc.json_sql(_CP_PAIRS)} AS item FROM cp"))
def checkpoint_to_item(spark, sf):
    return it.to_items(checkpoints(spark, sf), "checkpoint").select("job_id", F.to_json("item").alias("item"))


@query(orc.over_rig("SELECT job_id, arg_min(finding_type, row_number) AS finding_type, count(*) AS row_count FROM checked WHERE is_valid GROUP BY job_id, lower(finding_type)"))
def item_codec(spark, sf):
    # Counts of a job as a nested map attribute, and back.
    counts = qr.totals(spark, sf).select("job_id", "finding_type_counts")
    items = counts.select("job_id", it.item([("findingTypeCounts", it.int_map_attribute("finding_type_counts"))]).alias("item"))
    return items.select("job_id", F.explode(it.get_int_map("item", "findingTypeCounts")).alias("finding_type", "row_count"))


def _older(items: DataFrame, entity: str) -> DataFrame:
    """Half of the items under their older attribute names."""
    renames = it.OLDER_NAMES[entity]
    table_ = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    renamed = F.transform_keys("item", lambda k, v: F.coalesce(F.try_element_at(table_, k), k))
    half = F.crc32(F.to_json("item").cast("binary")) % 2 == 0
    return items.withColumn("item", F.when(half, renamed).otherwise(F.col("item")))


# Lines of one export file, some 200 MB as text.
_EXPORT_ROWS = 200_000


def _exported(spark: SparkSession, items: DataFrame, label: str) -> DataFrame:
    """Items written as a compressed export and read back; a file is bounded, as its lines cannot be split."""
    path = fresh_path(spark, label)
    it.item_lines(items).write.option("maxRecordsPerFile", _EXPORT_ROWS).option("compression", "lz4").text(path)
    return it.items_from_lines(spark.read.text(path))


_F_TEXT = ["id", "ingestion_job_id", "source_record_id", "finding_file_name", "finding_type", "originating_data_system", "risk_level", "original_file_location", "status", "status_text"]
_F_DATES = ["load_date_utc", "last_modified_date_utc", "quarantine_date_utc"]


# Stored text that is no status name leaves the default; "Not Obsolete" is a known spelling.
_BACK = {c: c for c in _F_TEXT} | {"ingestion_job_id": "job_id"}


@query(
    orc.over_rig(
        f"SELECT {', '.join(f'{e} AS {c}' for c, e in _BACK.items())}, finding_file_size_bytes, record_version_id, "
        f"{', '.join(f'{orc.ts_text(c)} AS {c}' for c in _F_DATES)} FROM checked WHERE is_valid"
    )
)
def item_scan_findings(spark, sf):
    items = it.to_items(ru.valid_rows(qr.checked_table(spark, sf)), "finding")
    rows = it.from_items(_exported(spark, _older(items, "finding"), "items"), "finding")
    return rows.select(*_F_TEXT, "finding_file_size_bytes", "record_version_id", *[qr.when_text(c) for c in _F_DATES])


@query(
    over_state(
        "SELECT job_id, report_uid, file_size_bytes, source_file_path, uploaded_by, status, success_count, is_resume_eligible, checkpointing_enabled, "
        "CASE WHEN n % 3 > 0 THEN n % 1000 END AS obsolete_rows FROM (SELECT *, CAST(substr(job_id, 5) AS BIGINT) AS n FROM au) t"
    )
)
def item_scan_audits(spark, sf):
    items = it.to_items(jobs(spark, sf), "audit")
    rows = it.from_items(_exported(spark, _older(items, "audit"), "items"), "audit")
    return rows.select(
        "job_id",
        "report_uid",
        "file_size_bytes",
        "source_file_path",
        "uploaded_by",
        "status",
        "success_count",
        "is_resume_eligible",
        "checkpointing_enabled",
        F.try_element_at("finding_type_counts", F.lit("Obsolete")).alias("obsolete_rows"),
    )


@query(
    orc.over_rig(
        "SELECT sha256(id || '|' || rule_id) AS rejected_row_id, job_id, row_number, field_name, rejected_value, error_reason, finding_type, 'Error' AS status FROM errors"
    )
)
def item_scan_rejected(spark, sf):
    items = it.to_items(qr.rejected(spark, sf), "rejected")
    rows = it.from_items(_exported(spark, _older(items, "rejected"), "items"), "rejected")
    return rows.select(
        "rejected_row_id", "job_id", "row_number", "field_name", "rejected_value", "error_reason", "finding_type", "status"
    )


@query(
    over_state(
        "SELECT job_id, status, batch_size, success_count, last_processed_record_count, is_resume_eligible, failure_reason, working_file_path, "
        f"{orc.ts_text('created_at_utc')} AS created_at_utc FROM cp"
    )
)
def item_scan_checkpoints(spark, sf):
    items = it.to_items(checkpoints(spark, sf), "checkpoint")
    rows = it.from_items(_exported(spark, items, "items"), "checkpoint")
    return rows.select(
        "job_id",
        "status",
        "batch_size",
        "success_count",
        "last_processed_record_count",
        "is_resume_eligible",
        "failure_reason",
        "working_file_path",
        qr.when_text("created_at_utc"),
    )
