"""Column names, allowed values and dimensions shared by every operator.

Everything here is plain data.  Names of the typed columns are snake_case; the
inbound header names are kept exactly as report authors write them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: inbound header names, in layout order -----------------------------
REQUIRED_HEADERS = [
    "Finding_File_Name",
    "Finding File Format",
    "Current_File_Location",
    "Finding_Type",
    "Originating_Data_System",
    "Originating_Vendor_Tool",
]
OPTIONAL_HEADERS = [
    "ID",
    "Inbound_File_Name",
    "Finding_File_Size",
    "Data_System",
    "Original_File_Location",
    "Quarantine_Date",
    "Site_Owner",
    "File_Owner",
    "Restoration_Ticket_Identifier",
    "Restoration_Requestor_Email",
    "Restoration_Comment",
    "Last_Modified_Date",
    "Created_Date",
    "Last_Accessed_Date",
    "Detection_Date",
    "Business_Unit",
    "Division",
    "Department",
    "Region",
    "Country",
    "Policy_Name",
    "Policy_ID",
    "Finding_Reason",
    "Risk_Level",
    "Sensitivity_Label",
    "Recommended_Action",
]
# --- fixed values: allowed texts -----------------------------------------------------
FINDING_TYPES = [
    "Obsolete",
    "Quarantined",
    "Restored",
    "Deleted",
    "Not Obsolete",
    "Exclusion",
    "TotalPendingQuarantined",
    "Restoration",
    "Exception",
    "Error",
]
DATA_SYSTEMS = ["SMB", "NFS", "M365", "OneDrive", "SharePoint"]
RISK_LEVELS = ["Low", "Medium", "High", "Critical"]
JOB_STATUSES = ["Started", "Success", "PartialSuccess", "Failed", "Completed"]

# --- fixed values: workflow status name -> code --------------------------------------
STATUS_CODES = {
    "NotYetStarted": 0,
    "PendingQuarantine": 1,
    "PendingRestore": 2,
    "InProgress": 3,
    "QuarantineComplete": 4,
    "RestorationComplete": 5,
    "Exception": 6,
    "Error": 7,
    "DeletionComplete": 8,
    "DeletionInProgress": 9,
    "Restoration": 20,
    "Exclusion": 21,
    "TotalPendingQuarantined": 22,
    "NotObsolete": 23,
    "Loaded": 100,
    "Quarantined": 101,
    "Restored": 102,
    "Deleted": 103,
    "NotEligible": 104,
    "Missing": 105,
    "Failed": 106,
}
# --- fixed values: error category, can somebody act on it, stated priority -----------
CATEGORIES = [
    ("None", False, None),
    ("MissingAtSource", False, None),
    ("PermissionDenied", True, None),
    ("ReadOnlyOrSystemProtected", True, None),
    ("FileLockedOrCheckedOut", True, None),
    ("AuthenticationOrCertificateFailure", True, "High"),
    ("RateLimitingOrThrottling", True, None),
    ("UnsupportedFileType", True, None),
    ("RetryExhausted", True, None),
    ("ValidationError", True, None),
    ("MalformedInputRow", True, None),
    ("MissingRequiredField", True, None),
    ("InvalidDataType", True, None),
    ("InvalidAllowedValue", True, None),
    ("RestorationTargetPathMissing", True, "High"),
    ("RestorationQuarantineFileMissing", True, "High"),
    ("RestorationSystemUnavailable", True, "Medium"),
    ("RestorationPartialRestoreFailure", True, "High"),
    ("RestorationMetadataIntegrityFailure", True, "High"),
    ("RestorationDuplicateRestoreAttempt", False, "Low"),
    ("RestorationTargetConflict", True, None),
    ("DeletionRetentionNotMet", False, None),
    ("DeletionQuarantineFileMissing", True, None),
    ("DeletionPartialFailure", True, None),
    ("DeletionDuplicateAttempt", False, None),
    ("Others", True, None),
]
# --- fixed values: named pre-check condition -> category -----------------------------
PRECHECKS = [
    ("malformed_row", "MalformedInputRow"),
    ("source_file_missing", "MissingAtSource"),
    ("quarantine_file_missing", "RestorationQuarantineFileMissing"),
    ("target_path_missing", "RestorationTargetPathMissing"),
    ("metadata_integrity_failure", "RestorationMetadataIntegrityFailure"),
    ("duplicate_restore_attempt", "RestorationDuplicateRestoreAttempt"),
    ("partial_restore_failure", "RestorationPartialRestoreFailure"),
    ("restore_target_conflict", "RestorationTargetConflict"),
    ("retention_not_met", "DeletionRetentionNotMet"),
    ("delete_quarantine_file_missing", "DeletionQuarantineFileMissing"),
    ("duplicate_delete_attempt", "DeletionDuplicateAttempt"),
    ("partial_delete_failure", "DeletionPartialFailure"),
]
# --- fixed values: limits ------------------------------------------------------------
MAX_UPLOAD_BYTES = 500 * 1024 * 1024
BATCH_SIZE, MIN_BATCH_SIZE, MAX_BATCH_SIZE = 5000, 100, 10000
REJECTED_BATCH_SIZE = 5000
STAGED_DAYS = 7
MALFORMED_FIELD = "CSV_ROW"


def raw_name(header: str) -> str:
    """Column name of an inbound header: ``Finding File Format`` -> ``finding_file_format``."""
    return header.lower().replace(" ", "_")


def pascal(name: str) -> str:
    """Field label used in rejected rows: ``risk_level`` -> ``RiskLevel``."""
    return "".join(part.capitalize() for part in name.split("_"))


HEADERS = REQUIRED_HEADERS + OPTIONAL_HEADERS
RAW_COLUMNS = [raw_name(h) for h in HEADERS]

# Typed column -> raw column it is read from, by kind of cleaning.
REQUIRED_TEXT = {raw_name(h): raw_name(h) for h in REQUIRED_HEADERS}
SIZE = ("finding_file_size_bytes", "finding_file_size")
DATES = {
    "last_modified_date_utc": "last_modified_date",
    "created_date_utc": "created_date",
    "last_accessed_date_utc": "last_accessed_date",
    "detection_date_utc": "detection_date",
    "quarantine_date_utc": "quarantine_date",
}
OPTIONAL_TEXT = {
    "source_record_id": "id",
    "source_system_platform": "data_system",
    **{
        c: c
        for c in RAW_COLUMNS
        if c not in REQUIRED_TEXT
        and c not in DATES.values()
        and c not in ("id", "data_system", "finding_file_size", "inbound_file_name")
    },
}

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "COUNTS": T.MapType(T.StringType(), T.LongType()),
}


def _schema(text: str) -> T.StructType:
    # Needs no session, unlike StructType.fromDDL.
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FINDING_SCHEMA = _schema(
    "id STRING, record_version_id INT, source_record_id STRING, ingestion_job_id STRING, "
    "inbound_file_name STRING, user_name STRING, load_date_utc TIMESTAMP, last_update_date_utc TIMESTAMP, "
    "finding_file_name STRING, finding_file_format STRING, finding_file_size_bytes BIGINT, "
    "current_file_location STRING, finding_type STRING, originating_data_system STRING, "
    "originating_vendor_tool STRING, source_system_platform STRING, error_category STRING, "
    "last_modified_date_utc TIMESTAMP, created_date_utc TIMESTAMP, last_accessed_date_utc TIMESTAMP, "
    "detection_date_utc TIMESTAMP, site_owner STRING, file_owner STRING, business_unit STRING, "
    "division STRING, department STRING, region STRING, country STRING, policy_name STRING, "
    "policy_id STRING, finding_reason STRING, risk_level STRING, sensitivity_label STRING, "
    "recommended_action STRING, original_file_location STRING, quarantine_date_utc TIMESTAMP, "
    "restored_date_utc TIMESTAMP, deleted_date_utc TIMESTAMP, exception_date_utc TIMESTAMP, "
    "restoration_ticket_identifier STRING, restoration_requestor_email STRING, "
    "restoration_comment STRING, status STRING, status_text STRING, is_valid BOOLEAN, error_reason STRING"
)
REJECTED_SCHEMA = _schema(
    "rejected_row_id STRING, job_id STRING, inbound_file_name STRING, source_record_id STRING, "
    "finding_file_name STRING, finding_type STRING, user_name STRING, row_number BIGINT, "
    "rule_id STRING, field_name STRING, rejected_value STRING, error_reason STRING, "
    "error_category STRING, resolved_category STRING, error_date_utc TIMESTAMP, raw_row_json STRING"
)
CHECKPOINT_SCHEMA = _schema(
    "job_id STRING, inbound_file_name STRING, user_name STRING, source_system STRING, "
    "trigger_type STRING, ingestion_mode STRING, batch_size BIGINT, total_batches BIGINT, "
    "last_successful_batch_number BIGINT, last_processed_record_count BIGINT, "
    "persisted_batch_count BIGINT, success_count BIGINT, reject_count BIGINT, "
    "batch_persistence_retry_count BIGINT, status STRING, is_resume_eligible BOOLEAN, "
    "created_at_utc TIMESTAMP, last_checkpoint_utc TIMESTAMP, failure_reason STRING, "
    "working_file_path STRING, working_file_format STRING, working_file_record_count BIGINT"
)
AUDIT_SCHEMA = _schema(
    "job_id STRING, report_uid STRING, inbound_file_name STRING, file_size_bytes BIGINT, "
    "file_format STRING, s3_folder_path STRING, source_file_path STRING, metadata_json_path STRING, "
    "archived_file_path STRING, processing_summary_path STRING, working_file_path STRING, "
    "working_file_format STRING, working_file_record_count BIGINT, uploaded_by STRING, "
    "user_name STRING, started_by STRING, start_timestamp_utc TIMESTAMP, end_timestamp_utc TIMESTAMP, "
    "status STRING, error_message STRING, failure_reason STRING, source_system STRING, "
    "trigger_type STRING, ingestion_mode STRING, payload_record_count BIGINT, total_records BIGINT, "
    "success_count BIGINT, reject_count BIGINT, validation_failure_count BIGINT, "
    "finding_type_counts COUNTS, batch_size BIGINT, total_batches BIGINT, "
    "persisted_batch_count BIGINT, last_successful_batch_number BIGINT, "
    "last_processed_record_count BIGINT, checkpointing_enabled BOOLEAN, "
    "batch_persistence_retry_count BIGINT, max_batch_persistence_retry_count BIGINT, "
    "is_resume_eligible BOOLEAN, last_checkpoint_utc TIMESTAMP, checkpoint_message STRING"
)


def category_dimension(spark: SparkSession) -> DataFrame:
    """The 26 error categories (fixed size, so always safe to broadcast)."""
    return spark.createDataFrame(CATEGORIES, "category STRING, actionable BOOLEAN, priority STRING")


def precheck_dimension(spark: SparkSession) -> DataFrame:
    """The 12 named pre-check conditions (fixed size)."""
    return spark.createDataFrame(PRECHECKS, "condition STRING, category STRING")


def status_dimension(spark: SparkSession) -> DataFrame:
    """Workflow status names and codes (fixed size)."""
    return spark.createDataFrame(list(STATUS_CODES.items()), "status STRING, code INT")
