"""Typed key-value items: findings, job records, rejected rows and checkpoints to and from
``MAP<STRING, STRUCT<S, N, BOOL, M>>``, older attribute names included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.status import stored_status
from sievework.functions.text import col, utc_text
from sievework.layout import JOB_STATUSES

VALUE_TYPE = "STRUCT<S: STRING, N: STRING, BOOL: BOOLEAN, M: MAP<STRING, STRUCT<N: STRING>>>"
ITEM_TYPE = f"MAP<STRING, {VALUE_TYPE}>"
_ZERO_TIME = "0001-01-01 00:00:00"

# Fixed values: (attribute, kind, column), in item order.  Kinds: S text, N number, D date
# as text, B flag.
FINDING_ITEM = [
    ("id", "S", "id"),
    ("uid", "S", "ingestion_job_id"),
    ("recordVersionId", "N", "record_version_id"),
    ("sourceRecordId", "S", "source_record_id"),
    ("inboundFileName", "S", "inbound_file_name"),
    ("userName", "S", "user_name"),
    ("rowCreatedDateOn", "D", "load_date_utc"),
    ("lastUpdateDateUtc", "D", "last_update_date_utc"),
    ("findingFileName", "S", "finding_file_name"),
    ("findingFileFormat", "S", "finding_file_format"),
    ("findingFileSizeBytes", "N", "finding_file_size_bytes"),
    ("currentFileLocation", "S", "current_file_location"),
    ("findingType", "S", "finding_type"),
    ("originatingDataSystem", "S", "originating_data_system"),
    ("originatingVendorTool", "S", "originating_vendor_tool"),
    ("dataSystem", "S", "source_system_platform"),
    ("errorCategory", "S", "error_category"),
    ("fileLastModifiedOn", "D", "last_modified_date_utc"),
    ("createdDateUtc", "D", "created_date_utc"),
    ("lastAccessedDateUtc", "D", "last_accessed_date_utc"),
    ("detectionDateUtc", "D", "detection_date_utc"),
    ("siteOwner", "S", "site_owner"),
    ("fileOwner", "S", "file_owner"),
    ("riskLevel", "S", "risk_level"),
    ("originalFileLocation", "S", "original_file_location"),
    ("quarantineDateUtc", "D", "quarantine_date_utc"),
    ("restoredDateUtc", "D", "restored_date_utc"),
    ("deletedDateUtc", "D", "deleted_date_utc"),
    ("restorationTicketIdentifier", "S", "restoration_ticket_identifier"),
    ("restorationRequestorEmail", "S", "restoration_requestor_email"),
    ("restorationComment", "S", "restoration_comment"),
    ("status", "S", "status_text"),
    ("errorReason", "S", "error_reason"),
]
AUDIT_ITEM = [
    ("jobId", "S", "job_id"),
    ("uid", "S", "report_uid"),
    ("inboundFileName", "S", "inbound_file_name"),
    ("inboundFileSizeBytes", "N", "file_size_bytes"),
    ("inboundFileContentType", "S", "inbound_file_content_type"),
    ("fileFormat", "S", "file_format"),
    ("s3FolderPath", "S", "s3_folder_path"),
    ("s3FilePath", "S", "source_file_path"),
    ("processingSummaryPath", "S", "metadata_json_path"),
    ("workingFilePath", "S", "working_file_path"),
    ("workingFileFormat", "S", "working_file_format"),
    ("workingFileRecordCount", "N", "working_file_record_count"),
    ("UploadedBy", "S", "uploaded_by"),
    ("userName", "S", "user_name"),
    ("startedBy", "S", "started_by"),
    ("UploadedDisplayName", "S", "uploaded_display_name"),
    ("UploadedEmailId", "S", "uploaded_email_id"),
    ("inboundFileChecksum", "S", "inbound_file_checksum"),
    ("startTimestampUtc", "D", "start_timestamp_utc"),
    ("endTimestampUtc", "D", "end_timestamp_utc"),
    ("status", "S", "status"),
    ("errorMessage", "S", "error_message"),
    ("failureReason", "S", "failure_reason"),
    ("sourceSystem", "S", "source_system"),
    ("triggerType", "S", "trigger_type"),
    ("ingestionMode", "S", "ingestion_mode"),
    ("payloadRecordCount", "N", "payload_record_count"),
    ("totalRecords", "N", "total_records"),
    ("successCount", "N", "success_count"),
    ("rejectCount", "N", "reject_count"),
    ("validationFailureCount", "N", "validation_failure_count"),
    ("findingTypeCounts", "S", "finding_type_counts"),
    ("batchSize", "N", "batch_size"),
    ("totalBatches", "N", "total_batches"),
    ("persistedBatchCount", "N", "persisted_batch_count"),
    ("lastSuccessfulBatchNumber", "N", "last_successful_batch_number"),
    ("lastProcessedRecordCount", "N", "last_processed_record_count"),
    ("checkpointingEnabled", "B", "checkpointing_enabled"),
    ("batchPersistenceRetryCount", "N", "batch_persistence_retry_count"),
    ("maxBatchPersistenceRetryCount", "N", "max_batch_persistence_retry_count"),
    ("isResumeEligible", "B", "is_resume_eligible"),
    ("lastCheckpointUtc", "D", "last_checkpoint_utc"),
    ("checkpointMessage", "S", "checkpoint_message"),
]
REJECTED_ITEM = [
    ("id", "S", "rejected_row_id"),
    ("uid", "S", "job_id"),
    ("inboundFileName", "S", "inbound_file_name"),
    ("sourceRecordId", "S", "source_record_id"),
    ("findingFileName", "S", "finding_file_name"),
    ("findingType", "S", "finding_type"),
    ("userName", "S", "user_name"),
    ("currentFileLocation", "S", "current_file_location"),
    ("dataSystem", "S", "source_system_platform"),
    ("fileOwner", "S", "file_owner"),
    ("siteOwner", "S", "site_owner"),
    ("findingFileFormat", "S", "finding_file_format"),
    ("originatingDataSystem", "S", "originating_data_system"),
    ("originatingVendorTool", "S", "originating_vendor_tool"),
    ("quarantineDate", "S", "quarantine_date"),
    ("Status", "S", "status"),
    ("findingFileSizeBytes", "N", "finding_file_size_bytes"),
    ("recordVersionId", "N", "record_version_id"),
    ("rowCreatedDateOn", "D", "error_date_utc"),
    ("fileLastModifiedOn", "D", "last_modified_date_utc"),
    ("errorCategory", "S", "error_category"),
    ("stackTrace", "S", "stack_trace"),
    ("rowNumber", "N", "row_number"),
    ("fieldName", "S", "field_name"),
    ("rejectedValue", "S", "rejected_value"),
    ("errorReason", "S", "error_reason"),
    ("rawRowJson", "S", "raw_row_json"),
]
CHECKPOINT_ITEM = [
    ("jobId", "S", "job_id"),
    ("inboundFileName", "S", "inbound_file_name"),
    ("userName", "S", "user_name"),
    ("sourceSystem", "S", "source_system"),
    ("triggerType", "S", "trigger_type"),
    ("ingestionMode", "S", "ingestion_mode"),
    ("batchSize", "N", "batch_size"),
    ("totalBatches", "N", "total_batches"),
    ("lastSuccessfulBatchNumber", "N", "last_successful_batch_number"),
    ("lastProcessedRecordCount", "N", "last_processed_record_count"),
    ("persistedBatchCount", "N", "persisted_batch_count"),
    ("successCount", "N", "success_count"),
    ("rejectCount", "N", "reject_count"),
    ("batchPersistenceRetryCount", "N", "batch_persistence_retry_count"),
    ("status", "S", "status"),
    ("isResumeEligible", "B", "is_resume_eligible"),
    ("createdAtUtc", "D", "created_at_utc"),
    ("lastCheckpointUtc", "D", "last_checkpoint_utc"),
    ("failureReason", "S", "failure_reason"),
    ("workingFilePath", "S", "working_file_path"),
    ("workingFileFormat", "S", "working_file_format"),
    ("workingFileRecordCount", "N", "working_file_record_count"),
]
# Older attribute names that are read when the present one is missing.
OLDER_NAMES = {
    "finding": {"uid": "jobId", "rowCreatedDateOn": "loadDateUtc", "fileLastModifiedOn": "lastModifiedDateUtc", "status": "Status"},
    "audit": {
        "uid": "reportUid",
        "inboundFileSizeBytes": "fileSizeBytes",
        "s3FilePath": "sourceFilePath",
        "processingSummaryPath": "metadataJsonPath",
        "UploadedBy": "uploadedBy",
    },
    "rejected": {"uid": "jobId", "Status": "status"},
    "checkpoint": {},
}
SPECS = {"finding": FINDING_ITEM, "audit": AUDIT_ITEM, "rejected": REJECTED_ITEM, "checkpoint": CHECKPOINT_ITEM}
# Columns that stay null when the item lacks them; all other texts become ''.
NULLABLE_TEXT = {
    "finding": {
        "source_record_id",
        "source_system_platform",
        "error_category",
        "site_owner",
        "file_owner",
        "risk_level",
        "original_file_location",
        "restoration_ticket_identifier",
        "restoration_requestor_email",
        "restoration_comment",
    },
    "audit": {
        "working_file_path",
        "working_file_format",
        "error_message",
        "failure_reason",
        "source_system",
        "checkpoint_message",
        "inbound_file_content_type",
        "uploaded_display_name",
        "uploaded_email_id",
        "inbound_file_checksum",
    },
    "rejected": {
        "source_record_id",
        "finding_file_name",
        "finding_type",
        "user_name",
        "quarantine_date",
        "error_category",
        "rejected_value",
        "raw_row_json",
        "current_file_location",
        "source_system_platform",
        "file_owner",
        "site_owner",
        "finding_file_format",
        "stack_trace",
    },
    "checkpoint": {"source_system", "failure_reason", "working_file_path", "working_file_format"},
}
_REQUIRED_DATES = {
    "load_date_utc",
    "last_update_date_utc",
    "start_timestamp_utc",
    "error_date_utc",
    "created_at_utc",
}
_OPTIONAL_NUMBERS = {"finding_file_size_bytes"}


# --- typed attribute helpers ------------------------------------------------------------


def attribute(kind: str, value: Column | str) -> Column:
    """One typed attribute; null when the value is null, so that it can be left out."""
    value = col(value)
    slots = {"S": F.lit(None).cast("string"), "N": F.lit(None).cast("string"), "BOOL": F.lit(None).cast("boolean")}
    if kind == "B":
        slots["BOOL"] = value.cast("boolean")
    elif kind == "D":
        slots["S"] = utc_text(value)
    else:
        slots[kind] = value.cast("string")
    none = F.lit(None).cast("MAP<STRING, STRUCT<N: STRING>>")
    made = F.struct(*[c.alias(n) for n, c in slots.items()], none.alias("M"))
    return F.when(value.isNotNull(), made)


def int_map_attribute(counts: Column | str) -> Column:
    """A map of counts as a nested attribute; left out when empty."""
    counts = col(counts)
    nested = F.transform_values(counts, lambda k, v: F.struct(v.cast("string").alias("N")))
    none = F.lit(None).cast("string")
    made = F.struct(none.alias("S"), none.alias("N"), F.lit(None).cast("boolean").alias("BOOL"), nested.alias("M"))
    return F.when(F.size(counts) > 0, made)


def item(pairs: list[tuple[str, Column]]) -> Column:
    """Item of the given attributes without the missing ones."""
    whole = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[a for _, a in pairs]))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def _get(source: Column | str, names: list[str], slot: str) -> Column:
    return F.coalesce(*[F.try_element_at(col(source), F.lit(n)).getField(slot) for n in names])


def get_text(source: Column | str, *names: str) -> Column:
    return _get(source, list(names), "S")


def get_number(source: Column | str, *names: str) -> Column:
    return _get(source, list(names), "N").try_cast("bigint")


def get_flag(source: Column | str, *names: str) -> Column:
    return F.coalesce(_get(source, list(names), "BOOL"), F.lit(False))


def get_date(source: Column | str, *names: str) -> Column:
    return _get(source, list(names), "S").try_cast("timestamp")


def get_int_map(source: Column | str, name: str) -> Column:
    """Counts stored as JSON text, or as a nested map in older items; empty when absent."""
    as_text = F.from_json(get_text(source, name), "MAP<STRING, BIGINT>")
    nested = F.transform_values(
        F.try_element_at(col(source), F.lit(name)).getField("M"),
        lambda k, v: F.coalesce(v.getField("N").try_cast("bigint"), F.lit(0)),
    )
    return F.coalesce(as_text, nested, F.create_map().cast("MAP<STRING, BIGINT>"))


# --- entities ---------------------------------------------------------------------------


def to_items(df: DataFrame, entity: str) -> DataFrame:
    """Rows of an entity as items (column ``item``), keyed by ``job_id``."""
    defaults = {
        ("finding", "error_category"): F.coalesce("error_category", F.lit("")),
        ("rejected", "finding_type"): F.coalesce("finding_type", F.lit("Error")),
    }
    if entity == "rejected":
        defaults[("rejected", "quarantine_date")] = F.lit("")
        defaults[("rejected", "status")] = F.lit("Error")
        defaults[("rejected", "record_version_id")] = F.lit(0)
    if entity == "audit":
        counts = F.col("finding_type_counts")
        defaults[("audit", "finding_type_counts")] = F.when(F.size(counts) > 0, F.to_json(counts))
    pairs = [
        (name, attribute(kind, defaults.get((entity, column), F.col(column) if column in df.columns else F.lit(None))))
        for name, kind, column in SPECS[entity]
    ]
    return df.select("job_id", item(pairs).alias("item"))


def from_items(items: DataFrame, entity: str, source: str = "item") -> DataFrame:
    """Items of an entity as rows; older attribute names are accepted."""
    older = OLDER_NAMES[entity]
    cols = []
    for name, kind, column in SPECS[entity]:
        names = [name] + ([older[name]] if name in older else [])
        if entity == "audit" and column == "finding_type_counts":
            value = get_int_map(source, name)
        elif kind == "S":
            value = get_text(source, *names)
            if column not in NULLABLE_TEXT[entity] and column not in ("status", "status_text"):
                value = F.coalesce(value, F.lit(""))
        elif kind == "N":
            value = get_number(source, *names)
            if column not in _OPTIONAL_NUMBERS:
                value = F.coalesce(value, F.lit(0))
            if column == "record_version_id":
                value = F.coalesce(get_number(source, name), get_text(source, name).try_cast("bigint"), F.lit(1 if entity == "finding" else 0)).cast("int")
        elif kind == "B":
            value = get_flag(source, *names)
        else:
            value = get_date(source, *names)
            if column in _REQUIRED_DATES or (entity, column) == ("checkpoint", "last_checkpoint_utc"):
                value = F.coalesce(value, F.lit(_ZERO_TIME).cast("timestamp"))
        if entity in ("audit", "checkpoint") and column == "status":
            value = _known_status(value)
        cols.append(value.alias(column))
    if entity == "finding":
        raw = get_text(source, "status", "Status")
        cols = [c for c, (_, _, n) in zip(cols, SPECS[entity]) if n != "status_text"]
        status = stored_status(raw)
        cols += [status.alias("status"), F.coalesce(raw, status).alias("status_text")]
    if entity == "rejected":
        cols = [c for c, (_, _, n) in zip(cols, SPECS[entity]) if n != "status"]
        cols.append(F.coalesce(get_text(source, "Status", "status"), F.lit("")).alias("status"))
    return items.select(*cols)


def _known_status(value: Column) -> Column:
    # Unknown or missing text leaves the default state of a new job.
    table = F.create_map(*[F.lit(x) for s in JOB_STATUSES for x in (s.lower(), s)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit("Started"))


def item_lines(items: DataFrame) -> DataFrame:
    """Items as JSON lines, the form an export has."""
    return items.select(F.to_json("item").alias("value"))


def items_from_lines(lines: DataFrame) -> DataFrame:
    """JSON lines of an export as items."""
    return lines.select(F.from_json("value", ITEM_TYPE).alias("item"))
