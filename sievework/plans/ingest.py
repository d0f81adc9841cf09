"""Ingestion of a folder of reports: all files of all jobs in one set of plans.

Every step writes a table and the next one reads it, so a lost executor or a failed step
costs a re-read.  Writes replace whole partitions of a job, so any step may run twice.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import workspace as ws
from sievework.functions.paths import row_id
from sievework.functions.text import clean_text
from sievework.layout import (
    AUDIT_SCHEMA,
    BATCH_SIZE,
    CHECKPOINT_SCHEMA,
    FINDING_SCHEMA,
    MAX_BATCH_SIZE,
    MAX_UPLOAD_BYTES,
    MIN_BATCH_SIZE,
    REJECTED_SCHEMA,
    STAGED_DAYS,
)
from sievework.operators import counts as ct
from sievework.operators import numbering as nb
from sievework.operators import resume as rs
from sievework.operators import tables as tb
from sievework.operators.rules import DEFAULT_RULES, Rule, rejected_detail, rejected_rows, valid_rows, validate
from sievework.operators.summary import LONG_LIST, rejected_documents, summary_documents, write_documents, write_rejected_documents
from sievework.operators.typed import drop_blank_rows, typed_findings
from sievework.plans.isolation import FAILURES, Isolation, reason, united
from sievework.sources.intake import intake_manifest, intake_metadata_json, list_files, started_jobs, workbook_listing
from sievework.sources.reports import scan_reports

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """Processing settings."""

    batch_size: int = BATCH_SIZE
    checkpointing: bool = True
    max_retries: int = 3
    retry_delay_ms: int = 1000
    parquet_working: bool = True
    parquet_primary: bool = False
    staging_fallback: bool = True
    batch_groups: int = 1
    progress_interval: int = 1
    rows_per_file: int = nb.SLICE_ROWS
    max_upload_bytes: int = MAX_UPLOAD_BYTES

    @property
    def size(self) -> int:
        return max(min(self.batch_size, MAX_BATCH_SIZE), MIN_BATCH_SIZE)


class Store:
    """Paths of the stored tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, root = spark, root.rstrip("/")
        self.findings, self.rejected = f"{root}/findings", f"{root}/rejected"
        self.working, self.staged = f"{root}/working", f"{root}/staged"
        self.jobs, self.checkpoints = f"{root}/jobs", f"{root}/checkpoints"
        self.summaries, self.rejected_parts = f"{root}/summaries", f"{root}/summary_rejected"
        self.intake = f"{root}/intake"
        self.events, self.timings = f"{root}/events", f"{root}/timings"

    # Stored shape of findings: the layout plus position columns; job and group are partitions.
    FINDING_COLUMNS = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in FINDING_SCHEMA
    ) + ", row_number BIGINT, sequence_number BIGINT, batch_number BIGINT"

    def read_findings(self) -> DataFrame:
        return self._rows(self.findings, self.FINDING_COLUMNS + ", job_id STRING, batch_group BIGINT")

    def read_working(self, group: int | None = None) -> DataFrame:
        """Numbered valid rows; with ``group`` only that group's files are read."""
        rows = self.read_working_groups()
        return (rows if group is None else rows.where(F.col("working_group") == group)).drop("working_group")

    def read_working_groups(self) -> DataFrame:
        """Numbered valid rows with ``working_group``; a condition on it reads only that group's files."""
        return self._rows(self.working, self.FINDING_COLUMNS + ", job_id STRING, working_group INT")

    def read_staged(self) -> DataFrame:
        finding = self.FINDING_COLUMNS.replace(", sequence_number BIGINT", "")
        fields = ", ".join(": ".join(part.split(" ", 1)) for part in finding.split(", "))
        return self._rows(
            self.staged,
            f"sequence_number BIGINT, finding STRUCT<{fields}>, created_at_utc TIMESTAMP, "
            "expires_at TIMESTAMP, job_id STRING, expiry_day DATE",
        ).drop(tb.EXPIRY_DAY)

    def read_rejected(self) -> DataFrame:
        return tb.read_rows(self.spark, self.rejected, REJECTED_SCHEMA)

    def read_jobs(self) -> DataFrame:
        return tb.read_keyed(self.spark, self.jobs, AUDIT_SCHEMA)

    def read_checkpoints(self) -> DataFrame:
        return tb.read_keyed(self.spark, self.checkpoints, CHECKPOINT_SCHEMA)

    def save_jobs(self, rows: DataFrame) -> None:
        tb.upsert_keyed(self.spark, self.jobs, rows, AUDIT_SCHEMA)

    def save_checkpoints(self, rows: DataFrame, now: Column) -> None:
        given = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHECKPOINT_SCHEMA]
        tb.upsert_keyed(self.spark, self.checkpoints, rows.select(*given), CHECKPOINT_SCHEMA, lambda old, new: tb.merged_checkpoints(old, new, now))

    def _rows(self, path: str, schema: str) -> DataFrame:
        return tb.read_rows(self.spark, path, schema)


class Clock:
    """Stage timings of one run."""

    def __init__(self, store: Store, run: str):
        self.store, self.run, self.rows = store, run, []

    def lap(self, stage: str, work: Callable[[], int | None]) -> None:
        start = time.monotonic()
        items = work()
        self.rows.append((self.run, stage, int((time.monotonic() - start) * 1000), items))

    def save(self) -> None:
        frame = self.store.spark.createDataFrame(
            self.rows, "run STRING, stage STRING, elapsed_ms BIGINT, item_count BIGINT"
        )
        frame.coalesce(1).write.mode("append").parquet(self.store.timings)


def checked_shape(now: Column, rules: list[Rule]) -> Callable[[DataFrame], DataFrame]:
    """Row work that runs in the scan itself: typing, blank test and rules, before the one write."""

    def shape(rows: DataFrame) -> DataFrame:
        rows = rows if "row_number" in rows.columns else rows.withColumn("row_number", F.lit(0).cast("bigint"))
        typed = typed_findings(rows, now)
        return validate(typed, now, rules)

    return shape


def ingest_folder(
    spark: SparkSession,
    folder: str | list[str],
    store: Store,
    now: datetime,
    options: Options = Options(),
    job_id: Column | None = None,
    rules: list[Rule] = DEFAULT_RULES,
    write_batch_group: Callable[[DataFrame, str], None] | None = None,
    books: DataFrame | None = None,
    write_working: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """Take in every new file of a folder and ingest it; returns the job records.

    With ids of its own making it passes over files that an earlier run has taken in or refused, and leaves jobs that can be
    resumed to the resume; with ids from the caller it replaces their rows.
    ``write_batch_group`` stands in for the write of one batch group (a custom sink), ``write_working`` for that of the working copy.
    """
    at = F.lit(now)
    with ws.scratch(spark):
        tb.purge_expired(spark, store.staged, now)
        files = list_files(spark, folder)
        if books is not None:
            files = files.unionByName(workbook_listing(books))
        listed = intake_manifest(files, at, options.max_upload_bytes, job_id)
        if job_id is None:
            broken = F.coalesce(F.col("failure_reason").startswith(INTERRUPTED), F.lit(False)) & ~F.coalesce("is_resume_eligible", F.lit(False))
            over = F.col("status").isin("Success", "PartialSuccess") | (F.col("status") == "Failed") & ~broken
            done = store.read_jobs().where(over).select(F.col("job_id").alias("report_uid"))
            listed = listed.join(done, "report_uid", "left_anti")
        manifest = ws.materialise(listed, "manifest")
        refuse_shared_ids(manifest)
        total = manifest.where("accepted").agg(F.sum("file_size_bytes")).first()[0] or 0
        ws.tune(spark, total * _GROWTH)
        write_documents(intake_metadata_json(manifest), store.intake)
        store.save_jobs(started_jobs(manifest))
        return ingest_manifest(spark, manifest, folder, store, now, options, rules, write_batch_group, books, write_working)


class UnknownJob(ValueError):
    """Accepted files whose job record does not exist."""


def refuse_shared_ids(manifest: DataFrame) -> None:
    """Two files under one job id would mix their rows; nothing is written then."""
    twice = manifest.where("accepted").groupBy("report_uid").count().where("count > 1").select("report_uid").take(3)
    if twice:
        raise ValueError(f"several files share a job id: {', '.join(r[0] for r in twice)}")


# Typed rows with ids and status are larger than the text they come from.
_GROWTH = 3


# A failure that says nothing about the file: the job may be taken in anew.
INTERRUPTED = "Interrupted: "


def ingest_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    folder: str | list[str],
    store: Store,
    now: datetime,
    options: Options = Options(),
    rules: list[Rule] = DEFAULT_RULES,
    write_batch_group: Callable[[DataFrame, str], None] | None = None,
    books: DataFrame | None = None,
    write_working: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """Ingest the accepted files of a manifest whose job records exist.

    Every step runs for all jobs at once.  Where it fails, the jobs are halved until the failing ones are alone; these end as
    failed, with the reason, a checkpoint and a summary, and the others go on.
    """
    at, clock = F.lit(now), Clock(store, now.isoformat())
    failed: list[DataFrame] = []

    def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows, heads = scan_reports(files, folder, books, checked_shape(at, rules))
        checked = drop_blank_rows(rows).drop("file_path").withColumn("id", row_id("job_id", "row_number"))
        states = _job_states(store, heads, ct.job_totals(checked).drop("coerced_null_fields"), options, at)
        return checked, ws.materialise(states, "states")

    def scanned() -> int:
        read.run(accepted, scan)
        return sum(jobs.agg(F.sum("total_records")).first()[0] or 0 for _, (_, jobs) in read.passed)

    def step(name: str, work: Callable[[DataFrame], object]) -> None:
        nonlocal jobs
        outcome = Isolation()
        clock.lap(name, lambda: len(outcome.run(jobs, work).failed))
        if outcome.failed:
            failed.extend(_because(some, f"{INTERRUPTED}{name.replace('_', ' ')}: {reason(error)}") for some, error in outcome.failed)
            jobs = ws.materialise(united([some for some, _ in outcome.passed] or [jobs.limit(0)]), "states")

    accepted, read = manifest.where("accepted"), Isolation("report_uid")
    clock.lap("scan_and_validate", scanned)
    for files, error in read.failed:
        heads = files.select(F.col("report_uid").alias("job_id"), F.lit(None).cast("string").alias("header_error"))
        states = _job_states(store, heads, spark.createDataFrame([], _TOTALS), options, at)
        failed.append(_because(ws.materialise(states, "states"), f"{INTERRUPTED}reading: {reason(error)}"))
    if not read.passed:
        return _closed(store, failed, [], at, clock)
    checked, jobs = united([rows for _, (rows, _) in read.passed]), united([states for _, (_, states) in read.passed])

    def of(some: DataFrame) -> DataFrame:
        """Rows of some of the jobs; those of all of them need no join."""
        return checked if some is jobs and not failed else checked.join(some.select("job_id"), "job_id", "left_semi")

    store.save_checkpoints(rs.checkpoint_rows(united([jobs, *failed]), F.lit("Started"), at), at)
    step("rejected_rows", lambda some: _write_rejected(store, of(some), some, at, rules, options))
    working = Working(store, options, at, write_working)
    clock.lap("working_store", lambda: working.write(of, jobs))
    step("staged_rows", lambda some: working.stage(of, some))
    ws.drop_tables(spark, "records", "sheets")  # from here on the stores hold the rows
    jobs, without = working.split(jobs)
    failed.extend(without)
    done, unwritten = write_groups(store, working.source(), jobs, options, at, write_batch_group, clock)
    return _closed(store, [*failed, *unwritten], [done], at, clock)


def _because(state: DataFrame, why: str) -> DataFrame:
    return state.withColumn("_why", F.lit(why))


def _closed(store: Store, failed: list[DataFrame], done: list[DataFrame], at: Column, clock: Clock) -> DataFrame:
    """Final records, summaries and events of all jobs of a run."""
    parts = [finish(store, united(done), at)] if done else []
    if failed:
        parts.append(finish_failed(store, united(failed), F.col("_why"), at))
    finished = united(parts)
    outcome = Isolation()
    clock.lap("summary", lambda: len(outcome.run(finished, lambda some: write_summaries(store, some)).failed))
    if outcome.failed:
        unsaid = [_because(some, f"{INTERRUPTED}summary: {reason(error)}") for some, error in outcome.failed]
        parts = [some for some, _ in outcome.passed] + [finish_failed(store, united(unsaid), F.col("_why"), at)]
        finished = ws.materialise(united(parts), "finished", keep=True)
    clock.lap("staging_cleanup", lambda: clean_staging(store, finished))
    record_events(store, finished, at)
    clock.save()
    return finished


# What the counts of a file that could not be read are taken from.
_TOTALS = "job_id STRING, success_count BIGINT, reject_count BIGINT, source_system STRING, finding_type_counts MAP<STRING, BIGINT>"


def _job_states(
    store: Store, files: DataFrame, totals: DataFrame, options: Options, at: Column
) -> DataFrame:
    """State of every job after the scan: its counts, or why its file was refused."""
    records = store.read_jobs().select(
        "job_id", *[c for c in AUDIT_SCHEMA.names if c not in STATE_COLUMNS and c != "job_id"]
    )
    unknown = files.join(records, "job_id", "left_anti").select("job_id").take(3)
    if unknown:
        raise UnknownJob(f"no job record for {', '.join(r[0] for r in unknown)}")
    zero = F.lit(0).cast("bigint")
    joined = files.select("job_id", "header_error").join(totals, "job_id", "left").join(records, "job_id", "inner")
    success, rejected = F.coalesce("success_count", zero), F.coalesce("reject_count", zero)
    parquet = F.lit(options.parquet_working) & (success > 0)
    return joined.withColumns(
        {
            "success_count": success,
            "reject_count": rejected,
            "total_records": success + rejected,
            "payload_record_count": success + rejected,
            "validation_failure_count": rejected,
            "source_system": F.coalesce("source_system", F.lit("Unknown")),
            "finding_type_counts": F.coalesce("finding_type_counts", F.create_map().cast("map<string,bigint>")),
            "trigger_type": F.lit("StepFunction"),
            "ingestion_mode": F.lit("Full"),
            "start_timestamp_utc": at,
            "end_timestamp_utc": F.lit(None).cast("timestamp"),
            "batch_size": F.lit(options.size).cast("bigint"),
            "total_batches": nb.batch_count(success, F.lit(options.size)),
            "persisted_batch_count": zero,
            "last_successful_batch_number": zero,
            "last_processed_record_count": zero,
            "checkpointing_enabled": F.lit(options.checkpointing),
            "batch_persistence_retry_count": zero,
            "max_batch_persistence_retry_count": F.lit(options.max_retries).cast("bigint"),
            "is_resume_eligible": F.lit(False),
            "last_checkpoint_utc": at,
            "checkpoint_message": F.lit(None).cast("string"),
            "status": F.lit("Started"),
            "error_message": F.col("header_error"),
            "failure_reason": F.col("header_error"),
            "working_file_format": F.when(parquet, F.lit("parquet")),
            "working_file_path": F.when(parquet, F.concat(F.lit(f"{store.working}/job_id="), "job_id")),
            "working_file_record_count": F.when(parquet, success).otherwise(zero),
        }
    )


STATE_COLUMNS = {
    "success_count",
    "reject_count",
    "total_records",
    "payload_record_count",
    "validation_failure_count",
    "source_system",
    "finding_type_counts",
    "trigger_type",
    "ingestion_mode",
    "start_timestamp_utc",
    "end_timestamp_utc",
    "batch_size",
    "total_batches",
    "persisted_batch_count",
    "last_successful_batch_number",
    "last_processed_record_count",
    "checkpointing_enabled",
    "batch_persistence_retry_count",
    "max_batch_persistence_retry_count",
    "is_resume_eligible",
    "last_checkpoint_utc",
    "checkpoint_message",
    "status",
    "error_message",
    "failure_reason",
    "working_file_format",
    "working_file_path",
    "working_file_record_count",
}


def job_ids(jobs: DataFrame) -> list[str]:
    """Ids of the jobs of one run: one per file, like the file listing the driver holds anyway."""
    return [r[0] for r in jobs.select("job_id").collect()]


def _write_rejected(
    store: Store, checked: DataFrame, jobs: DataFrame, at: Column, rules: list[Rule], options: Options
) -> None:
    tb.delete_job_rows(store.spark, store.rejected, job_ids(jobs))
    rows = rejected_detail(rejected_rows(checked, at, rules), at)
    spread = tb.spread_for_write(rows, options.rows_per_file, "row_number")
    tb.replace_partitions(spread, store.rejected, ["job_id"])


def _numbered(checked: DataFrame, options: Options) -> DataFrame:
    valid = valid_rows(checked).select("job_id", *FINDING_SCHEMA.names, "row_number")
    return nb.with_batches(nb.sequence_numbers(valid, slice_rows=options.rows_per_file), options.size)


def with_groups(numbered: DataFrame, jobs: DataFrame, groups: int) -> DataFrame:
    """Add ``working_group``: the batch group a row is written in, of ``groups`` groups of whole batches of its job."""
    if groups == 1:
        return numbered.withColumn("working_group", F.lit(1))
    group = F.ceil(F.col("batch_number") * groups / F.col("_total")).cast("int")
    return numbered.join(jobs.select("job_id", F.col("total_batches").alias("_total")), "job_id").withColumn("working_group", group).drop("_total")


class CopyDiffers(RuntimeError):
    """A copy that does not hold the rows it was made from."""


# What the working store of a job may be.
_IN_PARQUET, _IN_STAGING = ("parquet", "both"), ("staging", "both")


class Working:
    """The numbered valid rows of all jobs, kept where the batch writes and a resume find them.

    Each job gets its own outcome: a Parquet copy that could not be written, or that differs from its source when it is read back, is replaced
    by staged rows where these are allowed; a job without either fails alone.
    """

    def __init__(self, store: Store, options: Options, at: Column, write: Callable[[DataFrame, str], None] | None = None):
        self.store, self.options, self.at = store, options, at
        # Numbering already brought whole slices of a job together: no further shuffle.
        self.copy = write or (lambda rows, path: tb.replace_partitions(rows, path, ["job_id", "working_group"]))
        self.choices: DataFrame | None = None
        self.kinds: set[str] = set()  # the choices that occur, five at most

    def write(self, of: Callable[[DataFrame], DataFrame], jobs: DataFrame) -> int:
        """Write and verify the Parquet copies, and choose the store of every job; returns the sets that failed."""
        options, outcome = self.options, Isolation()
        ids = job_ids(jobs)
        tb.delete_job_rows(self.store.spark, self.store.working, ids)
        tb.delete_job_rows(self.store.spark, self.store.staged, ids)
        if options.parquet_working:
            outcome.run(jobs, lambda some: self._write_copy(of(some), some))
        for some, _ in outcome.failed:  # what is left of a copy must not be taken for one
            tb.delete_job_rows(self.store.spark, self.store.working, job_ids(some))
        why = F.lit(None).cast("string")
        lost = [some.select("job_id", F.lit(reason(error)).alias("_copy_error")) for some, error in outcome.failed]
        told = jobs.join(united(lost), "job_id", "left") if lost else jobs.withColumn("_copy_error", why)
        flags = [F.lit(o) for o in (options.parquet_working, options.parquet_primary, options.staging_fallback)]
        choice = rs.working_store(*flags, F.col("_copy_error").isNotNull(), F.col("success_count"))
        self.choices = ws.materialise(told.select("job_id", "_copy_error", choice.alias("working_store")), "stores")
        self.kinds = {r[0] for r in self.choices.select("working_store").distinct().collect()}
        return len(outcome.failed)

    def _write_copy(self, checked: DataFrame, jobs: DataFrame) -> None:
        self.copy(with_groups(_numbered(checked, self.options), jobs, self.options.batch_groups), self.store.working)
        wanted = _told_apart(valid_rows(checked).select("job_id", "id", "row_number"))
        found = _told_apart(self.store.read_working().join(jobs.select("job_id"), "job_id", "left_semi"))
        unlike = wanted.join(found, ["job_id", "_rows", "_sum"], "left_anti").select("job_id").first()
        if unlike:
            raise CopyDiffers(f"the Parquet copy of {unlike[0]} does not hold the rows it was made from")

    def stage(self, of: Callable[[DataFrame], DataFrame], jobs: DataFrame) -> None:
        """Write the staged rows of the jobs that need them."""
        chosen = jobs.select("job_id").join(self.choices, "job_id")
        copied = chosen.where(F.col("working_store") == "both").select("job_id")
        fresh = chosen.where(F.col("working_store") == "staging").select("job_id")
        parts = []
        if "both" in self.kinds:
            parts.append(self.store.read_working().join(copied, "job_id", "left_semi"))
        if "staging" in self.kinds:
            parts.append(_numbered(of(jobs).join(fresh, "job_id", "left_semi"), self.options))
        if parts:
            rows = united([p.select("job_id", "sequence_number", *_finding_fields()) for p in parts])
            tb.write_staged(tb.staged_rows(rows, self.at, STAGED_DAYS), self.store.staged)

    def split(self, jobs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The jobs with a store, their records saying which, and those that have none."""
        told = jobs.join(self.choices, "job_id")
        kept = F.col("working_store").isin(*_IN_PARQUET)
        fields = {
            "working_file_format": F.when(kept, F.col("working_file_format")),
            "working_file_path": F.when(kept, F.col("working_file_path")),
            "working_file_record_count": F.when(kept, F.col("working_file_record_count")).otherwise(F.lit(0).cast("bigint")),
        }
        told = ws.materialise(told.withColumns(fields).withColumnRenamed("working_store", "_store"), "states")
        why = F.concat(F.lit(NO_STORE), F.coalesce(F.concat(F.lit(" Parquet: "), "_copy_error"), F.lit("")))
        without = told.where("_store = 'error'")
        failed = [] if "error" not in self.kinds else [without.withColumn("_why", why).drop("_store", "_copy_error")]
        return told.where("_store <> 'error'").drop("_store", "_copy_error"), failed

    def source(self) -> Callable[[int], DataFrame]:
        """Rows of a batch group: one group's files of the Parquet copies, and the staged rows of jobs without a copy.

        The stores are complete by now, so their folders are listed once for all groups and attempts.
        """
        copies = self.store.read_working_groups()
        columns = copies.drop("working_group").columns
        if "staging" in self.kinds:
            staged = self.choices.where("working_store = 'staging'").select("job_id")
            others = from_staged(self.store.read_staged()).join(staged, "job_id", "left_semi").select(*columns)

        def rows(group: int) -> DataFrame:
            own = copies.where(F.col("working_group") == group).drop("working_group")
            return own.unionByName(others) if "staging" in self.kinds else own

        return rows


NO_STORE = "Neither a Parquet copy nor a staged copy may be kept, so the job could not be resumed later."


def _told_apart(rows: DataFrame) -> DataFrame:
    """Number and order-free checksum of the rows of each job."""
    mark = F.xxhash64("job_id", "id", "row_number").cast("decimal(38,0)")
    return rows.groupBy("job_id").agg(F.count("*").alias("_rows"), F.sum(mark).alias("_sum"))


def _finding_fields() -> list[str]:
    return [*FINDING_SCHEMA.names, "row_number", "batch_number"]


def from_staged(staged: DataFrame) -> DataFrame:
    """Staged rows back in the shape of the working copy."""
    return staged.select("job_id", "sequence_number", "finding.*")


def default_writer() -> Callable[[DataFrame, str], None]:
    return lambda rows, path: tb.replace_partitions(rows, path, ["job_id", "batch_group"])


class Incomplete(RuntimeError):
    """A batch group whose stored rows are not the rows it should have."""


def _check_complete(store: Store, cut: DataFrame, group: int) -> None:
    """Compare the stored rows of a group with its share of each job before the checkpoint moves."""
    due = F.least("success_count", F.col("_last") * F.col("batch_size")) - F.least("success_count", F.col("_first") * F.col("batch_size"))
    wanted = cut.select("job_id", (F.col("_first") + 1).alias("batch_group"), due.alias("_due"))
    stored = store.read_findings().select("job_id", "batch_group").join(wanted, ["job_id", "batch_group"]).groupBy("job_id").agg(F.count("*").alias("_rows"))
    short = wanted.join(stored, "job_id", "left").where("_due <> coalesce(_rows, 0)").first()
    if short:
        raise Incomplete(f"group {group} of {short['job_id']} has {short['_rows'] or 0} of {short['_due']} rows")


def write_groups(
    store: Store,
    source: Callable[[int], DataFrame],
    jobs: DataFrame,
    options: Options,
    at: Column,
    write: Callable[[DataFrame, str], None] | None,
    clock: Clock,
    resume: bool = False,
) -> tuple[DataFrame, list[DataFrame]]:
    """Write the numbered rows group by group, a checkpoint after each; returns the states of the jobs that are through, and of those that failed.

    A group is a range of batches of every job; a group's partition is named by its first
    batch, so a repeated write replaces exactly itself.  What the library's own writer stored is counted before the
    checkpoint moves; a sink of the caller's answers for itself.
    """
    if not resume:
        tb.delete_job_rows(store.spark, store.findings, job_ids(jobs))
    groups, state, failed = options.batch_groups, jobs, []
    todo = F.col("total_batches") - F.col("_from")
    start = jobs.select("job_id", F.col("last_successful_batch_number").alias("_from"))
    for g in range(1, groups + 1):
        # Batches (first, last] of this group, per job.
        cut = state.join(start, "job_id").withColumns(
            {
                "_first": (F.col("_from") + F.floor(todo * (g - 1) / groups)).cast("bigint"),
                "_last": (F.col("_from") + F.floor(todo * g / groups)).cast("bigint"),
            }
        ).drop("_from")
        cut, outcome, first = ws.materialise(cut, "cut"), Isolation(), g

        def put(some: DataFrame) -> int:
            bounds = some.select("job_id", "_first", "_last")
            rows = (
                source(first)
                .join(bounds, "job_id")
                .where("batch_number > _first AND batch_number <= _last")
                .withColumn("batch_group", F.col("_first") + 1)
                .drop("_first", "_last")
            )
            retries = _with_retry(write or default_writer(), rows, store.findings, options)
            if write is None:
                _check_complete(store, some, first)
            return retries

        due = cut.where("_last > _first")
        if not due.isEmpty():
            clock.lap(f"findings_group_{g}", lambda: len(outcome.run(due, put).failed))
        retries = F.col("batch_persistence_retry_count")
        reached = [some.withColumn("batch_persistence_retry_count", retries + n) for some, n in outcome.passed]
        for some, error in outcome.failed:
            n = getattr(error, "retries", 0)
            why = f"{INTERRUPTED}batch group {g} of {groups} was not stored, after {n} more attempt(s): {reason(error)}"
            lost = some.withColumn("batch_persistence_retry_count", retries + n).drop("_first", "_last")
            failed.append(_because(lost, why))
        state = ws.materialise(
            united([cut.where("_last = _first"), *reached])
            .withColumns(
                {
                    "last_successful_batch_number": F.col("_last"),
                    "persisted_batch_count": F.col("_last"),
                    "last_processed_record_count": F.least(F.col("success_count"), F.col("_last") * F.col("batch_size")),
                }
            )
            .drop("_first", "_last"),
            "states",
        )
        if options.checkpointing:
            store.save_checkpoints(rs.checkpoint_rows(state, F.lit("Started"), at), at)
            if g % max(options.progress_interval, 1) == 0 and g < groups:
                # After the last group the final job record follows at once.
                store.save_jobs(state)
    return state, failed


class _GaveUp(RuntimeError):
    """A write that kept failing."""

    def __init__(self, message: str, retries: int):
        super().__init__(message)
        self.retries = retries


def _with_retry(write: Callable[[DataFrame, str], None], rows: DataFrame, path: str, options: Options) -> int:
    """Run an idempotent write, again after a failure, with growing pauses; returns the retries."""
    for attempt in range(options.max_retries + 1):
        try:
            write(rows, path)
            return attempt
        except FAILURES as error:
            if attempt == options.max_retries:
                raise _GaveUp(reason(error), attempt) from error
            time.sleep(options.retry_delay_ms * 2**attempt / 1000)
    raise AssertionError("unreachable")


def finish(store: Store, state: DataFrame, at: Column) -> DataFrame:
    """Final status, message, checkpoint and job record of every job."""
    refused = F.col("header_error").isNotNull() if "header_error" in state.columns else F.lit(False)
    status = ct.job_status(F.col("success_count"), F.col("reject_count"))
    message = F.when(refused, F.concat(F.lit("Not taken in: "), "failure_reason")).otherwise(
        ct.job_message(F.col("status"), F.col("success_count"), F.col("reject_count"))
    )
    done = ws.materialise(
        state.withColumns({"status": status, "end_timestamp_utc": at, "checkpoint_message": F.lit("Checkpoint written.")})
        .withColumn("message", message)
        .withColumn("response_class", ct.response_class(F.col("status"), F.col("total_records"))),
        "finished",
        keep=True,
    )
    store.save_checkpoints(rs.checkpoint_rows(done, F.col("status"), at, F.col("failure_reason")), at)
    store.save_jobs(done)
    return done


def finish_failed(store: Store, state: DataFrame, why: Column, at: Column) -> DataFrame:
    """Failed job records and checkpoints; jobs with rows left stay resumable."""
    failed = rs.failed_state(state, why, at).withColumn("message", F.concat(F.lit("Not taken in: "), "failure_reason"))
    failed = ws.materialise(
        failed.withColumn("response_class", ct.response_class(F.col("status"), F.col("total_records"))).drop("_why"), "failed", keep=True
    )
    store.save_checkpoints(rs.checkpoint_rows(failed, F.lit("Failed"), at, F.col("failure_reason")), at)
    store.save_jobs(failed)
    return failed


def write_summaries(store: Store, finished: DataFrame) -> None:
    """Summary document per job, and its rejected rows as list parts."""
    write_documents(summary_documents(finished), store.summaries)
    tb.delete_job_rows(store.spark, store.rejected_parts, job_ids(finished))
    records = F.coalesce("reject_count", F.lit(0))
    rejected, slot, long = store.read_rejected(), F.pmod(F.xxhash64("job_id"), F.lit(LIST_SLOTS)), records > LONG_LIST
    sizes = finished.groupBy(slot.alias("slot"), long.alias("long")).agg(F.sum(records)).collect()
    for packed in (False, True):
        for some in portions(sorted((s, n) for s, is_long, n in sizes if is_long == packed), LIST_ROWS):
            jobs = finished.where((long == F.lit(packed)) & slot.isin(some)).select("job_id")
            mine = rejected.where(slot.isin(some)).join(jobs, "job_id", "left_semi")
            write_rejected_documents(rejected_documents(ct.rejected_lists(mine)), store.rejected_parts, packed)


# Rejected records whose lists are made at once, so that what is exchanged for them does not grow with the run; jobs go by the
# hash of their id, this many values of it, of which the driver gets the sizes.
LIST_ROWS = 1_000_000
LIST_SLOTS = 1024


def portions(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Keys in order, cut into runs of at most ``most`` in all; a key beyond that is a run of its own."""
    out, total = [], most + 1
    for key, size in sizes:
        if total + size > most:
            out.append([])
            total = 0
        out[-1].append(key)
        total += size
    return out


def clean_staging(store: Store, finished: DataFrame) -> None:
    """Staged rows of completed jobs go; a failure to remove them is no failure of the job."""
    try:
        tb.delete_job_rows(store.spark, store.staged, job_ids(rs.cleanup_jobs(finished)))
    except FAILURES as error:
        log.warning("staged rows of finished jobs were not removed: %s", reason(error))


def record_events(store: Store, finished: DataFrame, at: Column, event: str = "IngestionJobCompleted") -> None:
    """Append one business event per job."""
    details = F.to_json(
        F.struct("total_records", "success_count", "reject_count", "working_file_format", "working_file_record_count")
    )
    finished.select(
        F.lit(event).alias("event_type"),
        F.col("job_id").alias("entity_id"),
        F.coalesce(F.nullif(clean_text("uploaded_by"), F.lit("")), F.lit("system")).alias("actor"),
        F.col("status").alias("outcome"),
        details.alias("details"),
        at.alias("recorded_at_utc"),
    ).write.mode("append").parquet(store.events)
