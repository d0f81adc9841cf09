"""Identifiers and storage keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import col, is_blank

# Fixed value: name of the per-job document next to the source file.
SUMMARY_NAME = "report-metadata.json"
# Characters a POSIX file name cannot hold.
_UNSAFE = r"[\x00/]"


def report_uid(path: Column | str, received: Column | str) -> Column:
    """Job id of a received file: time of receipt plus 128 bits of the path's hash.

    All files of one run may share a second, so the hash alone has to tell them apart.
    """
    return F.concat(
        F.lit("ING-"),
        F.date_format(col(received), "yyyyMMdd-HHmmss"),
        F.lit("-"),
        F.upper(F.substring(F.sha2(col(path).cast("string"), 256), 1, 32)),
    )


def row_id(job_id: Column | str, row_number: Column | str) -> Column:
    """Deterministic id of a report row, the same on every re-run."""
    return F.sha2(F.concat_ws("|", col(job_id), col(row_number).cast("string")), 256)


def base_name(path: Column | str) -> Column:
    """Last segment of a path, with URL escapes resolved."""
    return F.try_url_decode(F.replace(F.element_at(F.split(col(path), "/"), -1), F.lit("+"), F.lit("%2B")))


def extension(name: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(col(name), r"(\.[^./]+)$", 1))


def folder_prefix(uid: Column | str, received: Column | str) -> Column:
    """``yyyy/MM/<uid>/``"""
    return F.concat(F.date_format(col(received), "yyyy/MM/"), col(uid), F.lit("/"))


def source_key(uid: Column | str, file_name: Column | str, received: Column | str) -> Column:
    """Key of the stored source file."""
    safe = F.when(is_blank(file_name), F.lit("uploaded-file")).otherwise(
        F.trim(F.regexp_replace(col(file_name), _UNSAFE, "_"))
    )
    return F.concat(folder_prefix(uid, received), safe)


def summary_key(uid: Column | str, received: Column | str) -> Column:
    """Key of the per-job summary document."""
    return F.concat(folder_prefix(uid, received), F.lit(SUMMARY_NAME))


def working_key(job_id: Column | str, file_name: Column | str, created: Column | str) -> Column:
    """Key of the Parquet working copy of a job's valid rows."""
    last = F.element_at(F.split(F.coalesce(col(file_name), F.lit("")), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), _UNSAFE, "_")
    return F.concat(
        F.lit("ingestion-working/"),
        F.date_format(col(created), "yyyy/MM/dd/"),
        col(job_id),
        F.lit("/"),
        F.when(is_blank(stem), F.lit("ingestion-working")).otherwise(stem),
        F.lit(".parquet"),
    )
