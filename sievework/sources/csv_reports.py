"""Bulk scan of CSV reports: every file of a folder in one plan, whatever its header order.

1. A light text pass finds the number of each file's header line and whether a quoted field spans lines; a second one
   fetches those lines only.
2. One scan splits all files by lines and lets ``from_csv`` read each record by position;
   the file's own header decides which position is which column.
3. The result is written once and numbered from that table (see ``record_numbers``).

Files with quoted line breaks cannot be split by lines; they take Spark's multi-line reader
(one task per file, and intake bounds the size of a file).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.layout import RAW_COLUMNS
from sievework.operators.headers import check_headers
from sievework.operators.numbering import record_numbers, record_offsets
from sievework.workspace import materialise

_GLOB = "*.[cC][sS][vV]"
_CSV = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
# A quoted field that starts right after a separator and ends right before one.
_QUOTED = r'(?<=^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
# A quoted field that is still open at the end of the line.
_OPEN = r'(?:^|,)"[^"]*+(?:""[^"]*+)*+$'
_TOKEN = r'(?<=^|,)(?:"[^"]*+(?:""[^"]*+)*+"|[^,]*)(?=,|$)'
# A line of nothing but plain and well-formed quoted fields; one anchored pass without backtracking.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_WELL_FORMED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
# In such a line every quote opens a field, so the fields are found without looking around them.
_ANY_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
NO_CSV_HEADER = "The CSV file has no header line."


def accepted_paths(manifest: DataFrame, file_format: str = "csv") -> list[str]:
    """Paths of the accepted files of a format, as a reader takes them; the driver holds the listing of a folder for any scan."""
    rows = manifest.where(F.col("accepted") & (F.col("file_format") == file_format)).select("file_path").collect()
    return [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(r[0])) for r in rows]


def _lines(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Non-empty lines with the block they lie in and an increasing number inside it."""
    if not folder:
        return spark.createDataFrame([], "value STRING, file_path STRING, block_start BIGINT, line_id BIGINT")
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _GLOB)
        .text(folder)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )
    return text.where(F.length("value") > 0).withColumn("line_id", F.monotonically_increasing_id())


def _spanning_records(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Records as raw text, line breaks in quoted fields included.

    The reader is given one column, so it reports every longer record whole.
    """
    return (
        spark.read.schema("_only STRING, _record STRING")
        .options(**_CSV, columnNameOfCorruptRecord="_record", multiLine="true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _GLOB)
        .csv(folder)
        .select(
            F.coalesce("_record", "_only", F.lit("")).alias("value"),
            F.col("_metadata.file_path").alias("file_path"),
            F.lit(0).cast("bigint").alias("block_start"),
            F.monotonically_increasing_id().alias("line_id"),
        )
    )


def header_tokens(line: Column) -> Column:
    """Cells of a header line."""
    plain = F.split(line, ",", -1)
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.when(
            t.startswith('"'), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(t),
    )
    return F.when(line.contains('"'), quoted).otherwise(plain)


def _residue(record: Column) -> Column:
    """The record without its well-formed quoted fields."""
    return (
        F.when(~record.contains('"'), record)
        .when(record.rlike(_WELL_FORMED), F.regexp_replace(record, _ANY_QUOTED, ""))
        .otherwise(F.regexp_replace(record, _QUOTED, ""))
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """Per file the number of its first line, and whether a quoted field spans lines in it.

    Only numbers are aggregated, block by block and then file by file, so no text is sorted or exchanged.
    """
    value = F.col("value")
    left_open = value.contains('"') & ~value.rlike(_WELL_FORMED) & _residue(value).rlike(_OPEN)
    blocks = lines.groupBy("file_path", "block_start").agg(F.min("line_id").alias("line_id"), F.max(left_open).alias("spans_lines"))
    # Block and line as one number: the line is its lower 63 bits.
    order = F.expr("cast(block_start as decimal(19, 0)) * 9223372036854775808 + line_id")
    files = blocks.groupBy("file_path").agg(F.min(order).alias("_order"), F.max("spans_lines").alias("spans_lines"))
    return files.select(F.expr("cast(_order % 9223372036854775808 as bigint)").alias("line_id"), "spans_lines")


def csv_headers(lines: DataFrame) -> DataFrame:
    """Header line of every non-empty file, and whether a quoted field spans lines in it.

    Line numbers are unique over all files and the same in every scan of them, so the texts of the headers are fetched by
    number alone: 9 bytes a file, a broadcast for about a million files.
    """
    found = materialise(first_lines(lines), "first-lines")
    return lines.join(found, "line_id").select(
        "file_path",
        header_tokens(F.regexp_replace("value", "^\\x{FEFF}", "")).alias("headers"),
        "spans_lines",
    )


def checked_headers(manifest: DataFrame, folder: str | list[str], lines: DataFrame | None = None) -> DataFrame:
    """Accepted CSV files with their header verdict; files without any line have no header.

    ``lines`` are the lines of the folder where a caller has listed it already.
    """
    accepted = manifest.where("accepted AND file_format = 'csv'").select(
        "file_path", F.col("report_uid").alias("job_id"), F.col("inbound_file_name").alias("source_file_name")
    )
    found = csv_headers(_lines(manifest.sparkSession, folder) if lines is None else lines)
    files = accepted.join(found, "file_path", "left")
    checked = check_headers(files)
    return checked.withColumn(
        "header_error",
        F.when(F.col("headers").isNull(), F.lit(NO_CSV_HEADER)).otherwise(
            F.concat(F.lit("CSV header refused: "), "header_error")
        ),
    )


def _field_count(record: Column) -> Column:
    """Fields of a record, or -1 when a quote stands where none may."""
    residue = _residue(record)
    commas = F.length(residue) - F.length(F.replace(residue, F.lit(","), F.lit("")))
    return F.when(residue.contains('"'), F.lit(-1)).otherwise(commas + 1)


def _fields(record: Column, width: int) -> Column:
    """Fields of a record as an array; only records with quotes (or what the parser takes for a comment) need the CSV parser."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(record, ", ".join(f"{n} STRING" for n in names), _CSV)
    quoted = F.transform(F.array(parsed), lambda r: F.array(*[r.getField(n) for n in names]))
    return F.when(record.contains('"') | record.contains("\0"), F.get(quoted, F.lit(0))).otherwise(F.split(record, ",", -1))


def _by_position(fields: Column) -> list[Column]:
    return [
        F.coalesce(F.get(fields, F.get(F.col("positions"), F.lit(i)) - 1), F.lit("")).alias(c)
        for i, c in enumerate(RAW_COLUMNS)
    ]


def csv_records(lines: DataFrame, folder: str | list[str], files: DataFrame) -> DataFrame:
    """Records of all good files, by column name, with malformed ones marked.

    ``files`` is a written table of checked headers, so its size is known to Spark: while it
    is small it is broadcast, beyond that it is joined by shuffle (a file is bounded by
    intake, hence so is a join key).
    """
    good = files.where("header_error IS NULL").select(
        "file_path",
        "job_id",
        "source_file_name",
        "positions",
        "spans_lines",
        F.array_max("positions").alias("needed"),
    )
    widest = good.agg(F.coalesce(F.max("needed"), F.lit(1)), F.coalesce(F.bool_or("spans_lines"), F.lit(False))).first()
    spanning = good.where("spans_lines")
    lines = lines.join(good.where("NOT spans_lines"), "file_path")
    if widest[1]:
        lines = lines.unionByName(_spanning_records(files.sparkSession, folder).join(spanning, "file_path"))
    value = F.col("value")
    return lines.withColumns({"_fields": _fields(value, widest[0]), "_count": _field_count(value)}).select(
        "file_path",
        "block_start",
        "line_id",
        "job_id",
        "source_file_name",
        *_by_position(F.col("_fields")),
        (F.col("_count") < F.col("needed")).alias("malformed"),
    )


def scan_csv_reports(
    manifest: DataFrame,
    folder: str | list[str],
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(report rows, checked headers) of all accepted CSV files under ``folder``.

    Rows carry ``job_id``, ``row_number`` (the header is record 1), the known columns as text
    and ``malformed``.  ``shape`` is row work to do before the one write; it must keep
    ``file_path``, ``block_start`` and ``line_id``.
    """
    folder = accepted_paths(manifest)  # refused files are never opened
    lines = _lines(manifest.sparkSession, folder)  # lists the files once
    files = materialise(checked_headers(manifest, folder, lines), "headers")
    records = csv_records(lines, folder, files)
    written = materialise(shape(records) if shape else records, "records")
    offsets = materialise(record_offsets(written), "offsets")
    numbered = record_numbers(written.drop("row_number"), offsets).where("row_number > 1")
    return numbered.drop("block_start", "line_id"), files
