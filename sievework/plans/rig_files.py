"""Report files made from the rig: CSV folders and workbooks.

A report is a bounded range of a job's rows, so no file (and no task that writes one) grows
with the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.layout import HEADERS, raw_name
from sievework.workspace import tidy

ROWS_PER_REPORT = 20_000
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_NS = "http://schemas.openxmlformats.org"


def with_reports(rig: DataFrame, rows: int = ROWS_PER_REPORT) -> DataFrame:
    """Give every row its report, ``<job>-<range>``."""
    part = F.floor(F.col("row_number") / rows).cast("string")
    return rig.withColumn("report", F.concat("job_id", F.lit("-"), part))


def spelled(header: str, style: int) -> str:
    """Header spelling variants that all mean the same column."""
    if style == 1:
        return header.upper().replace("_", " ")
    if style == 2:
        return header.lower().replace("_", "-")
    return header


def write_csv_reports(rig: DataFrame, path: str, styles: int = 3, rows: int = ROWS_PER_REPORT) -> None:
    """One CSV file per report under ``report=<id>/``.

    Reports differ in header spelling and column order, and every second style carries an
    extra unknown column.
    """
    reports = with_reports(rig, rows).withColumn("_style", F.abs(F.hash("report")) % styles)
    with tidy(rig.sparkSession):
        for style in range(styles):
            turn = 7 * style
            order = HEADERS[turn:] + HEADERS[:turn]
            cols = [F.col(raw_name(h)).alias(spelled(h, style)) for h in order]
            extra = [F.lit("ignored, text").alias("Unknown Column")] if style % 2 else []
            chosen = reports.where(F.col("_style") == style).repartition("report").sortWithinPartitions("report", "row_number")
            chosen.select("report", *cols[:5], *extra, *cols[5:]).write.partitionBy("report").option(
                "header", "true"
            ).option("emptyValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("append").csv(path)


def report_of(path: Column | str = "file_path") -> Column:
    """Report id of a file written by :func:`write_csv_reports` or :func:`workbook_bytes`."""
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"report=([^/]+)/", 1)


def workbook(rows: pd.DataFrame, headers: list[str]) -> bytes:
    """A small XLSX file with inline texts."""
    return workbook_of(rows.itertuples(index=False), headers)


def workbook_of(rows: Iterable[Sequence[str | None]], headers: list[str]) -> bytes:
    """As :func:`workbook`, from rows of texts."""

    def cells(values: Sequence[str | None]) -> str:
        return "".join(
            f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if v else "<c/>" for v in values
        )

    lines = [f'<row r="1">{cells(headers)}</row>']
    lines += [f'<row r="{i}">{cells(r)}</row>' for i, r in enumerate(rows, start=2)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr(
            "xl/workbook.xml",
            f'{_XML}<workbook xmlns="{_NS}/spreadsheetml/2006/main" xmlns:r="{_NS}/officeDocument/2006/relationships">'
            '<sheets><sheet name="Report" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'{_XML}<Relationships xmlns="{_NS}/package/2006/relationships"><Relationship Id="rId1" '
            f'Type="{_NS}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr(
            "xl/worksheets/sheet1.xml",
            f'{_XML}<worksheet xmlns="{_NS}/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>',
        )
    return out.getvalue()


def workbook_bytes(rig: DataFrame, rows: int = 2_000) -> DataFrame:
    """``file_path, content`` of one workbook per report (at most ``rows`` rows each)."""
    names = [raw_name(h) for h in HEADERS]

    def build(report: pa.Table) -> pa.Table:
        path = f"mem:/report={report.column('report')[0].as_py()}/report.xlsx"
        report = report.sort_by("row_number")
        content = workbook_of(zip(*(report.column(n).to_pylist() for n in names)), HEADERS)
        return pa.table({"file_path": [path], "content": [content]})

    reports = with_reports(rig, rows).select("report", "row_number", *names)
    return reports.groupBy("report").applyInArrow(build, "file_path STRING, content BINARY")
