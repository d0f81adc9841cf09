"""Bulk scan of XLSX reports: one workbook per record, decoded where Spark placed it.

This is the only Python-side function of the library; Spark has no workbook reader.  A
workbook is bounded by the intake size limit and its rows leave in small batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.layout import RAW_COLUMNS
from sievework.operators.headers import check_headers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BATCH = 5000
# Built-in number formats that show dates and times.
_DATE_FORMATS = {"14", "15", "16", "17", "18", "19", "20", "21", "22", "45", "46", "47"}
# The last row of a workbook that cannot be read to its end has only ``error``.
SHEET_SCHEMA = "file_path STRING, row_number BIGINT, cells MAP<INT, STRING>, error STRING"
_SHEET_COLUMNS = ["file_path", "row_number", "cells", "error"]
_CELLS = pa.map_(pa.int32(), pa.string())
UNREADABLE = "The workbook cannot be read: "
NO_XLSX_HEADER = "The workbook has no header row."


_ROW, _CELL, _VALUE, _TEXT = (f"{_MAIN}{tag}" for tag in ("row", "c", "v", "t"))


def _texts(node: ElementTree.Element) -> str:
    if len(node) == 1 and len(node[0]) == 1 and node[0][0].tag == _TEXT and not len(node[0][0]):  # one text, as most cells have
        return node[0][0].text or ""
    return "".join(t.text or "" for t in node.iter(_TEXT))


def _column(ref: str) -> int:
    number = 0
    for ch in ref:
        if ch.isdigit():
            break
        number = number * 26 + ord(ch) - 64
    return number


def _first_sheet(book: zipfile.ZipFile, workbook: ElementTree.Element) -> str:
    sheet = workbook.find(f"{_MAIN}sheets/{_MAIN}sheet")
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == sheet.get(_LINK))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """Indexes of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    styles = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {
        f.get("numFmtId")
        for f in styles.iter(f"{_MAIN}numFmt")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.IGNORECASE)
    }
    formats = styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")
    return {str(i) for i, f in enumerate(formats) if f.get("numFmtId") in own or f.get("numFmtId") in _DATE_FORMATS}


def _first_day(workbook: ElementTree.Element) -> datetime:
    """Day zero of the workbook's dates; workbooks may count from 1904."""
    properties = workbook.find(f"{_MAIN}workbookPr")
    late = properties is not None and properties.get("date1904", "0").lower() in ("1", "true")
    return datetime(1904, 1, 1) if late else datetime(1899, 12, 30)


def _date_text(serial: str, first_day: datetime) -> str:
    try:
        at = first_day + timedelta(seconds=round(float(serial) * 86400))
    except (ValueError, OverflowError):
        return serial
    return at.strftime("%Y-%m-%d %H:%M:%S")


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[str], first_day: datetime) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    value = cell.find(_VALUE)
    text = value.text or "" if value is not None else ""
    if kind == "s" and text:
        return shared[int(text)]
    if kind == "b":
        return "TRUE" if text == "1" else "FALSE"
    return _date_text(text, first_day) if text and kind in (None, "n") and cell.get("s") in dates else text


def sheet_rows(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """(sheet row number, column number -> text) for every used row of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_texts(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        last, dates, first_day = 0, _date_styles(book), _first_day(workbook)
        with book.open(_first_sheet(book, workbook)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != _ROW:
                    continue
                last = int(row.get("r") or last + 1)
                cells, at = {}, 0
                for cell in row:
                    if cell.tag != _CELL:
                        continue
                    ref = cell.get("r")
                    at = _column(ref) if ref else at + 1
                    if not len(cell) and cell.get("t") != "b":
                        continue  # empty, as most cells of a wide report are
                    text = _cell_text(cell, shared, dates, first_day)
                    if text != "":
                        cells[at] = text
                row.clear()
                if cells:
                    yield last, cells


class _Rows:
    """Rows of sheets as flat columns, so that a batch becomes Arrow without a pass over its cells."""

    def __init__(self):
        self.paths, self.numbers, self.ends = [], [], [0]
        self.columns, self.texts = [], []

    def add(self, path: str, number: int, cells: dict[int, str]) -> None:
        self.paths.append(path)
        self.numbers.append(number)
        self.columns.extend(cells)
        self.texts.extend(cells.values())
        self.ends.append(len(self.columns))

    def batch(self) -> pa.RecordBatch:
        cells = pa.MapArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(self.columns, pa.int32()), pa.array(self.texts, pa.string()))
        return _sheet_batch(self.paths, self.numbers, cells.cast(_CELLS), [None] * len(self.paths))


def _sheet_batch(paths: list, numbers: list, cells: pa.Array, errors: list) -> pa.RecordBatch:
    columns = [pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), cells, pa.array(errors, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=_SHEET_COLUMNS)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in small batches, and one row with the fault of each workbook that has any.

    Whatever is wrong with a workbook (cut, damaged, encrypted, not a workbook) is that workbook's own fault: it is told and
    must not end the job of the other files.
    """
    rows = _Rows()
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                for number, cells in sheet_rows(bytes(content.as_py())):
                    rows.add(path, number, cells)
                    if len(rows.paths) == _BATCH:
                        yield rows.batch()
                        rows = _Rows()
            except Exception as fault:  # noqa: BLE001 - told in the file's verdict
                yield _sheet_batch([path], [None], pa.array([None], _CELLS), [f"{type(fault).__name__}: {fault}"])
    if rows.paths:
        yield rows.batch()


def workbooks(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """Path and content of every workbook under a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .load(folder)
        .select(F.col("_metadata.file_path").alias("file_path"), "content")
    )


def sheet_cells(books: DataFrame) -> DataFrame:
    """One row per used sheet row, and one with ``error`` per workbook that cannot be read to its end."""
    return books.select("file_path", "content").mapInArrow(_decode, SHEET_SCHEMA)


def checked_sheet_headers(manifest: DataFrame, cells: DataFrame) -> DataFrame:
    """Accepted workbooks with their header verdict: the header is the first used row.

    A workbook that cannot be read to its end is refused as a whole.
    """
    widest = F.array_max(F.map_keys("line"))
    headers = F.transform(F.sequence(F.lit(1), widest), lambda i: F.coalesce(F.try_element_at("line", i), F.lit("")))
    found = cells.groupBy("file_path").agg(
        F.min_by("cells", "row_number").alias("line"), F.min("row_number").alias("header_row"), F.max("error").alias("error")
    ).select("file_path", "header_row", "error", headers.alias("headers"))
    accepted = manifest.where("accepted AND file_format = 'xlsx'").select(
        "file_path", F.col("report_uid").alias("job_id"), F.col("inbound_file_name").alias("source_file_name")
    )
    checked = check_headers(accepted.join(found, "file_path", "left"))
    return checked.withColumn(
        "header_error",
        F.when(F.col("error").isNotNull(), F.concat(F.lit(UNREADABLE), "error"))
        .when(F.col("headers").isNull(), F.lit(NO_XLSX_HEADER))
        .otherwise(F.col("header_error")),
    ).drop("error")


def scan_xlsx_reports(manifest: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report rows, checked headers) of all accepted workbooks; ``cells`` is a written table."""
    files = checked_sheet_headers(manifest, cells)
    good = files.where("header_error IS NULL").select(
        "file_path", "job_id", "source_file_name", "positions", "header_row"
    )
    by_position = [
        F.coalesce(F.try_element_at("cells", F.get("positions", F.lit(i))), F.lit("")).alias(c)
        for i, c in enumerate(RAW_COLUMNS)
    ]
    rows = cells.join(good, "file_path").where("row_number > header_row")
    return (
        rows.select(
            "file_path", "job_id", "source_file_name", "row_number", *by_position, F.lit(False).alias("malformed")
        ),
        files,
    )
