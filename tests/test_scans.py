"""Report files in all their shapes."""

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from sievework.layout import REQUIRED_HEADERS
from sievework.operators.headers import check_headers
from sievework.plans.rig_files import workbook
from sievework.sources.csv_reports import _lines, checked_headers, first_lines, scan_csv_reports
from sievework.sources.intake import intake_manifest, list_files
from sievework.sources.reports import scan_reports
from sievework.sources.xlsx_reports import sheet_rows

HEAD = ",".join(REQUIRED_HEADERS)
ROW = "f.txt,txt,/a,Obsolete,SMB,TLA"


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def put(folder, files):
    for name, content in files.items():
        data = content if isinstance(content, bytes) else content.encode()
        (folder / name).write_bytes(data)
    return str(folder)


def manifest_of(spark, folder):
    name = F.element_at(F.split("file_path", "/"), -1)
    return intake_manifest(list_files(spark, folder), now(), 10_000_000, name)


def scan(spark, folder):
    rows, files = scan_reports(manifest_of(spark, folder), folder)
    return rows.orderBy("job_id", "row_number").collect(), {r.job_id: r.header_error for r in files.collect()}


def test_header_checks(spark):
    full = REQUIRED_HEADERS
    rows = [
        ("ok", full + ["Extra", "I D"]),
        ("empty", ["", "  "]),
        ("null", None),
        ("twice", full + ["finding-file name", "FINDING FILE NAME"]),
        ("missing", [full[0], full[3], "risk level"]),
    ]
    got = {r.name: r for r in check_headers(spark.createDataFrame(rows, "name STRING, headers ARRAY<STRING>")).collect()}
    assert got["ok"].header_error is None and got["ok"].positions[:7] == [1, 2, 3, 4, 5, 6, 8]
    assert got["empty"].header_error == got["null"].header_error == "The file names no columns."
    assert got["twice"].header_error.endswith("duplicate headers: Finding_File_Name")
    assert got["missing"].header_error.endswith(
        "missing required columns: Finding File Format, Current_File_Location, Originating_Data_System, Originating_Vendor_Tool"
    )


def test_intake_refusals(spark, tmp_path):
    folder = put(tmp_path, {"a.csv": HEAD, "b.CSV": HEAD, "c.txt": "x", "d.csv": b"", "noext": "x", "big.csv": "x" * 300})
    rows = intake_manifest(list_files(spark, folder), now(), 200).collect()
    assert {r.inbound_file_name: r.refusal for r in rows} == {
        "a.csv": None,
        "b.CSV": None,
        "c.txt": "unsupported_format",
        "d.csv": "empty",
        "noext": "unsupported_format",
        "big.csv": "too_large",
    }
    uid = next(r.report_uid for r in rows if r.inbound_file_name == "a.csv")
    assert re.fullmatch(r"ING-[0-9]{8}-[0-9]{6}-[0-9A-F]{32}", uid)


def test_csv_shapes(spark, tmp_path):
    folder = put(
        tmp_path,
        {
            "plain.csv": f"{HEAD}\n{ROW}\n",
            "bom.csv": b"\xef\xbb\xbf" + f"{HEAD}\r\n{ROW}\r\n".encode(),
            "spelled.csv": "finding-file-name,finding file format,CURRENT_FILE_LOCATION,Finding Type,originating data system,Originating-Vendor-Tool,Id,Unknown\n" + ROW + ",7,zzz\n",
            "lines.csv": f'{HEAD}\n"a\nb.txt",txt,/a,Obsolete,SMB,TLA\n{ROW}\n"q ""x"", y",txt,/a,Obsolete,SMB,TLA\nbad "q,txt,/a,Obsolete,SMB,TLA\n',
            "faults.csv": f'{HEAD}\nshort,txt\n{ROW},extra\n\n"q"x,txt,/a,Obsolete,SMB,TLA\n"c, d",txt,/a,Obsolete,SMB,TLA\n,,,,,\n',
            "header_only.csv": HEAD,
            "blank.csv": "   \n",
            "newlines.csv": "\n\n",
            "twice.csv": HEAD + ",finding file name\n" + ROW + ",x\n",
        },
    )
    rows, errors = scan(spark, folder)
    got = {}
    for r in rows:
        got.setdefault(r.job_id, []).append((r.row_number, r.finding_file_name if not r.malformed else None))
    assert got == {
        "plain.csv": [(2, "f.txt")],
        "bom.csv": [(2, "f.txt")],
        "spelled.csv": [(2, "f.txt")],
        "lines.csv": [(2, "a\nb.txt"), (3, "f.txt"), (4, 'q "x", y'), (5, None)],
        "faults.csv": [(2, None), (3, "f.txt"), (4, None), (5, "c, d"), (6, "")],
    }
    assert next(r.id for r in rows if r.job_id == "spelled.csv") == "7"
    assert errors["header_only.csv"] is None
    assert errors["newlines.csv"] == "The CSV file has no header line."
    assert errors["blank.csv"].endswith("The file names no columns.")
    assert "duplicate headers" in errors["twice.csv"]


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    body = "\n".join(f"file{i}.txt,txt,/a,Obsolete,SMB,TLA" for i in range(5000))
    folder = put(tmp_path, {"a.csv": f"{HEAD}\n{body}\n", "b.csv": f"{HEAD}\n{body}\n"})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, _ = scan_csv_reports(manifest_of(spark, folder), folder)
        assert rows.count() == 10000
        expected = F.concat(F.lit("file"), (F.col("row_number") - 2).cast("string"), F.lit(".txt"))
        assert rows.where(F.col("finding_file_name") != expected).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_workbooks(spark, tmp_path):
    rows = pd.DataFrame([["a & b.txt", "txt", "/a", "Obsolete", "SMB", "TLA"], [""] * 6, ["c.txt", "txt", "/c", "Bad", "SMB", "TLA"]])
    good = workbook(rows, REQUIRED_HEADERS)
    folder = put(tmp_path, {"w.xlsx": good, "none.xlsx": workbook(pd.DataFrame(), []), "junk.xlsx": b"no zip", "p.csv": f"{HEAD}\n{ROW}\n"})
    got, errors = scan(spark, folder)
    assert [(r.job_id, r.row_number, r.finding_file_name) for r in got] == [
        ("p.csv", 2, "f.txt"),
        ("w.xlsx", 2, "a & b.txt"),
        ("w.xlsx", 4, "c.txt"),
    ]
    assert errors["none.xlsx"] == "The workbook has no header row."
    assert errors["junk.xlsx"].startswith("The workbook cannot be read: BadZipFile")
    assert [n for n, _ in sheet_rows(good)] == [1, 2, 4]


def test_damaged_workbooks_are_refused_whole(spark, tmp_path):
    """Cut, bit-damaged, encrypted and ill-linked workbooks lose all their rows and tell why; the others keep theirs."""
    rows = pd.DataFrame([[f"f{i}.txt", "txt", f"/a/{i * 7919}", "Obsolete", "SMB", "TLA"] for i in range(7000)])
    good = workbook(rows, REQUIRED_HEADERS)
    book = zipfile.ZipFile(io.BytesIO(good))
    at = book.getinfo("xl/worksheets/sheet1.xml").header_offset

    def remade(change):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for name in book.namelist():
                new.writestr(name, change(name, book.read(name)))
        return out.getvalue()

    sheet = "xl/worksheets/sheet1.xml"
    flipped = bytearray(good)
    for i in range(at + 20_000, at + 20_040):
        flipped[i] ^= 0xFF
    locked = bytearray(good)
    for mark, step in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = locked.find(mark)
        while i >= 0:
            locked[i + step] |= 1
            i = locked.find(mark, i + 4)
    bad = {
        "cut_xml.xlsx": remade(lambda n, d: d[: len(d) * 9 // 10] if n == sheet else d),
        "cut_file.xlsx": good[: len(good) * 9 // 10],
        "flipped.xlsx": bytes(flipped),
        "locked.xlsx": bytes(locked),
        "no_string.xlsx": remade(lambda n, d: d.replace(b"</sheetData>", b'<row r="9001"><c r="A9001" t="s"><v>7</v></c></row></sheetData>') if n == sheet else d),
        "no_sheet.xlsx": remade(lambda n, d: d.replace(b"rId1", b"rId9") if n == "xl/workbook.xml" else d),
    }
    folder = put(tmp_path, {"good.xlsx": good, "p.csv": f"{HEAD}\n{ROW}\n", **bad})
    got, errors = scan(spark, folder)
    assert {r.job_id for r in got} == {"good.xlsx", "p.csv"} and len(got) == 7001
    assert errors["good.xlsx"] is None
    assert all(errors[name].startswith("The workbook cannot be read: ") for name in bad)


def test_file_without_lines_has_no_header(spark, tmp_path):
    folder = put(tmp_path, {"x.csv": "\n"})
    files = checked_headers(manifest_of(spark, folder), folder).collect()
    assert [f.header_error for f in files] == ["The CSV file has no header line."]


def test_header_behind_blank_blocks(spark, tmp_path):
    """The first line lies in a later block, which the reader may number before the blank ones."""
    body = "\n".join(f"file{i}.txt,txt,/a,Obsolete,SMB,TLA" for i in range(3000))
    folder = put(tmp_path, {"late.csv": "\n" * 50_000 + f"{HEAD}\n{body}\n", "z.csv": f"{HEAD}\n{ROW}\n"})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, files = scan_csv_reports(manifest_of(spark, folder), folder)
        assert [f.header_error for f in files.collect()] == [None, None]
        assert rows.count() == 3001 and rows.where("finding_file_name = 'file0.txt'").first().row_number == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_search_sorts_no_text(spark, tmp_path):
    folder = put(tmp_path, {"a.csv": f"{HEAD}\n{ROW}\n"})
    plan = first_lines(_lines(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_refused_workbooks_stay_closed(spark, tmp_path, monkeypatch):
    from sievework.sources import reports

    good = workbook(pd.DataFrame([ROW.split(",")]), HEAD.split(","))
    folder = put(tmp_path, {"good.xlsx": good, "refused.xlsx": b""})
    opened = []
    monkeypatch.setattr(reports, "workbooks", lambda s, paths, read=reports.workbooks: opened.extend(paths) or read(s, paths))
    rows, _ = scan_reports(manifest_of(spark, folder), folder)
    assert rows.count() == 1 and len(opened) == 1 and opened[0].endswith("good.xlsx")


def test_workbooks_that_count_from_1904():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = zipfile.ZipFile(io.BytesIO(workbook(pd.DataFrame(), ["x"])))
    files = {n: book.read(n) for n in book.namelist()}
    files["xl/workbook.xml"] = files["xl/workbook.xml"].replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>')
    files["xl/styles.xml"] = f'<styleSheet {ns}><cellXfs><xf numFmtId="14"/></cellXfs></styleSheet>'.encode()
    files["xl/worksheets/sheet1.xml"] = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" s="0"><v>42495.5</v></c></row></sheetData></worksheet>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        for name, data in files.items():
            new.writestr(name, data)
    assert list(sheet_rows(out.getvalue())) == [(1, {1: "2020-05-06 12:00:00"})]


def test_dates_and_flags_in_workbooks():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO(workbook(pd.DataFrame(), ["x"]))
    book = zipfile.ZipFile(out)
    files = {n: book.read(n) for n in book.namelist()}
    files["xl/styles.xml"] = (
        f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy/mm"/><numFmt numFmtId="171" formatCode="0.00&quot;d&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    ).encode()
    files["xl/sharedStrings.xml"] = f"<sst {ns}><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>".encode()
    files["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {ns}><sheetData><row r="3"><c r="A3" s="1"><v>43957.5</v></c><c r="B3" s="2"><v>43957</v></c><c r="C3" s="3"><v>2.5</v></c>'
        '<c r="D3" t="b"><v>1</v></c><c r="AA3" t="s"><v>0</v></c></row></sheetData></worksheet>'
    ).encode()
    again = io.BytesIO()
    with zipfile.ZipFile(again, "w") as new:
        for name, data in files.items():
            new.writestr(name, data)
    assert list(sheet_rows(again.getvalue())) == [
        (3, {1: "2020-05-06 12:00:00", 2: "2020-05-06 00:00:00", 3: "2.5", 4: "TRUE", 27: "rich"})
    ]
