"""Steps that grew with the number of files or rows in one task: spread, bounded, and alike in what they return."""

from __future__ import annotations

import json
import pathlib
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from sievework import workspace as ws
from sievework.operators import headers as hd
from sievework.operators import tables as tb
from sievework.operators.summary import read_documents, write_documents
from sievework.plans import ingest as ing
from sievework.plans import q_headers as qh
from sievework.plans import q_state as qs
from sievework.plans import rig_files
from sievework.sources import csv_reports as cr
from sievework.sources import xlsx_reports as xl
from tests.test_ingest import box, failing, report  # noqa: F401 - box is a fixture

_QUOTED = r'(?<=^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'


def _lines() -> list[str]:
    pieces = ["a", " b ", "", ",", ",", '"', '""', '"x"', '"y, z"', '"q ""r"" s"', "\0", "#", "é", "\t"]
    pick = random.Random(3)
    return ["".join(pick.choice(pieces) for _ in range(pick.randrange(1, 14))) for _ in range(3000)]


def test_fields_are_those_of_the_csv_parser(spark):
    lines = spark.createDataFrame([(v,) for v in _lines() if v], "value STRING")
    names = [f"c{i}" for i in range(5)]
    parsed = F.from_csv("value", ", ".join(f"{n} STRING" for n in names), cr._CSV)
    whole = F.array(*[F.coalesce(parsed.getField(n), F.lit("")) for n in names])
    found = F.array(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")) for i in range(5)])
    rows = lines.select("value", cr._fields(F.col("value"), 5).alias("f"), whole.alias("want")).select("value", found.alias("got"), "want").collect()
    assert [(r.value, r.got) for r in rows] == [(r.value, r.want) for r in rows]


def test_residue_is_the_line_without_its_quoted_fields(spark):
    lines = spark.createDataFrame([(v,) for v in _lines()], "value STRING")
    want = F.regexp_replace("value", _QUOTED, "")
    rows = lines.select("value", cr._residue(F.col("value")).alias("got"), want.alias("want")).collect()
    assert [(r.value, r.got) for r in rows] == [(r.value, r.want) for r in rows]
    old = lines.select(F.col("value").contains('"') & want.rlike(cr._OPEN)).collect()
    blocks = lines.withColumns({"file_path": F.col("value"), "block_start": F.lit(0).cast("bigint"), "line_id": F.monotonically_increasing_id()})
    spans = cr.first_lines(blocks.withColumn("file_path", F.col("line_id").cast("string"))).orderBy("line_id").collect()
    by_id = [r.value for r in blocks.orderBy("line_id").collect()]
    assert len(spans) == len(old) == len(by_id)
    told = {v: o[0] for v, o in zip([r.value for r in lines.collect()], old)}
    assert [r.spans_lines for r in spans] == [told[v] for v in by_id]


def test_documents_of_many_jobs_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('J-', id) AS job_id", "concat('doc ', id) AS document").coalesce(1)
    write_documents(rows, str(tmp_path / "docs"))
    parts = {re.match(r"part-(\d+)", f.name)[1] for f in (tmp_path / "docs").glob("job_id=*/part-*")}
    assert len(parts) > 1 or spark.sparkContext.defaultParallelism == 1
    assert {tuple(r) for r in read_documents(spark, str(tmp_path / "docs")).collect()} == {(f"doc {i}", f"J-{i}") for i in range(60)}


def test_headers_are_dealt_over_the_tasks(spark, tmp_path):
    spark.range(400).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert "RoundRobin" in qh.report_headers(spark, str(tmp_path))._jdf.queryExecution().toString()


def test_duplicate_headers(spark):
    cells = [["A", "b", "a ", "B", "c"], ["A", "b", "", ""], [], None, ["_a", "A", "a"]]
    files = spark.createDataFrame([(c,) for c in cells], "headers ARRAY<STRING>")
    got = hd.with_header_keys(files).select(hd.duplicate_headers().alias("d")).collect()
    assert [r.d for r in got] == [["A", "b"], [], [], [], ["_a"]]


def test_export_is_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "export")
    monkeypatch.setattr(qs, "fresh_path", lambda *a: path)
    monkeypatch.setattr(qs, "_EXPORT_ROWS", 10)
    items = spark.range(25).selectExpr("map('jobId', named_struct('S', concat('J-', id), 'N', null, 'BOOL', null, 'M', null)) AS item")
    items = items.select(F.col("item").cast(qs.it.ITEM_TYPE).alias("item")).coalesce(1)
    back = qs._exported(spark, items, "x").select(qs.it.get_text("item", "jobId").alias("j")).collect()
    assert {r.j for r in back} == {f"J-{i}" for i in range(25)}
    assert len(list((tmp_path / "export").glob("part-*.lz4"))) == 3


def test_entries_of_a_folder_come_over_in_one_text(spark, tmp_path):
    names = sorted(["job_id=a,b", "job_id={c}", "job_id=d e%2F", "_SUCCESS", "v-0000000001"] + [f"job_id={i}" for i in range(300)])
    for name in names:
        (tmp_path / "t" / name).mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    assert ws.children(spark, str(tmp_path / "t")) == names
    assert ws.children(spark, str(tmp_path / "empty")) == ws.children(spark, str(tmp_path / "none")) == []
    told = [ws.has_child(spark, str(tmp_path / d), "job_id=", "expiry_day=") for d in ("t", "empty", "none")]
    assert told == [True, False, False] and not ws.has_child(spark, str(tmp_path / "t"), "expiry_day=")


def test_a_group_that_fails_lists_the_working_copy_no_more(box, monkeypatch):  # noqa: F811
    """A failing group is tried for halves of the jobs again and again; the copy they read from is complete by then."""
    box.put(**{f"j{i}": report(3) for i in range(8)})
    listed, read = [], tb.read_rows
    monkeypatch.setattr(tb, "read_rows", lambda spark, path, schema: (listed.append(path), read(spark, path, schema))[1])
    write = failing(0)
    jobs = box.ingest(ing.Options(batch_groups=1, max_retries=0), write_batch_group=write)
    assert {r.status for r in jobs.values()} == {"Failed"} and len(write.calls) > 8
    assert listed.count(box.store.working) < 5  # before: once for each attempt


def test_csv_files_are_listed_once_a_scan(box, monkeypatch):  # noqa: F811
    box.put(a=report(2), b=report(1, bad=1))
    listed, lines = [], cr._lines
    monkeypatch.setattr(cr, "_lines", lambda spark, folder: (listed.append(folder), lines(spark, folder))[1])
    box.ingest()
    assert len(listed) == 1


def test_folders_of_many_jobs_are_listed_by_a_few_tasks(spark):
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        ws.tune(spark)
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
        spark.conf.set(key, "2")
        ws.tune(spark)
        assert spark.conf.get(key) == "2"
    finally:
        spark.conf.set(key, before)


def test_rows_of_small_workbooks_share_a_batch(spark):
    books = [rig_files.workbook_of([(f"r{i}", "", None, f"<{n}>")], ["A", "B", "C", "D"]) for n in range(3) for i in range(1)]
    batch = pa.RecordBatch.from_pydict({"file_path": ["a", "b", "bad", "c"], "content": [books[0], books[1], b"no zip", books[2]]})
    told, rows = list(xl._decode(iter([batch])))
    assert [(r["file_path"], r["row_number"], r["cells"]) for r in told.to_pylist()] == [("bad", None, None)]
    assert told.to_pylist()[0]["error"].startswith("BadZipFile")
    head = [(1, "A"), (2, "B"), (3, "C"), (4, "D")]
    want = [(p, n, cells, None) for k, p in enumerate("abc") for n, cells in ((1, head), (2, [(1, "r0"), (4, f"<{k}>")]))]
    assert [tuple(r.values()) for r in rows.to_pylist()] == want
    frame = spark.createDataFrame([("a", bytearray(books[0]))], "file_path STRING, content BINARY")
    assert xl.sheet_cells(frame).schema == spark.createDataFrame([], xl.SHEET_SCHEMA).schema and xl.sheet_cells(frame).count() == 2


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    """Of an ingest neither shuffle files nor the typed records are left when the batch groups are written."""
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = local.getAllFiles().iterator()
        found = set()
        while files.hasNext():
            found.add(files.next().getName())
        return {f for f in found if f.startswith("shuffle_")}

    before = shuffled()
    with ws.scratch(spark):
        rows = spark.range(1000).repartition(4, "id")
        kept = ws.materialise(rows, "records")
        other = ws.materialise(kept.groupBy((F.col("id") % 7).alias("k")).count(), "others")
        assert other.count() == 7
        for _ in range(50):  # Spark deletes them in the background
            if not shuffled() - before:
                break
            time.sleep(0.1)
        assert not shuffled() - before
        folder = ws._scratch.get()
        ws.drop_tables(spark, "records")
        assert [n.rpartition("-")[0] for n in ws.children(spark, folder)] == ["others"]
    assert spark.conf.get(ws._TIDY, "false") == "false"


def test_typed_records_are_gone_before_the_groups_are_written(box):  # noqa: F811
    box.put(a=report(30, bad=2))
    seen = []

    def put(rows, path):
        seen.append([n.rpartition("-")[0] for n in ws.children(box.store.spark, ws._scratch.get())])
        tb.replace_partitions(rows, path, ["job_id", "batch_group"])

    box.ingest(write_batch_group=put)
    assert seen and "states" in seen[0] and "records" not in seen[0]
    assert len(box.findings()) == 30


def test_long_lists_are_packed_and_made_some_jobs_at_a_time(box, monkeypatch):  # noqa: F811
    monkeypatch.setattr(ing, "LONG_LIST", 3)
    monkeypatch.setattr(ing, "LIST_ROWS", 4)
    calls, write = [], ing.write_rejected_documents
    monkeypatch.setattr(ing, "write_rejected_documents", lambda *a: calls.append(a[2]) or write(*a))
    wanted = {"a": 2, "b": 3, "c": 4, "d": 9, "e": 0}
    box.put(**{name: report(2, bad=bad) for name, bad in wanted.items()})
    box.ingest()
    found = {}
    for r in read_documents(box.store.spark, box.store.rejected_parts).collect():
        found[r.job_id] = found.get(r.job_id, 0) + len(json.loads(r.document)["RejectedRows"])
    assert found == {name: bad for name, bad in wanted.items() if bad}
    kinds = {n: {p.name.endswith(".gz") for p in pathlib.Path(box.store.rejected_parts).glob(f"job_id={n}/part-*")} for n in found}
    assert kinds == {"a": {False}, "b": {False}, "c": {True}, "d": {True}}
    assert len(calls) >= 4  # neither all short nor all long ones fit
    stored = next(pathlib.Path(box.store.rejected).glob("job_id=a/*.parquet"))
    assert "zstd" in stored.name


def test_portions():
    assert ing.portions([], 5) == []
    assert ing.portions([(1, 2), (2, 3), (3, 1), (4, 9), (5, 0), (6, 5)], 5) == [[1, 2], [3], [4], [5, 6]]
