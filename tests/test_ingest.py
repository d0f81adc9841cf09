"""The whole ingest: outcomes, repeats, failures, resume and streams."""

import glob
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sievework.layout import REQUIRED_HEADERS
from sievework.operators import tables as tb
from sievework.plans import ingest as ing
from sievework.operators.rules import DEFAULT_RULES
from sievework.plans.isolation import PATIENCE, Isolation
from sievework.plans.resume import resume_jobs
from sievework.streaming.drop_folder import ingest_drop_folder

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
LATER = datetime(2026, 1, 2, tzinfo=timezone.utc)
HEAD = "ID," + ",".join(REQUIRED_HEADERS)


def line(i, kind="Obsolete", system="SMB"):
    return f"R{i},f{i}.txt,txt,/a/{i},{kind},{system},TLA"


def report(n, bad=0, **kw):
    return "\n".join([HEAD, *[line(i, **kw) for i in range(n)], *[line(n + i, "Nonsense") for i in range(bad)]]) + "\n"


def job_name():
    return F.regexp_extract("file_path", r"([^/]+)\.[^./]+$", 1)


@pytest.fixture
def box(spark, tmp_path):
    (tmp_path / "in").mkdir()

    class Box:
        folder, store = str(tmp_path / "in"), ing.Store(spark, str(tmp_path / "store"))

        def put(self, **files):
            for name, text in files.items():
                (tmp_path / "in" / f"{name}.csv").write_text(text)

        def ingest(self, options=ing.Options(retry_delay_ms=0), now=NOW, **kw):
            rows = ing.ingest_folder(spark, self.folder, self.store, now, options, job_name(), **kw).collect()
            return {r.job_id: r for r in rows}

        def findings(self):
            return sorted((r.job_id, r.sequence_number, r.batch_number, r.id) for r in self.store.read_findings().collect())

    return Box()


def test_outcomes(box):
    box.put(
        good=report(3),
        mixed=report(2, bad=1),
        bad=report(0, bad=2),
        header_only=HEAD + "\n",
        no_header="\n",
        systems=HEAD + "\n" + line(1, system=" SMB ") + "\n,,,,,,\n" + line(2, system="smb") + "\n" + line(3, "obsolete", "SMB") + "\n" + line(4, "Nope", "SMB") + "\n",
    )
    jobs = box.ingest()
    got = {k: (r.status, r.total_records, r.success_count, r.reject_count, r.response_class) for k, r in jobs.items()}
    assert got == {
        "good": ("Success", 3, 3, 0, "ok"),
        "mixed": ("PartialSuccess", 3, 2, 1, "ok"),
        "bad": ("Failed", 2, 0, 2, "ok"),
        "header_only": ("Failed", 0, 0, 0, "unprocessable"),
        "no_header": ("Failed", 0, 0, 0, "unprocessable"),
        "systems": ("PartialSuccess", 4, 3, 1, "ok"),
    }
    assert jobs["systems"].source_system.lower() == "smb" and jobs["systems"].finding_type_counts == {"Obsolete": 3}
    assert jobs["no_header"].message == "Not taken in: The CSV file has no header line."
    assert jobs["mixed"].message == "Taken in: 2 rows; turned down: 1 rows."
    assert len(box.findings()) == 8
    assert box.store.read_staged().count() == 0  # completed jobs are cleaned up
    head = json.loads(open(glob.glob(f"{box.store.summaries}/job_id=mixed/*.txt")[0]).read())
    assert head["FinalJobStatus"] == "PartialSuccess" and head["SuccessfulRows"] == 2
    part = json.loads(open(glob.glob(f"{box.store.rejected_parts}/job_id=mixed/*.txt")[0]).read())
    assert [r["FieldName"] for r in part["RejectedRows"]] == ["FindingType"]
    events = box.store.spark.read.parquet(box.store.events).collect()
    assert {e.entity_id: e.outcome for e in events}["good"] == "Success"


def test_ingesting_twice_is_ingesting_once(box):
    box.put(a=report(250, bad=3), b=report(5))
    options = ing.Options(batch_size=100, batch_groups=2)
    box.ingest(options)
    first, rejected = box.findings(), box.store.read_rejected().count()
    box.ingest(options, LATER)
    assert box.findings() == first and box.store.read_rejected().count() == rejected == 3
    box.put(a=report(250))  # no rejects any more: the old ones must go
    box.ingest(ing.Options(batch_size=100), LATER)
    assert box.findings() == first and box.store.read_rejected().count() == 0
    assert not glob.glob(f"{box.store.rejected_parts}/job_id=a/*.txt")
    assert box.store.read_jobs().count() == 2
    created = {r.job_id: (r.created_at_utc, r.last_checkpoint_utc) for r in box.store.read_checkpoints().collect()}
    assert created["a"][0] < created["a"][1]


def failing(after):
    calls = []

    def write(rows, path):
        calls.append(path)
        if len(calls) > after:
            raise OSError("disk full")
        tb.replace_partitions(rows, path, ["job_id", "batch_group"])

    write.calls = calls
    return write


@pytest.mark.parametrize("parquet", [True, False])
def test_fail_and_resume_is_one_clean_ingest(spark, box, parquet):
    box.put(a=report(950, bad=2), b=report(120), c=report(0, bad=1))
    options = ing.Options(batch_size=100, batch_groups=3, max_retries=2, retry_delay_ms=0, parquet_working=parquet)
    box.ingest(options)
    clean = box.findings()

    writer = failing(after=1)
    jobs = box.ingest(options, LATER, write_batch_group=writer)
    assert len(writer.calls) == 10  # one good group, then one attempt and two retries for both jobs and for each alone
    assert jobs["a"].status == "Failed" and jobs["a"].is_resume_eligible and jobs["a"].last_processed_record_count == 300
    assert jobs["a"].batch_persistence_retry_count == 2
    assert not jobs["c"].is_resume_eligible
    wanted = spark.createDataFrame([("A",), ("b",), ("c",), ("missing",), (" ",)], "job_id STRING")
    done = {r.job_id: (r.status, r.message) for r in resume_jobs(box.store, wanted, LATER, options).collect()}
    assert done["a"] == ("PartialSuccess", "The remaining rows were taken in.")
    assert done["b"][0] == "Success"
    assert done["c"] == ("Failed", "The job cannot be resumed.")
    assert "missing" not in done
    assert box.findings() == clean
    record = {r.job_id: r for r in box.store.read_jobs().collect()}
    assert (record["a"].status, record["a"].total_batches, record["a"].last_successful_batch_number) == ("PartialSuccess", 10, 10)
    again = resume_jobs(box.store, wanted, LATER, options).collect()
    assert {r.message for r in again} == {"The job cannot be resumed."}


def test_resume_without_data_is_an_error(spark, box):
    box.put(a=report(300))
    options = ing.Options(batch_size=100, batch_groups=3, max_retries=0, retry_delay_ms=0, parquet_primary=True)
    box.ingest(options, write_batch_group=failing(after=1))
    tb.delete_job_rows(spark, box.store.working, ["a"])
    done = resume_jobs(box.store, spark.createDataFrame([("a",)], "job_id STRING"), LATER, options).collect()
    assert done[0].status == "Failed" and "handed in again" in done[0].message
    assert not box.store.read_checkpoints().first().is_resume_eligible


def test_no_durable_store_fails_the_jobs(box):
    box.put(a=report(3))
    jobs = box.ingest(ing.Options(parquet_working=False, parquet_primary=True, staging_fallback=False))
    assert jobs["a"].status == "Failed" and "Neither a Parquet copy nor a staged copy" in jobs["a"].message


def test_drop_folder_takes_every_file_once(spark, box, tmp_path):
    box.put(a=report(5), b=report(4, bad=1))
    start = lambda: ingest_drop_folder(spark, box.folder, box.store, str(tmp_path / "cp"), job_id=job_name(), now=NOW)
    start().awaitTermination()
    streamed = box.findings()
    box.put(c=report(2))
    start().awaitTermination()
    assert {r.job_id for r in box.store.read_jobs().collect()} == {"a", "b", "c"}
    assert [f for f in box.findings() if f[0] != "c"] == streamed
    assert spark.read.parquet(box.store.events).count() == 3


KEYED = "job_id STRING, n INT"


def keyed(spark, path):
    return sorted(map(tuple, tb.read_keyed(spark, path, KEYED).collect()))


def put(spark, path, rows, merge=None, batch=None):
    frame = spark.createDataFrame(rows, KEYED)
    return tb.upsert_keyed(spark, path, frame, frame.schema, merge, batch)


def test_keyed_tables_match_ids_in_any_case(spark, tmp_path):
    path = str(tmp_path / "t")
    assert keyed(spark, path) == []
    for rows in ([("Job", 1), ("other", 1)], [("jOB", 2)], [("JOB", 3)], []):
        put(spark, path, rows)
    assert keyed(spark, path) == [("JOB", 3), ("other", 1)]
    assert tb.versions(spark, path) == [1, 2, 3, 4]
    (tmp_path / "t" / "rows" / "w-dead" / "_bucket=0").mkdir(parents=True)  # a write that died is not seen
    assert keyed(spark, path) == [("JOB", 3), ("other", 1)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    every = put(spark, path, [(f"job-{i}", 0) for i in range(500)])
    assert len(every) == tb.BUCKETS
    before = tb.current(spark, path).parts
    some = put(spark, path, [("JOB-7", 1)])
    after = tb.current(spark, path).parts
    assert len(some) == 1 and {b for b in before if before[b] != after[b]} == some
    written = list((tmp_path / "t" / "rows" / after[some.pop()]).rglob("*.parquet"))
    assert sum(spark.read.parquet(f"file://{f}").count() for f in written) < 50
    assert len(keyed(spark, path)) == 500 and ("JOB-7", 1) in keyed(spark, path)


def test_a_second_writer_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [("a", 0), ("b", 0)])
    merges = []

    def while_other_writes(rows):
        def merge(old, new):
            merges.append(1)
            if len(merges) == 1:
                put(spark, path, rows)
            return tb.merged_jobs(old, new)

        return merge

    # the other writer changes the same bucket: merged anew on top of it
    put(spark, path, [("a", 1)], lambda old, new: while_other_writes([("A", 7)])(old.withColumn("n", old.n + 0), new))
    assert keyed(spark, path) == [("a", 1), ("b", 0)] and len(merges) == 2
    # it changes another bucket: the work is kept
    merges.clear()
    put(spark, path, [("a", 2)], while_other_writes([("b", 5)]))
    assert keyed(spark, path) == [("a", 2), ("b", 5)] and len(merges) == 1


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: put(spark, path, [(f"job-{i}", i), ("shared", i)]), range(12)))
    got = keyed(spark, path)
    assert [r for r in got if r[0] != "shared"] == sorted((f"job-{i}", i) for i in range(12))
    assert sum(r[0] == "shared" for r in got) == 1 and tb.versions(spark, path) == list(range(1, 13))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert put(spark, path, [("a", 1)], batch=("s", 0)) and put(spark, path, [("a", 2)], batch=("s", 1))
    assert put(spark, path, [("a", 1)], batch=("s", 0)) == set() == put(spark, path, [("a", 9)], batch=("s", 1))
    assert put(spark, path, [("b", 3)], batch=("other", 0))
    assert keyed(spark, path) == [("a", 2), ("b", 3)]


def test_old_versions_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(3):
        put(spark, path, [("a", n)])
    reader = tb.read_keyed(spark, path, KEYED)
    put(spark, path, [("a", 3)])
    assert reader.collect()[0].n == 2  # readers of an older version still have it
    tb.forget(spark, path, -5)
    assert tb.versions(spark, path) == [4] and keyed(spark, path) == [("a", 3)]
    assert len(list((tmp_path / "t" / "rows").iterdir())) == 1


def test_purge_of_staged_rows(spark, tmp_path):
    path = str(tmp_path / "staged")
    assert tb.purge_expired(spark, path, NOW) == []
    rows = [("a", 1, "2024-01-01 05:00:00"), ("a", 2, "2024-01-02 05:00:00"), ("b", 1, "2024-01-02 08:00:00"), ("c", 1, "2024-01-03 00:00:00")]
    staged = spark.createDataFrame(rows, "job_id STRING, sequence_number BIGINT, at STRING").selectExpr("job_id", "sequence_number", "CAST(at AS TIMESTAMP) AS expires_at")
    tb.write_staged(staged, path)
    left = lambda: sorted((r.job_id, r.sequence_number) for r in tb.read_rows(spark, path, "sequence_number BIGINT, expires_at TIMESTAMP, expiry_day DATE, job_id STRING").collect())
    assert tb.purge_expired(spark, path, datetime(2024, 1, 2, 5)) == ["2024-01-01", "2024-01-02"]
    assert left() == [("b", 1), ("c", 1)]
    assert tb.purge_expired(spark, path, datetime(2024, 1, 2, 5)) == []
    # a purge that died between its two renames is undone by the next one, which then does it again
    (tmp_path / "staged" / "expiry_day=2024-01-02").rename(tmp_path / "staged" / "_before-expiry_day=2024-01-02")
    assert tb.purge_expired(spark, path, datetime(2024, 1, 2, 6)) == [] and left() == [("b", 1), ("c", 1)]
    assert tb.delete_job_rows(spark, path, ["C", " "]) == 1 and left() == [("b", 1)]
    assert tb.purge_expired(spark, path, datetime(2025, 1, 1)) == ["2024-01-02", "2024-01-03"] and left() == []


def records(box):
    return {r.job_id: r for r in box.store.read_jobs().collect()}


def test_a_job_that_cannot_be_read_fails_alone(spark, box):
    """Six good jobs and one whose rows break the rules themselves."""
    good = {f"g{i}": report(20 + i, bad=1) for i in range(6)}
    box.put(**good, poison=report(3, system="POISON"))
    broken = F.when(F.col("originating_data_system") == "POISON", F.raise_error(F.lit("unreadable system")).cast("boolean")).otherwise(F.lit(False))
    first = DEFAULT_RULES[0]
    jobs = box.ingest(rules=[replace(first, fails=lambda as_of: first.fails(as_of) | broken), *DEFAULT_RULES[1:]])
    assert jobs["poison"].status == "Failed" and "unreadable system" in jobs["poison"].message and jobs["poison"].total_records == 0
    assert {jobs[g].status for g in good} == {"PartialSuccess"}
    assert len(box.findings()) == sum(20 + i for i in range(6))
    assert {r.job_id: r.status for r in box.store.read_checkpoints().collect()} == {g: "PartialSuccess" for g in good} | {"poison": "Failed"}
    head = json.loads(open(glob.glob(f"{box.store.summaries}/job_id=poison/*.txt")[0]).read())
    assert head["FinalJobStatus"] == "Failed"


def breaking(job, times=10**9):
    """Writes of rows of one job fail."""
    left = [times]

    def write(rows, path):
        if left[0] > 0 and not rows.where(F.col("job_id") == job).isEmpty():
            left[0] -= 1
            raise OSError(f"no room for {job}")
        tb.replace_partitions(rows, path, ["job_id", "batch_group" if "batch_group" in rows.columns else "working_group"])

    return write


def test_a_job_that_cannot_be_written_fails_alone_and_resumes(spark, box):
    box.put(a=report(250), b=report(260), c=report(30), d=report(0, bad=1))
    options = ing.Options(batch_size=100, batch_groups=2, max_retries=0, retry_delay_ms=0)
    box.ingest(options)
    clean = box.findings()
    jobs = box.ingest(options, LATER, write_batch_group=breaking("b"))
    assert {k: r.status for k, r in jobs.items()} == {"a": "Success", "b": "Failed", "c": "Success", "d": "Failed"}
    assert jobs["b"].is_resume_eligible and "no room for b" in jobs["b"].message and not jobs["d"].is_resume_eligible
    assert [f for f in clean if f[0] != "b"] == box.findings()
    done = resume_jobs(box.store, spark.createDataFrame([("b",)], "job_id STRING"), LATER, options).collect()
    assert [(r.job_id, r.status) for r in done] == [("b", "Success")] and box.findings() == clean


def test_a_truncated_copy_is_replaced_by_staged_rows_or_fails_its_job(box):
    box.put(a=report(40), b=report(50), empty=report(0, bad=1))

    def truncated(rows, path):
        tb.replace_partitions(rows.where("job_id <> 'b' OR sequence_number <= 30"), path, ["job_id", "working_group"])

    options = ing.Options(parquet_primary=True, staging_fallback=True, max_retries=0)
    jobs = box.ingest(options, write_working=truncated)
    assert jobs["a"].status == jobs["b"].status == "Success" and len(box.findings()) == 90
    assert (jobs["a"].working_file_format, jobs["a"].working_file_record_count) == ("parquet", 40)
    assert (jobs["b"].working_file_format, jobs["b"].working_file_record_count) == (None, 0)
    jobs = box.ingest(ing.Options(parquet_primary=True, staging_fallback=False, max_retries=0), LATER, write_working=truncated)
    assert jobs["a"].status == "Success" and jobs["b"].status == "Failed" and jobs["empty"].status == "Failed"
    assert "does not hold the rows" in jobs["b"].message and "Neither a Parquet copy" in jobs["b"].message
    assert "Neither" not in jobs["empty"].message  # without rows no store is needed


def test_working_stores(spark, box):
    """Which copies lie there when the batches fail: both, Parquet alone, staged rows in its place, or none for no rows."""

    def stores(options, **kw):
        box.ingest(options, write_batch_group=failing(after=0), **kw)
        copies = {r.job_id for r in box.store.read_working().select("job_id").distinct().collect()}
        staged = {r.job_id for r in box.store.read_staged().select("job_id").distinct().collect()}
        return copies, staged

    box.put(a=report(30), empty=report(0, bad=1))
    quick = {"max_retries": 0, "retry_delay_ms": 0}
    assert stores(ing.Options(**quick)) == ({"a"}, {"a"})
    assert stores(ing.Options(parquet_primary=True, **quick)) == ({"a"}, set())
    assert stores(ing.Options(parquet_working=False, parquet_primary=True, **quick)) == (set(), {"a"})
    assert stores(ing.Options(parquet_primary=True, **quick), write_working=breaking("a")) == (set(), {"a"})
    done = resume_jobs(box.store, spark.createDataFrame([("a",)], "job_id STRING"), LATER, ing.Options(**quick)).collect()
    assert done[0].status == "Success" and len(box.findings()) == 30


def test_group_reads_are_pruned(box):
    box.put(a=report(950))
    box.ingest(ing.Options(batch_size=100, batch_groups=3))
    plan = box.store.read_working(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(working_group" in plan and "(working_group#" in plan
    assert [box.store.read_working(g).count() for g in (1, 2, 3)] == [300, 300, 350]


def test_incomplete_groups_do_not_move_the_checkpoint(box, monkeypatch):
    box.put(a=report(250), b=report(150))

    def short():
        return lambda rows, path: tb.replace_partitions(rows.where("job_id <> 'a' OR sequence_number <> 120"), path, ["job_id", "batch_group"])

    monkeypatch.setattr(ing, "default_writer", short)
    jobs = box.ingest(ing.Options(batch_size=100, batch_groups=3, max_retries=0, retry_delay_ms=0))
    assert jobs["a"].status == "Failed" and jobs["a"].last_processed_record_count == 100 and "has 99 of 100 rows" in jobs["a"].message
    assert jobs["b"].status == "Success"


def test_a_common_cause_is_told_from_bad_jobs(spark):
    jobs = spark.range(400).selectExpr("concat('j', id) AS job_id")
    calls = []

    def never(some):
        calls.append(1)
        raise OSError("disk full")

    outcome = Isolation().run(jobs, never)
    assert not outcome.passed and sum(some.count() for some, _ in outcome.failed) == 400 and len(calls) <= 3 * PATIENCE

    def picky(some):
        if some.where("job_id IN ('j7', 'j301')").count():
            raise OSError("bad job")

    outcome = Isolation().run(jobs, picky)
    assert sorted(r[0] for some, _ in outcome.failed for r in some.collect()) == ["j301", "j7"]
    assert sum(some.count() for some, _ in outcome.passed) == 398


def test_refused_files_are_not_read_again_and_names_are_taken_literally(spark, box, tmp_path):
    (tmp_path / "in" / "a b%20{x}[1].csv").write_text(report(3))
    (tmp_path / "in" / "no_header.csv").write_text("\n")
    first = ing.ingest_folder(spark, box.folder, box.store, NOW).collect()
    assert sorted((r.inbound_file_name, r.status, r.success_count) for r in first)[0][1:] == ("Success", 3)
    assert ing.ingest_folder(spark, box.folder, box.store, LATER).collect() == []
