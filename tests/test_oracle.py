"""Every registered query with check SQL gives the rows DuckDB gives (smallest supplied scale)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from sievework.plans.registry import ORACLES, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
# Whole ingests take their time; tests/test_ingest.py covers the same ground on tiny files.
SLOW = {
    "job_summary",
    "findings_batches",
    "rejected_rows",
    "summary_json",
    "audit_events",
    "stage_timings",
    "failed_then_resumed",
    "drop_folder_ingest",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_check_sql():
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["job_id", "finding_type", "row_count"]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    assert difference(spark, con, name, SF, queries(), oracle_sql()) is None
