"""What the plans look like: no Python in row paths, hash aggregates, pushed filters, bounded groups."""

import re

from pyspark.sql import functions as F

from sievework.operators import lookups as lk
from sievework.operators import numbering as nb
from sievework.plans import q_rows as qr
from sievework.workspace import materialise

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_one_pass_with_hash_aggregates(spark):
    text = plan(qr.finding_type_counts(spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert text.count("FileScan parquet") <= 1 or text.count("Scan parquet") == 1
    # The row-level aggregate is hash based; only the tiny second one may sort.
    deepest = [l for l in text.splitlines() if "Aggregate" in l][-1]
    assert "HashAggregate" in deepest
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint" in text


def test_no_window_without_a_partition(spark):
    rows = materialise(spark.range(1000).selectExpr("'J' AS job_id", "id AS row_number"), "rows")
    for df in (nb.sequence_numbers(rows), nb.batch_progress(nb.sequence_numbers(rows), 100)):
        assert "SinglePartition" not in plan(df)


def test_position_reaches_the_scan(spark):
    rows = materialise(spark.range(10).selectExpr("'J' AS job_id", "id AS sequence_number"), "rows")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(sequence_number,5\)", plan(nb.rows_after(rows, 5)))
    found = lk.findings_by(rows.withColumn("load_date_utc", F.current_timestamp()), "job_id", "J")
    assert "EqualTo(job_id,J)" in plan(found)


def test_sequence_numbers_with_one_hot_job(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("j"), F.col("id") % 30)).alias("job_id"),
        (F.col("id") * 7 % 20000).alias("row_number"),
    )
    rows = materialise(rows.repartition(13), "rows")
    got = nb.sequence_numbers(rows, slice_rows=64)
    whole = got.groupBy("job_id").agg(
        F.count("*").alias("n"), F.min("sequence_number").alias("low"), F.max("sequence_number").alias("high"), F.count_distinct("sequence_number").alias("d")
    )
    assert whole.where("n <> high OR low <> 1 OR d <> n").count() == 0
    a, b = got.alias("a"), got.alias("b")
    wrong = a.join(b, (F.col("a.job_id") == F.col("b.job_id")) & (F.col("a.sequence_number") + 1 == F.col("b.sequence_number")))
    assert wrong.where("a.row_number >= b.row_number").count() == 0


def test_status_history_across_buckets(spark):
    rows = [(1, "2024-01-01 00:10:00", "a", 1), (1, "2024-01-01 00:50:00", "a", 2), (1, "2024-01-01 05:00:00", "a", 3), (1, "2024-01-03 00:00:00", "b", 4), (2, "2024-01-01 00:00:00", "a", 5)]
    df = spark.createDataFrame(rows, "k INT, at STRING, s STRING, id INT").withColumn("at", F.col("at").cast("timestamp"))
    got = sorted((r.id, r.previous_status) for r in lk.status_history(df, "k", "at", "s", "id").collect())
    assert got == [(1, None), (4, "a"), (5, None)]
