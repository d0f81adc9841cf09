"""Record, sequence and batch numbers without ever sorting a whole job in one task.

Numbers come from offsets: rows are cut into bounded slices, the slices are counted, a
running sum over the (few) slice counts gives each slice its offset, and rows are ranked
inside their slice only.  A job that holds a third of all rows is many slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.layout import BATCH_SIZE, MAX_BATCH_SIZE, MIN_BATCH_SIZE

SLICE_ROWS = 131_072


def _before(key: list[str], order: str, count: str) -> Column:
    window = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def record_offsets(scanned: DataFrame) -> DataFrame:
    """First line id and number of earlier records of every block of every file.

    ``scanned`` is a *written* scan that carries ``file_path``, ``block_start`` and ``line_id``
    (increasing inside a block).  A file has few blocks, so the running sum is tiny.
    """
    blocks = scanned.groupBy("file_path", "block_start").agg(
        F.count("*").alias("_n"), F.min("line_id").alias("_first")
    )
    return blocks.select(
        "file_path", "block_start", "_first", _before(["file_path"], "block_start", "_n").alias("_before")
    )


def record_numbers(scanned: DataFrame, offsets: DataFrame) -> DataFrame:
    """Number the records of every file from 1 (the header) in file order.

    Ranks inside a block are a subtraction, not a sort.
    """
    return scanned.join(offsets, ["file_path", "block_start"]).withColumn(
        "row_number", F.col("_before") + F.col("line_id") - F.col("_first") + 1
    ).drop("_before", "_first")


def sequence_numbers(
    df: DataFrame,
    out: str = "sequence_number",
    order: str = "row_number",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Number the rows of every job from 1, ascending by ``order``, without gaps.

    ``order`` is a whole number that is unique inside a job, so a slice of ``slice_rows``
    consecutive values never holds more rows than that.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_rows))
    counts = sliced.groupBy("job_id", "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.select("job_id", "_slice", _before(["job_id"], "_slice", "_n").alias("_before"))
    rank = F.row_number().over(Window.partitionBy("job_id", "_slice").orderBy(order))
    return (
        sliced.join(offsets, ["job_id", "_slice"])
        .withColumn(out, F.col("_before") + rank)
        .drop("_slice", "_before")
    )


def clamp_batch_size(size: Column) -> Column:
    """Configured batch size forced into the allowed range."""
    return F.greatest(F.least(size, F.lit(MAX_BATCH_SIZE)), F.lit(MIN_BATCH_SIZE)).cast("bigint")


def batch_number(sequence: Column, size: Column) -> Column:
    """Batch a sequence number falls into, from 1."""
    return (F.floor((sequence - 1) / size) + 1).cast("bigint")


def batch_count(rows: Column, size: Column) -> Column:
    """How many batches a number of rows makes; none for no rows."""
    return F.ceil(rows / size).cast("bigint")


def with_batches(numbered: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    return numbered.withColumn("batch_number", batch_number(F.col("sequence_number"), F.lit(size)))


def batch_progress(numbered: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Running totals after each batch of a job.

    The batch row counts are aggregated first; the running sums then see one row per batch.
    """
    batches = with_batches(numbered, size).groupBy("job_id", "batch_number").agg(
        F.count("*").alias("batch_rows")
    )
    so_far = Window.partitionBy("job_id").orderBy("batch_number").rowsBetween(Window.unboundedPreceding, 0)
    return batches.select(
        "job_id",
        "batch_number",
        "batch_rows",
        F.count("*").over(so_far).alias("batches_done"),
        F.sum("batch_rows").over(so_far).alias("records_done"),
    )


def reports_progress(batch: Column, total: Column, every: Column) -> Column:
    """Batches after which the job record is written too: each k-th and the last."""
    step = F.greatest(every, F.lit(1))
    return (step == 1) | (batch == total) | (batch % step == 0)


def rows_after(df: DataFrame, position: Column | int, sequence: str = "sequence_number") -> DataFrame:
    """Rows past a position.  A plain comparison, so it reaches the Parquet scan."""
    return df.where(F.col(sequence) > position)
