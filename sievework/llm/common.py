"""What several operators share: words, session checks and written tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.workspace import fresh_path, materialise

CARRIED = "_carried"
# Hint for joins of exploded tables: Spark sizes them like the tables they were made from, up to 528 times too low, and would broadcast them.
SORTED = "merge"
# A word is a run of characters other than the space and the five ASCII control blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS, -1), "")


def carried(columns: list[str]) -> Column:
    """The caller's columns as one, so that their names cannot clash with an operator's own; ``CARRIED.*`` undoes it."""
    return F.struct(*columns).alias(CARRIED)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut a plan by a table in the cluster's shared folder."""
    return materialise(df, label)


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the table's path, for tables that a later step drops."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps: Spark deletes them once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
