"""Stores kept as JSON arrays: findings, job records, rejected rows, checkpoints, staged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_arrays(df: DataFrame, chunk: Column) -> DataFrame:
    """Rows packed into JSON arrays, one array per value of ``chunk`` (which must bound its size)."""
    row = F.struct(*df.columns)
    return df.groupBy(chunk.alias("_chunk")).agg(F.to_json(F.collect_list(row)).alias("value")).select("value")


def read_json_store(spark: SparkSession, path: str, schema: StructType, whole_file: bool = True) -> DataFrame:
    """Elements of JSON arrays as rows.

    A pretty-printed store is one array over many lines and needs the whole file; a store of
    one array per line is split like any text.
    """
    return spark.read.schema(schema).option("multiLine", whole_file).json(path)
