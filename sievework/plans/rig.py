"""Report rows derived from the supplied ``orders`` table.

Every order becomes one inbound row.  The expressions are plain SQL that means the same in
Spark and in DuckDB, so that both sides of a check start from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.layout import RAW_COLUMNS

AS_OF = "2026-01-01 00:00:00"
_GAP = "WHEN o_orderkey % 53 = 0 THEN ''"

_EXPRESSIONS = {
    "job_id": "'JOB-' || CAST(o_custkey % 5 AS STRING)",
    "row_number": "o_orderkey + 2",
    "id": f"CASE {_GAP} WHEN o_orderkey % 47 = 0 THEN '   ' ELSE CAST(o_orderkey AS STRING) END",
    "finding_file_name": f"CASE {_GAP} WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 211 = 0 "
    "THEN repeat('n', 513) ELSE 'file_' || CAST(o_orderkey AS STRING) || '.txt' END",
    "finding_file_format": f"CASE {_GAP} WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 223 = 0 "
    "THEN repeat('f', 51) ELSE 'txt' END",
    "finding_file_size": f"CASE {_GAP} WHEN o_orderkey % 7 = 0 THEN '1,024' WHEN o_orderkey % 101 = 1 "
    "THEN '-5' WHEN o_orderkey % 13 = 1 THEN 'abc' WHEN o_orderkey % 17 = 1 THEN '2.5' "
    "WHEN o_orderkey % 17 = 2 THEN '3.5' ELSE CAST(o_orderkey AS STRING) END",
    "current_file_location": f"CASE {_GAP} WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 227 = 0 "
    "THEN repeat('/p', 2001) ELSE '/src/' || CAST(o_orderkey AS STRING) END",
    "finding_type": f"CASE {_GAP} ELSE CASE o_orderkey % 13 WHEN 0 THEN 'Obsolete' WHEN 1 THEN 'obsolete' "
    "WHEN 2 THEN 'Quarantined' WHEN 3 THEN 'Restored' WHEN 4 THEN 'Deleted' WHEN 5 THEN 'Not Obsolete' "
    "WHEN 6 THEN 'NotObsolete' WHEN 7 THEN 'Exclusion' WHEN 8 THEN 'TotalPendingQuarantined' "
    "WHEN 9 THEN 'Restoration' WHEN 10 THEN 'Exception' WHEN 11 THEN 'Error' ELSE '' END END",
    "originating_data_system": f"CASE {_GAP} WHEN o_custkey % 5 = 0 THEN 'SMB' WHEN o_orderkey % 71 = 7 "
    "THEN 'Blob' WHEN o_orderkey % 73 = 7 THEN '' ELSE CASE o_orderkey % 6 WHEN 0 THEN 'SMB' "
    "WHEN 1 THEN 'smb' WHEN 2 THEN ' NFS ' WHEN 3 THEN 'M365' WHEN 4 THEN 'OneDrive' "
    "ELSE 'SharePoint' END END",
    "originating_vendor_tool": f"CASE {_GAP} WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 229 = 0 "
    "THEN repeat('v', 101) ELSE 'TLA' END",
    "original_file_location": f"CASE {_GAP} WHEN o_orderkey % 26 = 2 THEN '' "
    "ELSE '/orig/' || CAST(o_orderkey AS STRING) END",
    "quarantine_date": f"CASE {_GAP} WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 "
    "THEN 'not a date' ELSE '2026-01-02 03:04:05' END",
    "last_modified_date": f"CASE {_GAP} WHEN o_orderkey % 83 = 3 THEN '2999-01-01 00:00:00' "
    "ELSE '2020-05-06 07:08:09' END",
    "created_date": f"CASE {_GAP} WHEN o_orderkey % 89 = 3 THEN '2999-01-01 00:00:00' "
    "ELSE '2019-05-06 07:08:09' END",
    "last_accessed_date": f"CASE {_GAP} WHEN o_orderkey % 97 = 3 THEN '2999-01-01 00:00:00' ELSE '' END",
    "detection_date": f"CASE {_GAP} WHEN o_orderkey % 103 = 3 THEN '2999-01-01 00:00:00' "
    "ELSE '2021-05-06 07:08:09' END",
    "risk_level": f"CASE {_GAP} WHEN o_orderkey % 61 = 5 THEN 'Severe' WHEN o_orderkey % 4 = 0 THEN 'Low' "
    "WHEN o_orderkey % 4 = 1 THEN 'HIGH' ELSE '' END",
    "restoration_requestor_email": f"CASE {_GAP} WHEN o_orderkey % 67 = 0 THEN 'bad' WHEN o_orderkey % 67 = 1 "
    "THEN 'a@b@c' WHEN o_orderkey % 67 = 2 THEN '@x' WHEN o_orderkey % 3 = 0 THEN '' "
    "ELSE 'u' || CAST(o_orderkey AS STRING) || '@ex.org' END",
}

# Inbound row of an order: the listed expressions, every other known column empty.
RIG_COLUMNS = {
    "job_id": _EXPRESSIONS["job_id"],
    "row_number": _EXPRESSIONS["row_number"],
    **{c: _EXPRESSIONS.get(c, "''") for c in RAW_COLUMNS},
    "loaded_at": "o_orderdate",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inbound_rows(orders: DataFrame) -> DataFrame:
    """The rig over an orders table (batch or streaming)."""
    return orders.selectExpr(*[f"{expression} AS {name}" for name, expression in RIG_COLUMNS.items()])


def inbound_rig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rig dealt over all tasks, as the supplied table is one file that one task would read."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return inbound_rows(table(spark, sf_dir, "orders").repartition(tasks, "o_orderkey"))


def rig_select_sql() -> str:
    """The same rows as one SELECT over ``orders``."""
    columns = ", ".join(f"{expression} AS {name}" for name, expression in RIG_COLUMNS.items())
    return f"SELECT {columns} FROM orders"
