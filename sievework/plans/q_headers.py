"""Registered queries over report headers: one report layout per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.layout import HEADERS
from sievework.operators import headers as hd
from sievework.plans.registry import query
from sievework.plans.rig import table
from sievework.sources import intake

# Every customer sends one report.  Spelling and faults follow from the customer key.
_SPELL = (
    "CASE c_custkey % 4 WHEN 0 THEN {h} WHEN 1 THEN upper(replace({h}, '_', ' ')) WHEN 2 THEN ' ' || lower(replace({h}, '_', '-')) || ' ' "
    "ELSE replace({h}, '_', '') END"
)
_CELL = (
    "CASE WHEN c_custkey % 11 = 5 THEN '  ' WHEN c_custkey % 13 = 7 AND {pos} = 3 THEN '' WHEN c_custkey % 17 = 2 AND {pos} = 8 THEN 'finding file name' "
    "WHEN c_custkey % 19 = 3 AND {pos} IN (1, 6) THEN 'Column ' || CAST(c_custkey AS STRING) ELSE " + _SPELL + " END"
)
_VALUES = ", ".join(f"({i}, '{h}')" for i, h in enumerate(HEADERS, start=1))
_ROWS = f"SELECT c_custkey, pos, {_CELL.format(pos='pos', h='h')} AS cell FROM customer CROSS JOIN (VALUES {_VALUES}) v(pos, h)"
_NORM = "lower(replace(replace(replace(trim({c}), ' ', ''), '_', ''), '-', ''))"
_KEYED = f"SELECT c_custkey, pos, trim(cell) AS name, {_NORM.format(c='cell')} AS key FROM ({_ROWS}) r"
_KNOWN = "SELECT pos AS known_pos, h AS header, " + _NORM.format(c="h") + f" AS known_key FROM (VALUES {_VALUES}) k(pos, h)"


def report_headers(spark, sf):
    """``c_custkey, headers``: the header cells of every customer's report, one row each.

    The customers are dealt over all tasks, as a row becomes a whole header and the supplied table is one file that few tasks would read.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = [F.expr(_CELL.format(pos=i, h=f"'{h}'")) for i, h in enumerate(HEADERS, start=1)]
    customers = table(spark, sf, "customer").select("c_custkey").repartition(tasks)
    return customers.select("c_custkey", F.array(*cells).alias("headers"))


@query(f"SELECT c_custkey, pos - 1 AS pos, key AS header_key FROM ({_KEYED}) k")
def normalize_header(spark, sf):
    cells = report_headers(spark, sf).select("c_custkey", F.posexplode("headers").alias("pos", "cell"))
    return cells.select("c_custkey", "pos", hd.normalized("cell").alias("header_key"))


@query(f"SELECT c_custkey, count(*) FILTER (name <> '') = 0 AS is_empty FROM ({_KEYED}) k GROUP BY c_custkey")
def header_empty_check(spark, sf):
    return hd.with_header_keys(report_headers(spark, sf)).select("c_custkey", (hd.named_count() == 0).alias("is_empty"))


_DUPLICATES = (
    "SELECT c_custkey, string_agg(name, ', ' ORDER BY pos) AS names FROM (SELECT c_custkey, key, min(pos) AS pos, arg_min(name, pos) AS name "
    f"FROM ({_KEYED}) k WHERE name <> '' GROUP BY c_custkey, key HAVING count(*) > 1) d GROUP BY c_custkey"
)


@query(f"SELECT c_custkey, coalesce(names, '') AS duplicates FROM customer LEFT JOIN ({_DUPLICATES}) d USING (c_custkey)")
def header_duplicates(spark, sf):
    return hd.with_header_keys(report_headers(spark, sf)).select("c_custkey", F.array_join(hd.duplicate_headers(), ", ").alias("duplicates"))


_MISSING = (
    "SELECT c_custkey, string_agg(header, ', ' ORDER BY known_pos) AS names FROM customer CROSS JOIN "
    f"({_KNOWN}) w WHERE known_pos <= 6 AND NOT EXISTS (SELECT 1 FROM ({_KEYED}) k WHERE k.c_custkey = customer.c_custkey AND key = known_key) GROUP BY c_custkey"
)


@query(f"SELECT c_custkey, coalesce(names, '') AS missing FROM customer LEFT JOIN ({_MISSING}) d USING (c_custkey)")
def header_missing_required(spark, sf):
    return hd.with_header_keys(report_headers(spark, sf)).select("c_custkey", F.array_join(hd.missing_headers(), ", ").alias("missing"))


@query(
    f"SELECT c.c_custkey, header, CAST(coalesce(p.pos, 0) AS INTEGER) AS place FROM customer c CROSS JOIN ({_KNOWN}) w "
    f"LEFT JOIN (SELECT c_custkey, key, min(pos) AS pos FROM ({_KEYED}) k GROUP BY ALL) p ON p.c_custkey = c.c_custkey AND p.key = w.known_key"
)
def column_resolve(spark, sf):
    places = hd.with_header_keys(report_headers(spark, sf)).select("c_custkey", F.posexplode(hd.positions()).alias("i", "place"))
    known = F.array(*[F.lit(h) for h in HEADERS])
    return places.select("c_custkey", F.get(known, F.col("i")).alias("header"), "place")


# --- intake: every document is a file that somebody sends --------------------------------
_FILE = "CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.tar.CSV' END"
_SIZE = "CASE WHEN doc_id % 7 = 3 THEN 0 ELSE n_chars END"
_LIMIT = 4000


@query(
    f"SELECT doc_id, CASE WHEN {_SIZE} = 0 THEN 'empty' WHEN {_SIZE} > {_LIMIT} THEN 'too_large' WHEN doc_id % 5 IN (2, 3) THEN 'unsupported_format' END AS refusal FROM documents"
)
def intake_manifest(spark, sf):
    files = table(spark, sf, "documents").selectExpr("doc_id", f"{_FILE} AS name", f"{_SIZE} AS size")
    return files.select("doc_id", intake.refusal("name", "size", _LIMIT).alias("refusal"))


_DOC_PATH = f"'mem:/in/' || {_FILE}"


@query(
    "SELECT doc_id, '{\"ReportUid\":\"U-' || doc_id || '\",\"InboundFileName\":\"' || name || '\",\"FileSizeBytes\":' || size || ',\"FileFormat\":\"' || fmt || "
    "'\",\"S3FolderPath\":\"2026/01/U-' || doc_id || '/\",\"SourceFilePath\":\"2026/01/U-' || doc_id || '/' || name || "
    "'\",\"UploadedAtUtc\":\"2026-01-01T00:00:00Z\",\"Status\":\"Uploaded\"}' AS document FROM "
    f"(SELECT doc_id, {_FILE} AS name, {_SIZE} AS size, CASE doc_id % 5 WHEN 1 THEN 'xlsx' ELSE 'csv' END AS fmt FROM documents "
    f"WHERE {_SIZE} > 0 AND {_SIZE} <= {_LIMIT} AND doc_id % 5 NOT IN (2, 3)) t"
)
def intake_metadata_json(spark, sf):
    files = table(spark, sf, "documents").selectExpr("doc_id", f"{_DOC_PATH} AS file_path", f"{_SIZE} AS file_size_bytes")
    received = F.lit("2026-01-01 00:00:00").cast("timestamp")
    uid = F.concat(F.lit("U-"), F.regexp_extract("file_path", r"/in/(\d+)", 1))
    manifest = intake.intake_manifest(files, received, _LIMIT, uid)
    documents = intake.intake_metadata_json(manifest)
    return documents.select(F.expr("CAST(substring(job_id, 3) AS BIGINT)").alias("doc_id"), "document")
