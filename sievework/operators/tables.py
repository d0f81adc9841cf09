"""Stored tables: small keyed tables in versions, large row tables in job partitions.

A keyed table is cut into buckets by the hash of its key; a write replaces the buckets it changes and then takes the next
version number, so a write that dies half-way is never seen and two writers lose nothing.  Row tables are partitioned by job
(findings also by batch group) and written with dynamic partition overwrite, so a retried or
repeated write replaces its own rows and nothing else.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievework import workspace as ws
from sievework.functions.text import is_blank


def key_of(job_id: Column | str) -> Column:
    """Job ids match in any case."""
    return F.lower(F.col(job_id) if isinstance(job_id, str) else job_id)


# --- keyed tables ---------------------------------------------------------------------

BUCKETS = 32
KEEP_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Version:
    """One state of a keyed table: the write that holds each bucket, and the batches that are in it."""

    number: int = 0
    buckets: int = BUCKETS
    parts: dict[int, str] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "parts": self.parts, "marks": self.marks})


class LostRace(RuntimeError):
    """Other writers were first every time."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a keyed table, oldest first."""
    return sorted(int(n[2:]) for n in ws.children(spark, f"{path}/versions") if n.startswith("v-"))


def current(spark: SparkSession, path: str) -> Version:
    found = versions(spark, path)
    if not found:
        return Version()
    told = json.loads(ws.read_text(spark, f"{path}/versions/v-{found[-1]:010d}"))
    return Version(found[-1], told["buckets"], {int(b): w for b, w in told["parts"].items()}, told["marks"])


def _bucket(job_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key_of(job_id)), F.lit(buckets)).cast("int")


def _read_parts(spark: SparkSession, path: str, version: Version, schema: StructType, some: set[int] | None = None) -> DataFrame:
    paths = [f"{path}/rows/{w}/_bucket={b}" for b, w in sorted(version.parts.items()) if some is None or b in some]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Current version of a keyed table; empty before the first write."""
    return _read_parts(spark, path, current(spark, path), schema)


def upsert_keyed(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    schema: StructType,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    batch: tuple[str, int] | None = None,
    buckets: int = BUCKETS,
    tries: int = 30,
) -> set[int]:
    """Merge rows into a keyed table by job id; returns the buckets that were rewritten.

    Only buckets that a row falls into are read, merged (``merge(old, rows)``, by default :func:`merged_jobs`) and written, beside
    the ones of earlier versions.  A version is a small file that names the write of every bucket and is made only if nobody made
    that number before.  A writer that comes second keeps its work where the other one changed other buckets, and merges anew
    where they share one, so nothing is lost.  ``batch`` (name, number) is noted in the version; a batch of a name that is not
    beyond the noted one changes nothing.  The rows are evaluated once.  Several rows of a job are all kept; give the newest one.
    """
    given = ws.fresh_path(spark, "upsert")
    try:
        rows.select(*schema.names).write.parquet(given)
        return _merge_until_first(spark, path, spark.read.schema(schema).parquet(given), schema, merge or merged_jobs, batch, buckets, tries)
    finally:
        ws.remove(spark, given)


def _merge_until_first(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    schema: StructType,
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    batch: tuple[str, int] | None,
    buckets: int,
    tries: int,
) -> set[int]:
    touched: dict[int, set[int]] = {}
    base, done, write, filled = current(spark, path), None, "", set()
    for _ in range(tries):
        if batch and base.marks.get(batch[0], -1) >= batch[1]:
            return set()
        size = base.buckets if base.number else buckets
        if size not in touched:
            touched[size] = {r[0] for r in rows.select(_bucket("job_id", size)).distinct().collect()}
        some = touched[size]
        if done is None or size != done.buckets or any(base.parts.get(b) != done.parts.get(b) for b in some):
            write, done = f"w-{uuid.uuid4().hex}", Version(base.number, size, base.parts)
            merged = merge(_read_parts(spark, path, base, schema, some), rows)
            if some:
                merged = merged.select(*schema.names, _bucket("job_id", size).alias("_bucket"))
                merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows/{write}")
            filled = {int(n[len("_bucket=") :]) for n in ws.children(spark, f"{path}/rows/{write}") if n.startswith("_bucket=")}
        parts = {b: w for b, w in base.parts.items() if b not in some} | dict.fromkeys(filled & some, write)
        marks = base.marks | ({batch[0]: batch[1]} if batch else {})
        new = Version(base.number + 1, size, parts, marks)
        if ws.create_text(spark, f"{path}/versions/v-{new.number:010d}", new.text()):
            forget(spark, path)
            return some
        base = current(spark, path)
    raise LostRace(path)


def forget(spark: SparkSession, path: str, seconds: int = KEEP_SECONDS) -> None:
    """Drop versions and writes older than ``seconds`` that the current version does not need.

    Readers of an older version have that long; so has a writer that has not made its version yet.
    """
    now, keep = current(spark, path), set()
    before = int(time.time() - seconds) * 1000
    for name, changed in ws.ages(spark, f"{path}/versions"):
        if name.startswith("v-"):
            if int(name[2:]) < now.number and changed < before:
                ws.remove(spark, f"{path}/versions/{name}")
    old = [name for name, changed in ws.ages(spark, f"{path}/rows") if changed < before]
    if old:
        for number in versions(spark, path):
            keep |= set(json.loads(ws.read_text(spark, f"{path}/versions/v-{number:010d}"))["parts"].values())
    for name in old:
        if name not in keep:
            ws.remove(spark, f"{path}/rows/{name}")


def newest_per_job(rows: DataFrame, stamp: str) -> DataFrame:
    """One row per job, the last writer's.  An aggregate, so copies combine before the shuffle."""
    picked = F.max_by(F.struct(*rows.columns), stamp)
    return rows.groupBy(key_of("job_id").alias("_key")).agg(picked.alias("r")).select("r.*")


def merged_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by job id: the old rows without the new keys, then the new rows."""
    keys = new.select(key_of("job_id").alias("_key")).distinct()
    kept = old.join(keys, key_of(old["job_id"]) == keys["_key"], "left_anti")
    return kept.unionByName(new)


def merged_checkpoints(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """As :func:`merged_jobs`; stamps the checkpoint time and keeps the first creation time."""
    first = old.select(key_of("job_id").alias("_key"), F.col("created_at_utc").alias("_first"))
    stamped = (
        new.withColumn("_key", key_of("job_id"))
        .join(first, "_key", "left")
        .withColumn("created_at_utc", F.coalesce("_first", now))
        .withColumn("last_checkpoint_utc", now)
    )
    return merged_jobs(old, stamped.select(*old.columns))


def lookup_jobs(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted jobs, ids in any case; blank ids find nothing."""
    keys = wanted.where(~is_blank("job_id")).select(key_of("job_id").alias("_key")).distinct()
    return table.join(keys, key_of(table["job_id"]) == keys["_key"], "left_semi")


# --- row tables -----------------------------------------------------------------------

# Row tables stay and are read whole, so they are kept small.
CODEC = "zstd"


def replace_partitions(df: DataFrame, path: str, by: list[str], rows_per_file: int = 0) -> None:
    """Write rows so that exactly the partitions they fall in are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", rows_per_file
    ).option("compression", CODEC).partitionBy(*by).parquet(path)


def _job_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, job id) of the partitions of a row table; a staged table has them below its days, which are few."""
    days = [f"{path}/{n}" for n in ws.children(spark, path) if n.startswith(f"{EXPIRY_DAY}=")]
    return [(f"{p}/{n}", unquote(n[len("job_id=") :])) for p in [path, *days] for n in ws.children(spark, p) if n.startswith("job_id=")]


def delete_job_rows(spark: SparkSession, path: str, job_ids: Iterable[str]) -> int:
    """Drop the partitions of jobs (ids in any case); blank or unknown ids do nothing."""
    wanted = {j.lower() for j in job_ids if j and j.strip()}
    folders = [p for p, job in _job_folders(spark, path) if job.lower() in wanted] if wanted else []
    for folder in folders:
        ws.remove(spark, folder)
    return len(folders)


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a partitioned table; empty before the first write."""
    if not ws.has_child(spark, path, "job_id=", f"{EXPIRY_DAY}="):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


# --- staged rows ----------------------------------------------------------------------

# Staged rows lie in the day they expire on, so that a purge drops whole days.
EXPIRY_DAY = "expiry_day"


def write_staged(staged: DataFrame, path: str, unit: str = "day") -> None:
    """Write staged rows, so that the jobs they belong to are replaced in the day (or month) they expire in."""
    replace_partitions(staged.withColumn(EXPIRY_DAY, F.to_date(F.date_trunc(unit, "expires_at"))), path, [EXPIRY_DAY, "job_id"])


def purge_expired(spark: SparkSession, path: str, now: datetime, unit: str = "day") -> list[str]:
    """Remove staged rows whose time has run out at ``now``; returns the days (first days of months) that were dropped or rewritten.

    Days that are over go as a whole, without being read.  Today's is read for expired rows and, if it has any, written anew
    without them and exchanged for the old one.  A purge that died in between is completed by the next.
    """
    first = (now.astimezone(timezone.utc) if now.tzinfo else now).date()
    today = (first.replace(day=1) if unit == "month" else first).isoformat()
    names = ws.children(spark, path)
    for name in names:
        if name.startswith(_BEFORE):  # the old folder of an exchange that was cut short
            day = name[len(_BEFORE) :]
            if day in names:
                ws.remove(spark, f"{path}/{name}")
            else:
                ws.rename(spark, f"{path}/{name}", f"{path}/{day}")
    days = [n for n in ws.children(spark, path) if n.startswith(f"{EXPIRY_DAY}=")]
    over = [n for n in days if n[len(EXPIRY_DAY) + 1 :] < today]
    for name in over:
        ws.remove(spark, f"{path}/{name}")
    border = f"{EXPIRY_DAY}={today}"
    if border in days:
        rows = spark.read.parquet(f"{path}/{border}")
        if not rows.where(F.col("expires_at") <= F.lit(now)).isEmpty():
            fresh = f"{path}/_new-{uuid.uuid4().hex}"
            rows.where(F.col("expires_at") > F.lit(now)).write.partitionBy("job_id").parquet(fresh)
            ws.rename(spark, f"{path}/{border}", f"{path}/{_BEFORE}{border}")
            ws.rename(spark, fresh, f"{path}/{border}")
            ws.remove(spark, f"{path}/{_BEFORE}{border}")
            over.append(border)
    return [n[len(EXPIRY_DAY) + 1 :] for n in over]


_BEFORE = "_before-"


def staged_rows(numbered: DataFrame, now: Column, days: int) -> DataFrame:
    """Ordered staged copy of valid rows with creation and expiry time."""
    finding = F.struct(*[c for c in numbered.columns if c not in ("job_id", "sequence_number")])
    return numbered.select(
        "job_id",
        "sequence_number",
        finding.alias("finding"),
        now.alias("created_at_utc"),
        (now + F.make_dt_interval(F.lit(days))).alias("expires_at"),
    )


def staged_counts(staged: DataFrame) -> DataFrame:
    """Rows staged per job."""
    return staged.groupBy("job_id").agg(F.count("*").alias("staged_rows"))


def spread_for_write(df: DataFrame, rows_per_file: int, order: str = "sequence_number") -> DataFrame:
    """Shuffle rows so that a task writes whole slices of a job, and a hot job many tasks."""
    return df.repartition(F.col("job_id"), F.floor((F.col(order) - 1) / rows_per_file))
