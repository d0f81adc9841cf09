"""Where intermediate tables live, and how a plan is cut.

A cut is a Parquet table in the shared folder the cluster names in ``spark.checkpoint.dir``,
so a lost executor costs a re-read and never a wrong or partial result.  Only when a local
session names no folder (tests, a laptop) is a temporary one made; on a cluster that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_fallback:
            _local_fallback[app] = tempfile.mkdtemp(prefix="sievework-")
        named = _local_fallback[app]
    return named.rstrip("/")


# Each thread has its own, so that runs at the same time do not drop each other's tables.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Collect the intermediate tables of a run in one folder and drop it at the end."""
    folder = f"{work_root(spark)}/run-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        with tidy(spark):
            yield
    finally:
        _scratch.reset(before)
        remove(spark, folder)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each query as it ends, not when the driver's JVM next collects its plan."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def drop_tables(spark: SparkSession, *labels: str) -> None:
    """Drop the intermediate tables of a run by their labels; outside a run nothing is dropped."""
    folder = _scratch.get()
    for name in children(spark, folder) if folder else []:
        if name.rpartition("-")[0] in labels:
            remove(spark, f"{folder}/{name}")


def fresh_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A path nobody has used yet; inside a scratch run it goes with the run unless kept."""
    folder = _scratch.get() if _scratch.get() and not keep else work_root(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a DataFrame once and go on from the written table.

    Besides cutting the lineage this gives Spark the true size of the result, so that its
    own broadcast threshold decides joins on facts.
    """
    path = fresh_path(df.sparkSession, label, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object behind a path string."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under a path; empty when it does not exist.

    They come over in one text: a table of many jobs has a folder for each, and a call for each would take the driver long.
    """
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    entries = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p))
    if not len(entries):
        return []
    # A name holds no slash, so the path of the folder tells where the next one begins.
    folder = entries[0].getParent().toString().rstrip("/") + "/"
    told = jvm.org.apache.commons.lang3.ArrayUtils.toString(entries)
    return sorted(f",{told[1:-1]}".split(f",{folder}")[1:])


def has_child(spark: SparkSession, path: str, *prefixes: str) -> bool:
    """Whether an entry directly under a path starts so; the listing ends at the first one."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return False
    entries = fs.listStatusIterator(p)
    while entries.hasNext():
        if entries.next().getPath().getName().startswith(prefixes):
            return True
    return False


def ages(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of change (milliseconds) of the entries directly under a path."""
    fs, p = file_system(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file whole, or leave the one that is there; tells whether it was made.

    It is written under another name and then given its own.  A file system with a name node refuses a name that is taken; on a
    local one a link does.  An object store needs a connector whose renames refuse it too.
    """
    fs, final = file_system(spark, path)
    fs.mkdirs(final.getParent())
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(part.toUri().getPath(), final.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            context.rename(part, fs.makeQualified(final), none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError:
        if fs.exists(final):
            return False
        raise
    finally:
        fs.delete(part, False)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, p = file_system(spark, path)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} could not be renamed to {to}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


_BYTES_PER_PARTITION = 128 * 1024 * 1024
# Beyond this, blocks of map times reduce tasks are more than a driver can keep track of.
_MOST_PARTITIONS = 20_000
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def tune(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Session settings the wide row expressions and large inputs want.

    HotSpot never compiles a method above 8000 bytes of bytecode.  With the stock limit a
    wide projection becomes one such method and runs interpreted; with this limit Spark
    evaluates it in many small compiled ones (measured: twice the rows per second).

    The number of shuffle partitions starts from the size of the input, so that a partition
    fits into a task; adaptive execution merges what turns out small.  It is only raised.

    A table of many jobs is listed by a few tasks a core, not by one task a folder (up to 10,000); this is only lowered.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    tasks = 4 * spark.sparkContext.defaultParallelism
    if tasks < int(spark.conf.get(_LISTING, "10000")):
        spark.conf.set(_LISTING, str(tasks))
    wanted = min(-(-input_bytes // _BYTES_PER_PARTITION), _MOST_PARTITIONS)
    start = int(spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > start:
        spark.conf.set(_INITIAL, str(wanted))
    return spark
