"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number).  Splitters are found by counting: each round counts
the exact bytes in the cells between candidate boundaries, over all partitions, and refines only the cells that a
splitter falls into, until a cell is small against a shard.  Then the rows are exchanged once and numbered.

Equal texts are neighbours in this order, so a group of copies stays in one shard unless it has more than a hundredth of a
shard's bytes; then it is cut, which keeps a group with a third of all bytes from making one shard three times too big.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried, partitions, written

FIRST_BITS, NEXT_BITS, BITS = 12, 8, 64
LEVELS = ("_a", "_b", "_r")
LOW = -(1 << 63)
WHOLE = 0.01  # copies of one text with at most this share of a shard are not cut


@dataclass(frozen=True)
class Cell:
    """All keys with ``fixed`` values on the outer levels and the leading ``depth`` bits ``prefix`` on the next one."""

    fixed: tuple[int, ...] = ()
    prefix: int = 0
    depth: int = 0

    @property
    def level(self) -> str:
        return LEVELS[len(self.fixed)]

    def holds(self) -> Column:
        tests = [F.col(LEVELS[i]) == v for i, v in enumerate(self.fixed)]
        if self.depth:
            tests.append(F.shiftright(self.level, BITS - self.depth) == self.prefix)
        return reduce(lambda x, y: x & y, tests, F.lit(True))

    def edge(self, upper: bool) -> tuple[int, ...] | None:
        """Smallest key not below the lower or upper edge; None past the last key."""
        value = (self.prefix + upper) << (BITS - self.depth) if self.depth else LOW + (upper << BITS)
        if value <= -LOW - 1:
            return (*self.fixed, value)
        for i in reversed(range(len(self.fixed))):
            if self.fixed[i] < -LOW - 1:
                return (*self.fixed[:i], self.fixed[i] + 1)
        return None


def _histogram(keys: DataFrame, cells: list[Cell]) -> dict[Cell, list[tuple[Cell, int, int, int]]]:
    """Bytes and least and greatest value of each part of each cell, in key order.

    The result has at most cells x 2^bits rows, whatever the size of the table.
    """
    index = reduce(lambda rest, i: F.when(cells[i].holds(), i).otherwise(rest), reversed(range(len(cells))), F.lit(None))
    step = {c: min(NEXT_BITS if c.depth or c.fixed else FIRST_BITS, BITS - c.depth) for c in cells}
    level = reduce(lambda rest, i: F.when(F.col("_i") == i, F.col(cells[i].level)).otherwise(rest), range(len(cells)), F.lit(None))
    digit = reduce(
        lambda rest, i: F.when(F.col("_i") == i, F.shiftright("_v", BITS - cells[i].depth - step[cells[i]])).otherwise(rest),
        range(len(cells)),
        F.lit(None),
    )
    found = (
        keys.withColumn("_i", index)
        .where("_i is not null")
        .withColumn("_v", level)
        .groupBy("_i", digit.alias("_d"))
        .agg(F.sum("size").alias("bytes"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .collect()
    )
    out: dict[Cell, list[tuple[Cell, int, int, int]]] = {c: [] for c in cells}
    for r in sorted(found, key=lambda r: (r["_i"], r["_d"])):
        c = cells[r["_i"]]
        out[c].append((Cell(c.fixed, r["_d"], c.depth + step[c]), r["bytes"], r["lo"], r["hi"]))
    return out


def splitters(keys: DataFrame, count: int, total: int, tolerance: float) -> list[tuple[int, ...] | None]:
    """Keys that cut the table into ``count`` runs of nearly equal bytes; each is off by at most the tolerance of a
    shard, by half a row or by half a group of copies that is kept whole."""
    small, whole = tolerance * total / count, WHOLE * total / count
    targets = [total * i / count for i in range(1, count)]
    done: dict[int, tuple[int, ...] | None] = {}
    open_at: dict[int, tuple[Cell, int]] = {i: (Cell(), 0) for i in range(len(targets))}
    while open_at:
        cells = list(dict.fromkeys(c for c, _ in open_at.values()))
        parts = _histogram(keys, cells)
        for i, (cell, before) in list(open_at.items()):
            for part, size, lo, hi in parts[cell]:
                if before + size >= targets[i] or part is parts[cell][-1][0]:
                    break
                before += size
            if lo == hi and part.level == LEVELS[0] and size <= whole:
                ended = True
            elif lo == hi and len(part.fixed) + 1 < len(LEVELS):
                part = Cell((*part.fixed, lo))  # one value left: go on with the next level
                ended = False
            else:
                ended = part.depth == BITS or lo == hi
            if size <= small or ended:
                if lo == hi and len(part.fixed) < len(LEVELS) - 1 and part.depth:
                    part = Cell((*part.fixed, lo))
                done[i] = part.edge(upper=targets[i] - before > size / 2)
                del open_at[i]
            else:
                open_at[i] = (part, before)
    return [done[i] for i in range(len(targets))]


def _at_or_after(key: tuple[int, ...] | None) -> Column:
    if key is None:
        return F.lit(False)
    last = len(key) - 1
    test = F.col(LEVELS[last]) >= key[last]
    for i in reversed(range(last)):
        test = (F.col(LEVELS[i]) > key[i]) | ((F.col(LEVELS[i]) == key[i]) & test)
    return test


def shard_by_bytes(
    docs: DataFrame,
    count: int = 16,
    tolerance: float = 0.002,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: list[str] | None = None,
    rows_per_cell: int = 250_000,
) -> DataFrame:
    """Put every row into one of ``count`` shards of nearly equal bytes.

    Returns the columns in ``carry`` (all columns by default) and ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``
    and ``grown_shard``.  A row's size is its UTF-8 bytes plus 1.  Slots number a shard's rows from 0 without gaps: a
    shard is numbered in cells of at most about ``rows_per_cell`` rows, so no task ever orders a whole shard.

    Null texts count as empty (size 1); null ids are ordinary values; repeated rows are separate rows and may be told
    apart by their row number; an empty table gives no rows; an input column with the name of a result column is replaced.
    Only histograms of bounded size reach the driver.
    """
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in (carry or docs.columns) if c not in added]
    bytes_ = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    keys = written(
        docs.select(
            carried(kept),
            (F.octet_length(bytes_).cast("long") + 1).alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.xxhash64(bytes_).alias("_a"),
            F.xxhash64(F.col(doc_id)).alias("_b"),
            F.monotonically_increasing_id().alias("_r"),
        ),
        "shard-keys",
    )
    total = keys.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    cuts = splitters(keys, count, total["bytes"], tolerance) if total["n"] else []
    shard = reduce(lambda x, y: x + y, [_at_or_after(k).cast("int") for k in cuts], F.lit(0))
    cells = max(-(-total["n"] // (count * rows_per_cell)), -(-4 * partitions(docs) // count))
    placed = keys.withColumn("shard", shard).withColumn("_cell", F.pmod(F.xxhash64("_r"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "_cell")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    in_cell = Window.partitionBy("shard", "_cell").orderBy(*LEVELS)
    return (
        placed.withColumn("_at", F.row_number().over(in_cell))
        .join(starts, ["shard", "_cell"])
        .select(
            f"{CARRIED}.*",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_at") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as one Parquet folder each, their rows in slot order within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
