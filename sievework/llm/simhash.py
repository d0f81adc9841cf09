"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints within two bits of each other are linked.  A fingerprint is cut into two halves; two fingerprints within two
bits differ by at most one bit in one half, so that half, with the right bit struck out (a wildcard), is the same on both
sides.  Each distinct fingerprint is indexed under all of its 2 x 32 one-wildcard half variants, candidates meet by an
equality join on the variant, and the bit distance is verified.

A variant that many fingerprints share is not paired.  Its members get the wildcard carried on into the other half: one
bit struck out there as well, or two bits there and none here.  Equal two-wildcard signatures are always within two
bits, so a chain through the smallest member of each signature holds every link's connection; the number of rows per
member is fixed, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, SORTED, carried, written

HALF = 32
SEED = 42
SHARED = 64  # a variant with more members than this is split further instead of paired
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingle = min(shingle, len(tokens))
    n = len(tokens) - shingle + 1
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        spans = map(b" ".join, zip(*(tokens[at + k : end + k] for k in range(shingle))))
        hashes = np.fromiter((digest(s, SEED) for s in spans), np.uint64, end - at)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Columns in ``carry`` (as one), ``_id`` and ``_fp``, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            marks = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64())], names=[CARRIED, "_id", "_fp"])

    source = docs.select(carried(carry), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    return source.mapInArrow(run, source.select(CARRIED, "_id", F.lit(0).cast("long").alias("_fp")).schema)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _variants(mark: str) -> Column:
    """All one-wildcard half variants: (half, wildcard, value), the value with the struck-out bit cleared."""
    return F.expr(
        f"flatten(transform(array(0, 1), s -> transform(sequence(0, {HALF - 1}), i -> struct(cast(s as tinyint) as half, cast(i as tinyint) as wild,"
        f" cast((shiftrightunsigned({mark}, s * {HALF}) & {(1 << HALF) - 1}L) & ~shiftleft(1L, i) as bigint) as value))))"
    )


def _hub_edges(crowded: DataFrame) -> DataFrame:
    """Links inside variants that many fingerprints share, through two-wildcard signatures of the whole fingerprint."""
    other = F.when(F.col("half") == 0, HALF).otherwise(0)  # where the other half begins
    here = F.when(F.col("half") == 0, 0).otherwise(HALF)
    one = crowded.select(
        "_fp", (here + F.col("wild")).alias("w1"), F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("_j"), other.alias("_o")
    ).select("_fp", "w1", (F.col("_o") + F.col("_j")).alias("w2"))
    pairs = F.expr(
        f"flatten(transform(sequence(0, {HALF - 2}), i -> transform(sequence(i + 1, {HALF - 1}), j -> struct(i as i, j as j))))"
    )
    two = (
        crowded.select("_fp", other.alias("_o")).distinct().select("_fp", "_o", F.explode(pairs).alias("_p"))
    ).select("_fp", (F.col("_o") + F.col("_p.i")).alias("w1"), (F.col("_o") + F.col("_p.j")).alias("w2"))
    struck = F.expr("_fp & ~(shiftleft(1L, w1) | shiftleft(1L, w2))")
    signed = one.unionByName(two).select(
        "_fp", F.least("w1", "w2").cast("tinyint").alias("w1"), F.greatest("w1", "w2").cast("tinyint").alias("w2"), struck.alias("sign")
    )
    hubs = signed.groupBy("sign", "w1", "w2").agg(F.min("_fp").alias("hub"), F.max("_fp").alias("_top")).where("hub < _top")
    return signed.join(hubs.hint(SORTED), ["sign", "w1", "w2"]).where("_fp > hub").select(F.col("hub").alias("a"), F.col("_fp").alias("b")).distinct()


def link_fingerprints(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a < b`` that connect every two distinct fingerprints within ``radius`` (at most 2) bits.

    ``marks`` has one row per distinct ``_fp``.  Links of crowded variants go through their smallest member.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the halves of a fingerprint guarantee two bits at most")
    spread = marks.select("_fp", F.inline_outer(_variants("_fp")))
    key = ["half", "wild", "value"]
    met = spread.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    candidates = written(spread.join(met.hint(SORTED), key), "simhash-variants")
    few = candidates.where(F.col("_n") <= SHARED)
    left, right = few.select(*key, F.col("_fp").alias("a")), few.select(*key, F.col("_fp").alias("b"))
    direct = left.join(right.hint(SORTED), key).where((F.col("a") < F.col("b")) & (_distance("a", "b") <= radius)).select("a", "b").distinct()
    if radius < 2:  # two-wildcard signatures may be two bits apart, so crowded variants need their own check
        crowded = _hub_edges(candidates.where(F.col("_n") > SHARED)).where(_distance("a", "b") <= radius)
        return direct.unionByName(crowded).distinct() if radius else direct.limit(0)
    return direct.unionByName(_hub_edges(candidates.where(F.col("_n") > SHARED))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of a link, as ``node`` and ``root``.

    Alternating large-star and small-star rounds: every node hands its larger, then its smaller neighbours to the smallest
    one it knows.  Each round is one aggregate and one join on written tables, so the lineage stays short; it ends when a
    round changes nothing.
    """
    edges = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "component-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now each link points from a larger node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "component-round")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(
    docs: DataFrame,
    carry: list[str] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``carry`` (all columns by default) with ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest id that can be reached over links, the document's own included.  Documents without
    words have fingerprint zero and are linked like any other; rows with a null id belong to their component without
    naming it, and a component of null ids alone has a null id; repeated rows share a fingerprint and so a component; an
    empty table gives no rows; input columns named as a result column are replaced.
    """
    kept = [c for c in (carry or docs.columns) if c not in ("fingerprint", "component_id")]
    marked = written(with_fingerprints(docs, kept, text, doc_id, shingle), "simhash-marks")
    marks = written(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "simhash-distinct")
    roots = components(link_fingerprints(marks.select("_fp"), radius))
    grouped = marks.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("_least").alias("component_id"))
    class_of = written(grouped.join(named, "root").select("_fp", "component_id"), "simhash-classes")
    return marked.join(class_of, "_fp").select(
        f"{CARRIED}.*", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One document of each component, the one with the smallest id; of equal ids the first row."""
    numbered = written(docs.select(carried(docs.columns), F.monotonically_increasing_id().alias("_row")), "simhash-input")
    plain = numbered.select("_row", F.col(f"{CARRIED}.{doc_id}").alias("_doc"), F.col(f"{CARRIED}.text").alias("text"))
    found = near_duplicates(plain, ["_row", "_doc"], doc_id="_doc", shingle=shingle, radius=radius)
    # A component of null ids alone has no name; its fingerprint tells it apart.
    least = found.groupBy(F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))).agg(
        F.min(F.struct(F.col("_doc").isNull().alias("no_id"), F.col("_doc").alias("id"), F.col("_row").alias("row"))).alias("_first")
    )
    return numbered.join(least.select(F.col("_first.row").alias("_row")), "_row", "left_semi").select(f"{CARRIED}.*")
