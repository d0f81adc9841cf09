"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

A benchmark item of n words is compared with windows of n words.  Every window that shares a five-word shingle with an item
of its length is fingerprinted (a window that shares none has similarity zero).  Fingerprints are cut into one block more
than the radius, so two of them within the radius agree on at least one block: an equality join on (item, block, value)
finds all of them among the windows and the items they share a shingle with, the bit distance is checked, and the weighted
Jaccard similarity of the shingles decides.  Rows that are spread over blocks carry fingerprints, no shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import SORTED, words, written

SHINGLE = 5

# Arrays are taken apart with the outer forms throughout: for the others Spark infers a filter on the array, moves it below
# the projection that splits the text, and so splits the text anew for every shingle.


def _shingles(array: str, width: int = SHINGLE) -> Column:
    """Hashes of all shingles in order; empty for shorter texts."""
    parts = ", ".join(f"{array}[i + {k}]" for k in range(width))
    return F.expr(
        f"case when size({array}) >= {width} then transform(sequence(0, size({array}) - {width}), i -> xxhash64({parts})) "
        "else cast(array() as array<bigint>) end"
    )


def simhash(hashes: str, most: int) -> str:
    """SQL for the 64-bit SimHash of an array of hashes with at most ``most`` entries, repeats included.

    Votes are counted side by side: a lane of 8, 16 or 32 bits per counter, several counters in one number.  The highest
    bit of a lane stays free, so that no sum leaves the range of a signed number.
    """
    lane = 8 if most < 1 << 7 else 16 if most < 1 << 15 else 32
    ones = sum(1 << at for at in range(0, 64, lane))
    mask = f"{ones}L" if ones < 1 << 63 else f"cast({ones - (1 << 64)} as bigint)"
    votes = (
        f"aggregate({hashes}, array_repeat(0L, {lane}), "
        f"(acc, h) -> transform(acc, (v, j) -> v + (shiftrightunsigned(h, j) & {mask})))"
    )
    bit = f"2 * (shiftrightunsigned(votes[b % {lane}], {lane} * cast(floor(b / {lane}) as int)) & {(1 << lane) - 1}L) > size({hashes})"
    return (
        f"aggregate(transform(array({votes}), votes -> aggregate(sequence(0, 63), 0L, (f, b) -> "
        f"f | case when {bit} then shiftleft(1L, b) else 0L end)), 0L, (a, x) -> x)"
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``radius + 1`` blocks that cover all 64 bits."""
    if not 0 <= radius < 64:
        raise ValueError("radius is from 0 to 63")
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _block_values(mark: str, blocks: list[tuple[int, int]]) -> str:
    parts = [f"shiftrightunsigned({mark}, {at}) & {(1 << width) - 1}L" if width < 64 else mark for at, width in blocks]
    return f"array({', '.join(parts)})"


# Without repeats the common part is a set operation.
_COMMON = (
    "case when size(array_distinct(hashes)) = size(hashes) and size(array_distinct(item_hashes)) = size(item_hashes) "
    "then size(array_intersect(hashes, item_hashes)) "
    "else aggregate(array_distinct(item_hashes), 0, (a, x) -> a + least(size(filter(hashes, y -> y = x)), size(filter(item_hashes, y -> y = x)))) end"
)


# Windows of one length that start before or at a hit and still cover its shingle; ``_ats`` ascends, and each hit adds only
# the starts behind those of the hit before, so the list is as long as the windows are many.
_STARTS = f"""
case when n <= _n then flatten(transform(_ats, (at, i) ->
    case when i = 0 then sequence(greatest(0, at - n + {SHINGLE}), least(at, _n - n))
         when greatest(0, at - n + {SHINGLE}, least(_ats[i - 1], _n - n) + 1) <= least(at, _n - n)
         then sequence(greatest(0, at - n + {SHINGLE}, least(_ats[i - 1], _n - n) + 1), least(at, _n - n))
         else cast(array() as array<int>) end))
else array(0) end"""


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    similarity: float = 0.8,
    radius: int = 20,
    text: str = "text",
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it contains: ``_key``, ``doc_id``, ``item_id``, ``similarity``, ``distance``, ``start``
    and ``n_words`` of the most similar window (the first of equals).

    Words are lower-cased.  Items with fewer than five words have no shingle and match nothing, nor do null and empty texts.
    A text shorter than an item is one window if it is long enough to be similar at all.  Long texts are searched whole.
    ``_key`` is a hash of id and text: repeated rows share it and give one row; documents with null ids are searched too.
    Equal items are reported each.  Empty tables give no rows.  Only the named columns are used, so others cannot clash.
    Tables about items and the keys of documents that share a shingle with one are joined by broadcast only as far as
    Spark's size limit allows.
    """
    blocks = _blocks(radius)
    listed = items.select(F.col(item_id).alias("item_id"), words(F.lower(item_text)).alias("_w"))
    listed = written(
        listed.where(F.size("_w") >= SHINGLE).select(
            F.monotonically_increasing_id().alias("_item"), "item_id", F.size("_w").alias("n"), _shingles("_w").alias("item_hashes")
        ),
        "benchmark-items",
    )
    most = listed.agg(F.max(F.size("item_hashes"))).first()[0] or 0
    anchors = written(listed.select("_item", "n", F.explode("item_hashes").alias("h")).distinct(), "benchmark-shingles")
    key = F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text))
    keyed = docs.select(key.alias("_key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def split(rows: DataFrame) -> DataFrame:
        return rows.select("_key", "doc_id", words(F.lower("_text")).alias("_w")).select(
            "_key", "doc_id", F.size("_w").alias("_n"), _shingles("_w").alias("_h")
        )

    # 1. Which windows share a shingle with which items; the others have similarity zero.
    met = (
        split(keyed).select("_key", "_n", F.posexplode_outer("_h").alias("at", "h"))
        .join(anchors, "h")
        .where((F.col("n") <= F.col("_n")) | (F.col("_n") - (SHINGLE - 1) >= F.lit(similarity) * (F.col("n") - (SHINGLE - 1)) - 1e-9))
        .groupBy("_key", "_item", "n", "_n")
        .agg(F.sort_array(F.collect_set("at")).alias("_ats"))
    )
    met = written(met.select("_key", "_item", "n", F.expr(_STARTS).alias("starts")), "benchmark-hits")
    # 2. The shingles of those documents only, repeated rows once.
    wanted = written(met.select("_key").distinct(), "benchmark-keys")
    hashed = split(keyed.join(wanted, "_key", "left_semi")).groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first("_h").alias("_h"))
    hashed = written(hashed, "benchmark-documents")
    # 3. One fingerprint a window, whatever the number of items it meets.
    windows = met.groupBy("_key", "n").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    windows = (
        windows.join(hashed.hint(SORTED), "_key")
        .select("_key", "n", "_h", F.explode_outer("starts").alias("start"))
        .select("_key", "n", "start", F.expr(f"slice(_h, start + 1, n - {SHINGLE - 1})").alias("hashes"))
        .select("_key", "n", "start", F.expr(simhash("hashes", most)).alias("mark"))
    )
    pairs = met.select("_key", "_item", "n", F.explode_outer("starts").alias("start")).join(windows.hint(SORTED), ["_key", "n", "start"])
    # 4. Window and item meet in a block; a pair may agree on several and is taken at the first.
    indexed = listed.withColumn("item_mark", F.expr(simhash("item_hashes", most))).select(
        "_item", "item_mark", F.posexplode_outer(F.expr(_block_values("item_mark", blocks))).alias("block", "value")
    )
    marked = pairs.withColumn("_values", F.expr(_block_values("mark", blocks)))
    spread = marked.select("_key", "_item", "n", "start", "mark", F.posexplode_outer("_values").alias("block", "value"))
    near = (
        spread.join(written(indexed, "benchmark-blocks"), ["_item", "block", "value"])
        .withColumn("distance", F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))))
        .where(F.col("distance") <= radius)
        .where(F.col("block") == F.expr(f"array_position({_block_values('(mark ^ item_mark)', blocks)}, 0L) - 1"))
        .select("_key", "_item", "start", "distance")
    )
    # 5. Only now the shingles themselves.
    verified = (
        near.join(listed, "_item")
        .join(hashed, "_key")
        .withColumn("hashes", F.expr(f"slice(_h, start + 1, n - {SHINGLE - 1})"))
        .select("_key", "doc_id", "item_id", "n", "start", "distance", "hashes", "item_hashes", F.expr(_COMMON).alias("_common"))
        .withColumn("similarity", F.col("_common") / (F.size("hashes") + F.size("item_hashes") - F.col("_common")))
        .where(F.col("similarity") >= similarity)
        .withColumn("n_words", F.size("hashes") + (SHINGLE - 1))
    )
    best = F.max_by(F.struct("similarity", "distance", "start", "n_words"), F.struct("similarity", -F.col("start")))
    return verified.groupBy("_key", "doc_id", "item_id").agg(best.alias("_best")).select("_key", "doc_id", "item_id", "_best.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Documents that contain no item; all columns stay, repeated rows go or stay together."""
    key = F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text))
    found = written(contaminated(docs, items, text=text, doc_id=doc_id).select("_key").distinct(), "contaminated")
    return docs.withColumn("_contaminated_key", key).join(found.withColumnRenamed("_key", "_contaminated_key"), "_contaminated_key", "left_anti").drop("_contaminated_key")
