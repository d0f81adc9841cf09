"""Removal of byte strings that occur twice, found in suffix arrays of shards.

A window is a string of ``span`` bytes inside one text.  Equal windows must meet in one shard, and a shard must fit into a
task, so windows are routed by their anchor: the smallest hash of the 16-byte grams inside the window.  Neighbouring windows
with one anchor form a piece; a text of n bytes has about n / 193 pieces at a span of 400.

1. Every piece is described by its anchor, a 128-bit digest of its bytes and the hashes of what lies on both sides of the anchor.  Equal
   pieces are counted as one class with a number of copies, and only classes whose anchor occurs again go on; no exchange carries text.
   Equal windows hold their anchor at one place, and on one side of it at least half of what the window has besides.  So classes go on
   only where a side is shared, or where an anchor lies twice in a piece; of the others those with copies are repeated as a whole.
2. One copy of each class is read, and the classes of one anchor are brought together.  An anchor with more than a shard's bytes of
   different pieces is split by the second anchor (of another hash) of its windows, which equal windows share as well.
3. Anchors are gathered into shards of bounded size (2 MB by default).  A shard's suffix array is induced, its permuted common prefixes
   are computed, and a window is repeated if it shares ``span`` bytes with a neighbour in the array, or if its class has copies.
4. Repeated windows go back to all pieces of their class, and what they cover is cut out of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried, written
from sievework.llm.suffix_array import repeated

GRAM = 16
SHARD = 2 << 20  # bytes of a suffix array, and of the pieces on one anchor before it is split
_CHUNK = 1 << 20  # windows that are hashed at once
_LONGEST = 4096  # windows of a piece
_SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(data: bytes, seed: int) -> np.ndarray:
    """Hash of every run of ``GRAM`` bytes."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    for k in range(8):
        eight[k::8] = np.frombuffer(data, "<u8", (n - k + 7) // 8, k)
    out = eight[: n - 8] * _SEEDS[seed] + eight[8:] * _ODD
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest value of every ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return values if reach == width else pick(values[: len(values) - (width - reach)], values[width - reach :])


def pieces(texts: list[bytes | memoryview], span: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """Pieces of texts that have a window at least: number of the text, anchor, first window, number of windows, of the anchor's places, and the first of these.

    The texts are hashed in one buffer; windows that reach over the end of a text are left out.
    """
    width = span - GRAM + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    grams = _grams(b"".join(texts), seed)
    least = _sliding(grams, width, np.minimum)
    edges = np.zeros(len(least) + 1, np.int8)
    edges[starts] = 1
    edges[starts + sizes - span + 1] = -1
    inside = np.cumsum(edges[:-1]).astype(bool)
    changes = np.concatenate(([True], least[1:] != least[:-1]))
    first = np.flatnonzero(inside & (changes | (edges[:-1] == 1)))
    last = np.flatnonzero(inside & np.append(changes[1:] | (edges[1:-1] == -1), True))
    count = last - first + 1
    if int(count.max()) > _LONGEST:
        parts = -(-count // _LONGEST)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - nth * _LONGEST, _LONGEST)
        first = np.repeat(first, parts) + nth * _LONGEST
    # A gram is an anchor's place if it is the least of some window over it.
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)][inside] = least[inside]
    places = np.flatnonzero(grams == _sliding(padded, width, np.maximum))
    values, named = np.unique(grams[places], return_inverse=True)
    keys = np.sort(named * len(grams) + places)
    base = np.searchsorted(values, least[first]) * len(grams)
    at = np.searchsorted(keys, base + first)
    found = np.searchsorted(keys, base + first + count + width - 1) - at
    owner = np.searchsorted(starts, first, "right") - 1
    return owner, least[first].view(np.int64), first - starts[owner], count, found, keys[at] - base - starts[owner]


def _digest(data: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_digest(data)
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _columns(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=names)


_LONG, _INT = pa.int64(), pa.int32()
PIECE = {"_key": _LONG, "_check": _LONG, "anchor": _LONG, "d1": _LONG, "d2": _LONG, "start": _INT, "windows": _INT, "places": _INT, "left": _LONG, "right": _LONG}
PART = {"shard": _LONG, "s1": _LONG, "s2": _LONG, "anchor": _LONG, "d1": _LONG, "d2": _LONG, "offset": _INT, "copies": _LONG, "body": pa.binary()}
RUN = {"anchor": _LONG, "d1": _LONG, "d2": _LONG, "from": _INT, "upto": _INT}
_SQL = {_LONG: "bigint", _INT: "int", pa.binary(): "binary"}


def _schema(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{n}` {_SQL[k]}" for n, k in fields.items())


def _filled(rows: Iterator[tuple], fields: dict[str, pa.DataType], size: int = 50_000, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded number and, where the last column is bytes, bounded size."""
    some, heavy = [], 0
    for row in rows:
        some.append(row)
        heavy += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(some) == size or heavy > weight:
            yield _columns(list(fields), list(fields.values()), some)
            some, heavy = [], 0
    if some:
        yield _columns(list(fields), list(fields.values()), some)


def _keys(text: str, doc_id: str) -> list[Column]:
    """Two independent hashes of a row; rows with the same id and text share them, and so their repeats."""
    told = [F.col(doc_id).isNull(), F.col(doc_id), F.col(text)]
    return [F.xxhash64(*told).alias("_key"), F.xxhash64(F.lit("second"), *told[::-1]).alias("_check")]


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(*_keys(text, doc_id), F.col(text).cast("binary").alias("_bytes"))


def _describe(span: int):
    """Rows of ``PIECE`` for every piece of every text; a long text is described part by part.

    ``left`` and ``right`` name the anchor (its first place) with the half of a window's other bytes before or behind it; null where the
    piece does not reach that far.
    """
    half = (span - GRAM + 1) // 2

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, memoryview]]:
        for i, body in enumerate(batch.column(2)):
            data = memoryview(body.as_py() or b"")
            for at in range(0, len(data) - span + 1, _CHUNK):
                yield i, at, data[at : at + _CHUNK + span - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[tuple[int, int, memoryview]] = []
            size = 0
            for part in parts(batch):
                some.append(part)
                size += len(part[2])
                if size > _CHUNK:
                    yield described(batch, some)
                    some, size = [], 0
            if some:
                yield described(batch, some)

    def described(batch: pa.RecordBatch, some: list[tuple[int, int, memoryview]]) -> pa.RecordBatch:
        owner, anchor, first, count, found, place = pieces([t for _, _, t in some], span)
        texts = [t for _, _, t in some]
        ends = (first + count + span - 1).tolist()
        digests, left, right = [], [], []
        for o, a, z, p in zip(owner.tolist(), first.tolist(), ends, place.tolist()):
            body = texts[o]
            digests.append(xxhash.xxh3_128_digest(body[a:z]))
            left.append(xxhash.xxh3_64_intdigest(body[p - half : p + GRAM]) - (1 << 63) if p - a >= half else None)
            right.append(xxhash.xxh3_64_intdigest(body[p : p + GRAM + half], 1) - (1 << 63) if z - p - GRAM >= half else None)
        digest = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        row = pa.array(np.array([i for i, _, _ in some])[owner])
        start = first + np.array([at for _, at, _ in some])[owner]
        columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(anchor)]
        columns += [pa.array(np.ascontiguousarray(digest[:, i])) for i in (0, 1)]
        columns += [pa.array(c.astype(np.int32)) for c in (start, count, found)]
        columns += [pa.array(side, _LONG) for side in (left, right)]
        return pa.RecordBatch.from_arrays(columns, names=list(PIECE))

    return run


def _read(span: int):
    """The listed pieces of each text; those of a split anchor once more in pieces, by the second hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before = None
        for batch in batches:
            for key, body, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if (key, body) == before:  # repeated rows lie side by side after the join
                    continue
                before, data = (key, body), body.as_py()
                for p in listed.as_py():
                    part = data[p["start"] : p["start"] + p["windows"] + span - 1]
                    name = (p["anchor"], p["d1"], p["d2"])
                    if _digest(part) != name[1:]:
                        continue
                    if not p["split"]:
                        yield (p["anchor"], *name[1:], *name, 0, p["copies"], part)
                        continue
                    _, anchors, firsts, counts, *_ = pieces([part], span, 1)
                    for second, first, count in zip(anchors.tolist(), firsts.tolist(), counts.tolist()):
                        inner = part[first : first + count + span - 1]
                        shard = xxhash.xxh3_64_intdigest(second.to_bytes(8, "little", signed=True), p["anchor"] & (1 << 64) - 1)
                        yield (shard - (1 << 63), *_digest(inner), *name, first, p["copies"], inner)

    return lambda batches: _filled(rows(batches), PART, weight=4 << 20)


class _Shard:
    """Different texts, and for each the pieces (class, offset) that it stands for."""

    def __init__(self, span: int, limit: int):
        self.span, self.limit = span, limit
        self.texts: list[bytes] = []
        self.known: list[list[tuple]] = []
        self.twice: list[bool] = []
        self.size = 0

    def add(self, body: bytes) -> None:
        self.texts.append(body)
        self.known.append([])
        self.twice.append(False)
        self.size += len(body)

    def runs(self) -> Iterator[tuple]:
        """(class, first window, window behind the last) of all repeated windows.

        More than two shards' bytes on one pair of anchors are compared block by block, so that memory stays bounded.
        """
        found = [np.zeros(len(t) - self.span + 1, bool) for t in self.texts]  # one byte a window
        blocks, size = [[]], 0
        for i, text in enumerate(self.texts):
            if size > self.limit and self.size > 2 * self.limit:
                blocks.append([])
                size = 0
            blocks[-1].append(i)
            size += len(text)
        for a in range(len(blocks)):
            for b in range(a, len(blocks)) if len(blocks) == 1 else range(a + 1, len(blocks)):
                some = blocks[a] + (blocks[b] if b > a else [])
                flags = repeated([self.texts[i] for i in some], self.span)
                at = 0
                for i in some:
                    found[i] |= flags[at : at + len(found[i])]
                    at += len(self.texts[i]) + 1
        for flags, known, twice in zip(found, self.known, self.twice):
            if twice:
                flags[:] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()
            for *name, offset in known:
                for a, b in zip(edge[::2], edge[1::2]):
                    yield (*name, offset + a, offset + b)


def _compare(span: int, limit: int):
    """Repeated windows of classes, from rows sorted by shard key and digest; whole shard keys are gathered into one array."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, group, last, piece = _Shard(span, limit), None, None, None
        for batch in batches:
            heads = zip(*(batch.column(i).to_pylist() for i in range(8)))
            for i, (key, s1, s2, *name, copies) in enumerate(heads):
                if key != group and shard.size >= limit:
                    yield from shard.runs()
                    shard, last = _Shard(span, limit), None
                group = key
                if (key, s1, s2) != last:
                    shard.add(batch.column(8)[i].as_py())
                    last, piece = (key, s1, s2), None
                if piece == name:  # read twice
                    continue
                shard.twice[-1] |= copies > 1 or piece is not None
                piece = name
                shard.known[-1].append(tuple(name))
        if shard.texts:
            yield from shard.runs()

    return lambda batches: _filled(rows(batches), RUN)


def known_classes(found: DataFrame, span: int = 400, shard: int = SHARD) -> DataFrame:
    """Classes of pieces whose anchor occurs again; ``met`` tells which may share a window with another class or, moved, with themselves."""
    one = F.first(F.struct("_key", "start", "windows", "left", "right")).alias("one")
    classes = found.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("copies"), F.max("places").alias("places"), one)
    classes = written(classes.select("anchor", "d1", "d2", "copies", "places", "one.*"), "suffix-classes")
    told = [F.sum(F.col("windows") + span - 1).alias("size"), F.count("*").alias("classes"), F.max("places").alias("most")]
    anchors = classes.groupBy("anchor").agg(F.sum(F.col("copies") * F.col("places")).alias("n"), *told).where("n > 1").drop("n")
    known = written(classes.join(written(anchors, "suffix-anchors"), "anchor"), "suffix-known")
    sides = known.where("classes > 1 AND most = 1").select(F.explode(F.array("left", "right")).alias("side")).where("side IS NOT NULL")
    sides = written(sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-sides")
    for side in ("left", "right"):
        known = known.join(sides.select(F.col("side").alias(side), F.lit(True).alias(f"_{side}")), side, "left")
    met = F.expr("(classes > 1 OR copies = 1) AND (most > 1 OR _left IS NOT NULL OR _right IS NOT NULL)")
    return known.withColumns({"met": met, "split": F.col("size") > shard})


def repeated_windows(docs: DataFrame, span: int = 400, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """Windows that occur twice: ``_key`` and ``_check`` of the row, ``from`` and ``upto`` (first window, window behind the last)."""
    source = _source(docs, text, doc_id)
    found = written(source.mapInArrow(_describe(span), _schema(PIECE)), "suffix-pieces")
    known = written(known_classes(found, span, shard), "suffix-met")
    whole = known.where("NOT met AND copies > 1").select("anchor", "d1", "d2", F.lit(0).alias("from"), F.col("windows").alias("upto"))
    shared = known.where("met").select("_key", F.struct("anchor", "d1", "d2", "start", "windows", "copies", "split").alias("_p"))
    wanted = written(shared.groupBy("_key").agg(F.collect_list("_p").alias("_pieces")), "suffix-wanted")
    read = source.join(wanted, "_key").select("_key", "_bytes", "_pieces").mapInArrow(_read(span), _schema(PART))
    order = ["shard", "s1", "s2", "anchor", "d1", "d2", "offset"]
    runs = read.repartition("shard").sortWithinPartitions(*order).mapInArrow(_compare(span, shard), _schema(RUN))
    runs = written(runs.unionByName(whole), "suffix-runs")
    begin = F.col("start")
    return found.join(runs, ["anchor", "d1", "d2"]).select("_key", "_check", (begin + F.col("from")).alias("from"), (begin + F.col("upto")).alias("upto"))


RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(
    docs: DataFrame,
    carry: list[str] | None = None,
    span: int = 400,
    text: str = "text",
    doc_id: str = "doc_id",
    bodies: bool = True,
    shard: int = SHARD,
) -> DataFrame:
    """Remove every byte covered by a string of ``span`` bytes that starts anywhere else as well, in any text or the same one.

    Returns ``carry`` (all columns by default), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed bytes),
    ``kept_sha256`` and, if asked for, ``spans`` (from, upto) and ``kept`` (the bytes that are left, which may begin or end inside a character).
    All copies go, the first one too.  Null texts have no bytes; texts shorter than ``span`` lose nothing; texts are
    hashed in parts of ``_CHUNK`` bytes and are otherwise read whole, whatever their length; repeated rows are texts of their own
    and so copies of each other, with any id or none; an empty table gives no rows; an input column named as a result is replaced.
    """
    results = RESULTS + (["spans", "kept"] if bodies else [])
    kept = [c for c in (carry or docs.columns) if c not in results]
    covered = repeated_windows(docs, span, text, doc_id, shard).groupBy("_key", "_check").agg(F.collect_set(F.struct("from", "upto")).alias("_runs"))
    covered = written(covered, "suffix-covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, listed in zip(batch.column(1), batch.column(2)):
                data = body.as_py() or b""
                cut: list[list[int]] = []
                for a, b in sorted((r["from"], r["upto"] + span - 1) for r in listed.as_py() or ()):
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], b)
                    else:
                        cut.append([a, b])
                edges = [0, *(x for c in cut for x in c), len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                spans = [{"from": a, "upto": b} for a, b in cut]
                told = (len(data), len(data) - len(rest), len(cut), hashlib.sha256(rest).hexdigest())
                rows.append((*told, spans, rest) if bodies else told)
            kinds = [_LONG, _LONG, _LONG, pa.string(), *([pa.list_(pa.struct({"from": _LONG, "upto": _LONG})), pa.binary()] if bodies else [])]
            made = _columns(results, kinds, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[CARRIED, *results])

    source = docs.select(carried(kept), *_keys(text, doc_id), F.col(text).cast("binary").alias("_bytes")).join(covered, ["_key", "_check"], "left")
    shape = {n: F.lit(None).cast("bigint") for n in RESULTS[:3]} | {"kept_sha256": F.lit(None).cast("string")}
    if bodies:
        shape |= {"spans": F.lit(None).cast("array<struct<from:bigint,upto:bigint>>"), "kept": F.lit(None).cast("binary")}
    schema = source.select(CARRIED).withColumns(shape).schema
    return source.select(CARRIED, "_bytes", "_runs").mapInArrow(run, schema).select(f"{CARRIED}.*", *results)
