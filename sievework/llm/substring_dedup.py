"""Removal of repeated passages on a compacted de Bruijn graph of words.

A window of ``span`` words is an edge of the graph, from its first to its last ``span - 1`` words.  Edges that follow each
other in a text and share their anchor (the five-word gram with the smallest hash inside the window) form one path, and
equal texts have equal paths, so paths and not windows are exchanged:

1. Anchors that occur under more than one document id are found by an aggregate; only paths on such anchors go on.
2. Equal paths are compacted by a join: each keeps the smallest document id it occurs in, and where it starts there.  In
   every other document all its windows are repeats.
3. Paths that share an anchor and are not equal branch: there one text goes on differently.  Such paths are
   taken apart in the first document that has them, and their windows are compared one by one in the same way.
4. Neighbouring repeats with the same source coordinates become long spans.  The words at the source are read again and
   digested, and a span counts only where the document's own words have the same digest.

Keys are 128 bits (anchor and path, or anchor and window).  On one anchor the other 64 bits tell paths and windows apart:
with ten million of them a chance of 3e-6 in all that any two agree by accident.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried, released, stored, written
from sievework.workspace import remove

ANCHOR = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPAN_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 18


def _rolled(hashes: np.ndarray, width: int, factor: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` entries, bits mixed at the end."""
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        out = out * factor + hashes[k : len(hashes) - width + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def paths(tokens: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, path hashes, first windows and numbers of windows of the paths of a text."""
    hashes = _hashes(tokens)
    grams = _rolled(hashes, ANCHOR, _MIX)
    n = len(tokens) - span + 1
    width = span - ANCHOR + 1
    anchor = np.empty(n, np.int64)
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        view = np.lib.stride_tricks.sliding_window_view(grams[at : end + width - 1], width)
        anchor[at:end] = view.argmin(axis=1) + np.arange(at, end)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    length = np.diff(np.append(first, n))
    # A path is the sequence of its windows; a sum of differently multiplied hashes stands for it.
    place = (np.arange(n) - np.repeat(first, length)).astype(np.uint64)
    whole = np.add.reduceat(_rolled(hashes, span, _SPAN_MIX) * (_MIX + np.uint64(2) * place * np.uint64(0xA24BAED4963EE407)), first)
    whole ^= whole >> np.uint64(31)
    return grams[anchor[first]], whole, first, length


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def _hashed_slices(tokens: list[bytes], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words inside the slices; the others stay zero."""
    inside = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    places = np.flatnonzero(np.cumsum(inside)[:-1])
    hashes = np.zeros(len(tokens), np.uint64)
    hashes[places] = _hashes([tokens[p] for p in places.tolist()])
    return hashes


def _members(structs: pa.StructArray, names: list[str]) -> list[np.ndarray]:
    """Whole numbers in the named fields."""
    found = dict(zip((f.name for f in structs.type), structs.flatten()))
    return [found[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _counted(lengths: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each length n, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


PATH = ["_key", "_id", "anchor", "path", "start", "length"]


def _emit_paths(span: int):
    """Rows of ``PATH`` for every path of every text with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for i, text in enumerate(batch.column(2)):
                tokens = _words(text.as_py())
                if len(tokens) < span or not batch.column(1)[i].is_valid:
                    continue
                anchor, path, first, length = paths(tokens, span)
                parts.append((np.full(len(first), i), anchor, path, first, length))
                size += len(first)
                if size > 500_000:
                    yield _path_batch(batch, parts)
                    parts, size = [], 0
            if parts:
                yield _path_batch(batch, parts)

    return run


def _path_batch(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    row, anchor, path, first, length = (np.concatenate(x) for x in zip(*parts))
    taken = pa.array(row)
    columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(anchor.view(np.int64)), pa.array(path.view(np.int64))]
    columns += [pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=PATH)


def _emit_windows(span: int):
    """Rows (_key, _id, anchor, window, start) for the listed paths of a text, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            edges = batch.column(3).offsets.to_numpy()
            anchors, starts, lengths = _members(batch.column(3).values, ["anchor", "start", "length"])
            for i, text in enumerate(batch.column(2)):
                own = slice(edges[i], edges[i + 1])
                n = lengths[own]
                at = np.repeat(starts[own], n) + _counted(n)
                window = _rolled(_hashed_slices(_words(text.as_py()), starts[own], n + span - 1), span, _SPAN_MIX)[at]
                parts.append((np.full(len(at), i), np.repeat(anchors[own], n), window, at))
                size += len(at)
                if size > 500_000:
                    yield _window_batch(batch, parts)
                    parts, size = [], 0
            if parts:
                yield _window_batch(batch, parts)

    return run


def _window_batch(batch: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
    row, anchor, window, start = (np.concatenate(x) for x in zip(*parts))
    taken = pa.array(row)
    columns = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(anchor), pa.array(window.view(np.int64))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(start.astype(np.int32))], names=["_key", "_id", "anchor", "window", "start"])


def _source(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(_key(doc_id, text), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))


def _shared_paths(docs: DataFrame, span: int, text: str, doc_id: str) -> DataFrame:
    """Paths on anchors that occur under more than one id."""
    source = _source(docs, text, doc_id)
    kind = source.schema["_id"].dataType.simpleString()
    found = source.mapInArrow(_emit_paths(span), f"_key bigint, _id {kind}, anchor bigint, path bigint, start int, length int")
    table, place = stored(found, "repeat-anchors")
    shared = table.groupBy("anchor").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).where("_low < _high").select("anchor")
    # Written, so that both sides of the join are plain exchanges: only then can Spark split the partition of a hot anchor.
    hits = written(table.join(written(shared, "repeat-shared"), "anchor"), "repeat-paths")
    remove(docs.sparkSession, place)
    return hits


def _compacted(hits: DataFrame) -> DataFrame:
    """Paths with the first place they occur at, where that is in another document or the path has to be taken apart."""
    classes = hits.groupBy("anchor", "path").agg(F.min(F.struct("_id", "_key", "start")).alias("first"))
    classes = written(classes, "repeat-classes")
    branching = classes.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor", F.lit(True).alias("branching"))
    told = classes.join(branching, "anchor", "left")
    known = hits.join(told, ["anchor", "path"]).where((F.col("first._id") < F.col("_id")) | F.col("branching"))
    return written(known.select(*PATH, "first", (F.col("first._id") < F.col("_id")).alias("repeated")), "repeat-known")


def _taken_apart(docs: DataFrame, known: DataFrame, span: int, text: str, doc_id: str) -> DataFrame:
    """Repeats inside branching paths, found window by window in the first documents that have the paths."""
    wanted = known.where("not repeated").groupBy("_key").agg(F.collect_set(F.struct("anchor", "start", "length")).alias("_paths"))
    source = _source(docs, text, doc_id)
    kind = source.schema["_id"].dataType.simpleString()
    single = source.join(wanted, "_key").select("_key", "_id", "_text", "_paths").mapInArrow(
        _emit_windows(span), f"_key bigint, _id {kind}, anchor bigint, window bigint, start int"
    )
    single = written(single, "repeat-windows")
    released(docs.sparkSession)
    earliest = single.groupBy("anchor", "window").agg(F.min(F.struct("_id", "_key", "start")).alias("first"), F.max("_id").alias("_high"))
    inside = single.join(earliest.where("first._id < _high"), ["anchor", "window"]).where(F.col("first._id") < F.col("_id"))
    return inside.select("_key", "start", F.lit(1).alias("length"), F.col("first._key").alias("source_key"), F.col("first.start").alias("source_start"))


def repeated_spans(docs: DataFrame, span: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Repeats before verification: ``_key``, ``start`` and ``length`` (windows), ``source_key``, ``source_start``."""
    hits = _shared_paths(docs, span, text, doc_id)
    released(docs.sparkSession)
    known = _compacted(hits)
    released(docs.sparkSession)
    equal = known.where("repeated").select(
        "_key", "start", "length", F.col("first._key").alias("source_key"), F.col("first.start").alias("source_start")
    )
    out = written(equal.unionByName(_taken_apart(docs, known, span, text, doc_id)), "repeat-parts")
    released(docs.sparkSession)
    return out


def _key(doc_id: str, text: str):
    """Rows with the same id and text share it, and so share their repeats."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text)).alias("_key")


def _rows(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


SPAN = ["_key", "start", "length", "source_key", "source_start"]


def joined_spans(parts: DataFrame) -> DataFrame:
    """Neighbouring repeats of one document with consecutive source coordinates as one span.

    Repeated rows find the same repeats, which count once (copies go before the exchange), so a document's list is no longer than its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            edges = lists.offsets.to_numpy().astype(np.int64)
            start, length, source, source_start = (x[edges[0] : edges[-1]] for x in _members(lists.values, SPAN[1:]))
            if not len(start):
                continue
            row = np.repeat(np.arange(len(lists)), np.diff(edges))
            order = np.lexsort((source_start, source, length, start, row))
            row, start, length, source, source_start = (x[order] for x in (row, start, length, source, source_start))
            shift, end = start - source_start, start + length
            other = np.concatenate(([True], (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])))
            # The furthest end so far; the number of the run in the upper half keeps runs apart.
            run_of = np.cumsum(other) << 32
            reached = np.maximum.accumulate(run_of + end)
            fresh = other.copy()
            fresh[1:] |= run_of[1:] + start[1:] > reached[:-1]
            first = np.flatnonzero(fresh)
            long = np.maximum.reduceat(end, first) - start[first]
            made = [pa.array(start[first], pa.int32()), pa.array(long, pa.int32()), pa.array(source[first], pa.int64()), pa.array(source_start[first], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), *made], names=SPAN)

    listed = parts.groupBy("_key").agg(F.collect_set(F.struct("start", "length", "source_key", "source_start")).alias("_l"))
    return listed.mapInArrow(run, "_key bigint, start int, length int, source_key bigint, source_start int")


def _digest(tokens: list[bytes], start: int, windows: int, span: int) -> bytes:
    return hashlib.blake2b(b" ".join(tokens[start : start + windows + span - 1]), digest_size=16).digest()


def verified_spans(docs: DataFrame, spans: DataFrame, span: int, text: str, doc_id: str) -> DataFrame:
    """Spans with the digest of the words at their source coordinates, read from the source document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                tokens = _words(body.as_py())
                rows = [(key, p["source_start"], p["length"], _digest(tokens, p["source_start"], p["length"], span)) for p in places.as_py()]
                yield _rows(["source_key", "source_start", "length", "digest"], rows, [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    wanted = spans.groupBy("source_key").agg(F.collect_set(F.struct("source_start", "length")).alias("_places"))
    read = docs.select(_key(doc_id, text), F.col(text).alias("_text")).join(wanted, F.col("_key") == F.col("source_key"))
    digests = read.select("_key", "_text", "_places").mapInArrow(run, "source_key bigint, source_start int, length int, digest binary")
    return spans.join(digests.distinct(), ["source_key", "source_start", "length"])


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, span: int = 13, text: str = "text", doc_id: str = "doc_id", texts: bool = True) -> DataFrame:
    """Remove every word in a window of ``span`` words that also starts in a document with a smaller id.

    Returns ``carry`` (all columns by default), ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for,
    ``kept_text``: the kept words joined by single spaces.  Windows are judged on the input.  Null and blank texts have no
    words; documents with a null id stand outside the order, so they lose nothing and take nothing from others; rows with
    equal ids do not repeat each other; an empty table gives no rows; an input column named as a result is replaced.
    """
    results = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if texts else [])]
    kept = [c for c in (carry or docs.columns) if c not in results]
    spans = written(joined_spans(repeated_spans(docs, span, text, doc_id)), "repeat-spans")
    checked = written(
        verified_spans(docs, spans, span, text, doc_id).groupBy("_key").agg(F.collect_set(F.struct("start", "length", "digest")).alias("_spans")),
        "repeat-verified",
    )
    released(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, found in zip(batch.column(1), batch.column(2)):
                tokens = _words(body.as_py())
                gone = np.zeros(len(tokens) + 1, np.int64)
                for s in found.as_py() or ():
                    if _digest(tokens, s["start"], s["length"], span) == s["digest"]:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["length"] + span - 1] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                left = b" ".join([t for t, s in zip(tokens, stay) if s])
                rows.append((len(tokens), len(tokens) - int(stay.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if texts else None))
            made = _rows(["n_words", "n_removed", "kept_sha256", "kept_text"], rows, [pa.int64(), pa.int64(), pa.string(), pa.string()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns], names=[CARRIED, *made.schema.names])

    source = docs.select(carried(kept), F.col(text).alias("_text"), _key(doc_id, text)).join(checked, "_key", "left")
    shape = source.select(CARRIED, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
    schema = shape.withColumns({"kept_sha256": F.lit(None).cast("string"), "kept_text": F.lit(None).cast("string")}).schema
    return source.select(CARRIED, "_text", "_spans").mapInArrow(run, schema).select(f"{CARRIED}.*", *results)
