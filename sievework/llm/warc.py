"""WARC derivatives: metadata and plain-text conversion records for every response.

A record is a row of ``headers`` (name and value pairs in order) and ``block`` (bytes).  Both derived records refer to
their response by its record id and carry its target and date; the metadata record keeps the source's own WARC headers, its
HTTP status and headers and its digests, and names the conversion record.  Ids of derived records follow from the source id,
so a repeated run gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried
from sievework.llm.dom import parse

Headers = list[tuple[str, str]]
RECORD = "headers array<struct<name: string, value: string>>, block binary"
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_VERSION = b"WARC/1.1"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def first(headers: Sequence[tuple[str, str]], name: str) -> str | None:
    """Value of the first header of that name; names do not tell capitals apart."""
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload; a block without a header end is all headers."""
    end = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if end < 0 else (block[:end], block[end + 4 :])
    lines = head.decode("iso-8859-1").split("\r\n")
    headers: Headers = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, payload


def _text(payload: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derived_id(source_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source_id} {kind}')}>"


def _record(kind: str, source: Headers, content_type: str, block: bytes, more: Headers) -> tuple[Headers, bytes]:
    source_id = first(source, "WARC-Record-ID") or ""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", derived_id(source_id, kind)), ("WARC-Refers-To", source_id)]
    headers += [(n, v) for n in ("WARC-Target-URI", "WARC-Date") if (v := first(source, n)) is not None]
    headers += [*more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return headers, block


def derive_one(source: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """Metadata record and, for text, conversion record of one response; nothing for other records."""
    if (first(source, "WARC-Type") or "").lower() != "response":
        return []
    status, http, payload = split_http(block)
    content_type = first(http, "Content-Type") or ""
    kind = content_type.split(";")[0].strip().lower()
    found: dict[str, object] = {}
    text = None
    if kind in ("", "text/html", "application/xhtml+xml"):
        page = parse(_text(payload, content_type), links=True)
        text = "\n".join(t for _, t in page.blocks)
        found = {"title": page.title, "links": page.links}
    elif kind.startswith("text/"):
        text = _text(payload, content_type)
    refers: Headers = [("WARC-Source-Payload-Digest", first(source, "WARC-Payload-Digest") or digest(payload))]
    out = []
    if text is not None:
        out.append(_record("conversion", source, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), refers))
    told = {
        "source": [list(h) for h in source],
        "http": {"status": status, "headers": [list(h) for h in http]},
        "payload": {"digest": digest(payload), "length": len(payload)},
        "html": found or None,
        "conversion": first(out[0][0], "WARC-Record-ID") if out else None,
    }
    block = json.dumps(told, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    return [_record("metadata", source, "application/json", block, refers), *out]


def derive(records: DataFrame) -> DataFrame:
    """Derived records, with all other columns of their source.

    Records that are no responses, or lack headers, give none; a null block is empty; repeated records are derived each; an
    empty table gives no rows.
    """
    kept = [c for c in records.columns if c not in ("headers", "block")]
    source = records.select(carried(kept) if kept else F.lit(0).alias(CARRIED), "headers", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, made, size = [], [], 0
            for i, (headers, block) in enumerate(zip(batch.column(1), batch.column(2))):
                pairs = [(h["name"] or "", h["value"] or "") for h in headers.as_py() or () if h]
                new = derive_one(pairs, block.as_py() or b"")
                owner += [i] * len(new)
                made += new
                size += sum(len(b) for _, b in new)
                if size > 8_000_000:
                    yield _batch(batch, owner, made)
                    owner, made, size = [], [], 0
            if made:
                yield _batch(batch, owner, made)

    out = source.mapInArrow(run, source.schema)
    return out.select(*([f"{CARRIED}.*"] if kept else []), "headers", "block")


def _batch(batch: pa.RecordBatch, owner: list[int], made: list[tuple[Headers, bytes]]) -> pa.RecordBatch:
    headers = pa.array([[{"name": n, "value": v} for n, v in h] for h, _ in made], _PAIRS)
    columns = [batch.column(0).take(pa.array(owner, pa.int64())), headers, pa.array([b for _, b in made], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[CARRIED, "headers", "block"])


def header(name: str):
    """Column: value of the first header of that name in ``headers``."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def responses(pages: DataFrame, url: str = "url", source: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages, all its columns kept: a plain HTTP answer with the page as its payload.

    The record id follows from address and page.  A null address gives no target; a null page has an empty payload.
    """
    body = F.encode(F.coalesce(F.col(source), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "UTF-8"), body)
    mark = F.md5(F.concat_ws("\n", F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(source), F.lit(""))))
    name = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(mark, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    def pair(key: str, value) -> F.Column:
        return F.struct(F.lit(key).alias("name"), value.cast("string").alias("value"))

    given = F.array(
        pair("WARC-Type", F.lit("response")),
        pair("WARC-Record-ID", name),
        pair("WARC-Target-URI", F.col(url)),
        pair("WARC-Date", F.lit(date)),
        pair("Content-Type", F.lit("application/http; msgtype=response")),
        pair("Content-Length", F.octet_length(block)),
    )
    kept = [c for c in pages.columns if c not in ("headers", "block")]
    return pages.select(*kept, F.filter(given, lambda h: h["value"].isNotNull()).alias("headers"), block.alias("block"))


def serialised(headers: Sequence[tuple[str, str]], block: bytes) -> bytes:
    lines = [_VERSION, *[f"{n}: {v}".encode() for n, v in headers]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Records of a WARC file, plain or gzip (also one member per record); a cut last record is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = [(n.strip(), v.strip()) for n, v in (x.split(":", 1) for x in lines if ":" in x)]
        length = int(first(headers, "Content-Length") or 0)
        if end + 4 + length > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path, one task per file: ``headers``, ``block``, ``file`` and ``error``.

    A file that cannot be read to its end gives the records before the fault and one row that has only ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(some: list[tuple]) -> pa.RecordBatch:
            heads = [None if h is None else [{"name": n, "value": v} for n, v in h] for h, _, _, _ in some]
            columns = [pa.array(heads, _PAIRS), *[pa.array([r[k] for r in some], t) for k, t in ((1, pa.binary()), (2, pa.string()), (3, pa.string()))]]
            return pa.RecordBatch.from_arrays(columns, names=["headers", "block", "file", "error"])

        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                some, size = [], 0
                try:
                    for headers, block in records_of(data.as_py() or b""):
                        some.append((headers, block, file, None))
                        size += len(block)
                        if size > 8_000_000:
                            yield rows(some)
                            some, size = [], 0
                except (ValueError, OSError, EOFError, zlib.error) as fault:
                    some.append((None, None, file, str(fault)))
                if some:
                    yield rows(some)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, f"{RECORD}, file string, error string")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records with text blocks (as derived ones are) as gzip files; a record's end is the line end of the writer."""
    lines = F.concat_ws(
        "\r\n", F.lit(_VERSION.decode()), F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), F.lit("")
    )
    whole = F.concat(lines, F.lit("\r\n"), F.decode(F.coalesce(F.col("block"), F.lit(b"")), "UTF-8"))
    records.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
