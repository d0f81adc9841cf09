import gzip
import hashlib
import base64
import json

from sievework.llm.dom import parse
from sievework.llm.queries import op7_warc_derivatives
from sievework.llm.warc import derive, header, read_warc, records_of, responses, serialised, write_warc

SF = "/root/testdata/sf0.001"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_supplied_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op7_warc_derivatives(spark, SF).collect()
    assert len(rows) == 2 * len(pages) and len({r["record_id"] for r in rows}) == len(rows)
    by = {(r["page_id"], r["warc_type"]): r for r in rows}
    for i, page in pages.items():
        told, text = by[i, "metadata"], by[i, "conversion"]
        assert told["refers_to"] == text["refers_to"] and told["target_uri"] == text["target_uri"] == page["url"]
        assert text["block"] == "\n".join(t for _, t in parse(page["html"]).blocks)
        for r in (told, text):
            assert r["block_digest"] == sha1(r["block"].encode()) and r["payload_digest"] == sha1(page["html"].encode())
        found = json.loads(told["block"])
        assert found["conversion"] == text["record_id"]
        assert ["WARC-Record-ID", told["refers_to"]] in found["source"] and ["WARC-Target-URI", page["url"]] in found["source"]
        assert found["http"]["status"] == "HTTP/1.1 200 OK" and found["payload"]["length"] == len(page["html"].encode())
        assert found["html"]["links"][0].startswith("/")


def test_odd_pages_and_names(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, None, "<p>x &amp; y \U0001f600"), (3, None, "<p>x &amp; y \U0001f600")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as headers", "1 as _carried_")
    got = derive(responses(pages)).collect()
    assert len(got) == 8
    assert [r["block"] for r in got if r["page_id"] == 1 and dict(map(tuple, r["headers"]))["WARC-Type"] == "conversion"] == [b""]
    assert sum(r["block"].decode() == "x & y \U0001f600" for r in got) == 2
    assert derive(responses(pages.limit(0))).collect() == []


def test_other_records(spark):
    def row(kind, http, body, more=()):
        block = http.encode() + b"\r\n\r\n" + body
        return ([("WARC-Type", kind), ("WARC-Record-ID", "<id>"), *more], block)

    rows = [
        row("request", "GET / HTTP/1.1", b""),
        row("response", "HTTP/1.1 200 OK\r\nContent-Type: image/png", b"\x89PNG\xff"),
        row("response", "HTTP/1.1 404 Gone\r\ncontent-type: text/plain; charset=latin-1\r\nX-A: one\r\n two", "caf\xe9".encode("latin-1"), [("WARC-Payload-Digest", "sha1:GIVEN")]),
        (None, None),
    ]
    records = spark.createDataFrame(rows, "headers array<struct<name: string, value: string>>, block binary")
    got = derive(records).select(header("WARC-Type").alias("t"), header("warc-source-payload-digest").alias("d"), "block").collect()
    assert [r["t"] for r in got] == ["metadata", "metadata", "conversion"]
    assert got[2]["block"].decode() == "café" and got[2]["d"] == "sha1:GIVEN"
    assert json.loads(got[1]["block"])["http"]["headers"][1] == ["X-A", "one two"]
    assert json.loads(got[0]["block"])["conversion"] is None


def test_files_round_trip(spark, tmp_path):
    source = [([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", str(len(b)))], b) for i, b in enumerate([b"HTTP/1.1 200 OK\r\n\r\n<p>\xff\r\n\r\nx", b"", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>y"])]
    (tmp_path / "a.warc").write_bytes(b"".join(serialised(h, b) for h, b in source))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(serialised(h, b)) for h, b in source))
    (tmp_path / "c.warc").write_bytes(serialised(*source[0])[:-20])
    read = read_warc(spark, str(tmp_path / "*.warc*")).collect()
    good = [r for r in read if r["error"] is None]
    assert len(read) == 7 and sorted(r["block"] for r in good) == sorted(2 * [b for _, b in source])
    derived = derive(read_warc(spark, str(tmp_path / "[ab].warc*")).where("error is null").select("headers", "block"))
    write_warc(derived, str(tmp_path / "out"))
    back = [r for f in (tmp_path / "out").glob("part-*") for r in records_of(f.read_bytes())]
    want = [([tuple(h) for h in r["headers"]], bytes(r["block"])) for r in derived.collect()]
    assert sorted(back) == sorted(want) and len(back) == 12
