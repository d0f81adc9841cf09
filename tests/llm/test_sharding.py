import zlib
from collections import defaultdict

import pytest

from sievework.llm.queries import op4_histogram_shards
from sievework.llm.sharding import shard_by_bytes, write_shards

SF = "/root/testdata/sf0.001"


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def totals(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def test_supplied_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = op4_histogram_shards(spark, SF)
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    gapless(rows)
    largest, by = max(r["size"] for r in rows), totals(rows)
    mean = sum(by.values()) / 16
    assert all(abs(v - mean) <= largest + 0.01 * mean for v in by.values())


@pytest.mark.parametrize("hot", [0, 4000])
def test_near_equal_with_a_hot_text(spark, make_docs, hot):
    rows = [(i, f"text {i} " + "x" * (i % 50)) for i in range(6000)] + [(10_000 + i, "the same text again") for i in range(hot)]
    got = shard_by_bytes(make_docs(rows), 16, carry=["doc_id"]).collect()
    gapless(got)
    by = totals(got)
    mean = sum(by.values()) / 16
    assert len(by) == 16 and all(abs(v - mean) <= 0.01 * mean for v in by.values())


def test_equal_texts_stay_together(make_docs):
    rows = [(i, f"text {i // 3}" + "y" * 40) for i in range(9000)]
    where = defaultdict(set)
    for r in shard_by_bytes(make_docs(rows), 16).select("text", "shard").collect():
        where[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_identical_rows_are_cut(make_docs):
    by = totals(shard_by_bytes(make_docs([(1, "all the same")] * 1600), 16).collect())
    assert sorted(by.values()) == [1300] * 16


def test_odd_rows_and_names(make_docs, odd_docs, tmp_path):
    docs = make_docs(odd_docs)
    clash = docs.selectExpr("*", "'x' as shard", "n_chars as size", "1 as _cell", "2 as _n")
    got = shard_by_bytes(clash, 3)
    rows = got.collect()
    assert len(rows) == len(odd_docs) and {r["shard"] for r in rows} <= {0, 1, 2}
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in odd_docs)
    gapless(rows)
    write_shards(got, str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_docs)
    assert shard_by_bytes(docs.where("doc_id > 999"), 16).collect() == []
