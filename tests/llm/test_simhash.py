import random
from collections import defaultdict

import pytest
import xxhash

from sievework.llm import simhash
from sievework.llm.queries import op10_simhash
from sievework.llm.simhash import components, keep_one, link_fingerprints, near_duplicates

SF = "/root/testdata/sf0.01"


def brute_mark(text):
    w = (text or "").encode().lower().split()
    grams = [w] if 0 < len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks, radius=2):
    """marks: (id, mark) pairs."""
    names = sorted(set(m for _, m in marks))
    root = {m: m for m in names}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, m in marks:
        if i is not None:
            least[find(m)].append(i)
    return {m: min(least[find(m)], default=None) for m in names}


def verify(rows, texts_by_row):
    marks = [(r["doc_id"], int(r["fingerprint"], 16)) for r in rows]
    assert sorted(marks, key=repr) == sorted(((i, brute_mark(t)) for i, t in texts_by_row), key=repr)
    want = brute_components(marks)
    assert all(r["component_id"] == want[int(r["fingerprint"], 16)] for r in rows)


def test_supplied_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = op10_simhash(spark, SF).collect()
    verify(rows, docs)
    assert len({r["component_id"] for r in rows}) < len(rows)


def test_odd_rows_and_names(make_docs, odd_docs):
    docs = make_docs(odd_docs).selectExpr("*", "1 as component_id", "2 as node", "3 as _id", "4 as _fp")
    rows = near_duplicates(docs).collect()
    verify(rows, odd_docs)
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shared", [2, 64])
def test_links_of_tight_clusters(spark, monkeypatch, shared):
    """Clusters around centres, chains of two-bit steps, and far ones; small groups are paired, large ones hubbed."""
    monkeypatch.setattr(simhash, "SHARED", shared)
    rng = random.Random(5)
    marks = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            m = centre
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                m ^= 1 << b
            marks.add(m)
    step = rng.getrandbits(64)
    for b in range(0, 60, 2):
        step ^= (1 << b) | (1 << b + 1)
        marks.add(step)
    marks |= {rng.getrandbits(64) for _ in range(50)}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "_fp bigint")
    roots = {r["node"]: r["root"] for r in components(link_fingerprints(df)).collect()}
    got = defaultdict(set)
    for m in signed:
        got[roots.get(m, m)].add(m)
    want = defaultdict(set)
    for m, least in brute_components([(m, m) for m in marks]).items():
        want[least].add(m - (1 << 64) if m >> 63 else m)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_smaller_radius(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,)], "_fp bigint")
    links = {tuple(r) for r in link_fingerprints(df, 1).collect()}
    assert links == {(0, 1), (1, 3), (0, 1 << 40)}
    assert link_fingerprints(df, 0).collect() == []


def test_keep_one(make_docs):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text), (3, text), (9, text.upper()), (None, text), (7, "something else entirely here"), (None, "alone"), (None, "alone")]
    kept = [(r["doc_id"], r["text"]) for r in keep_one(make_docs(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(3, text), (7, "something else entirely here"), (None, "alone")], key=repr)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    """Spark takes an exploded table for as small as the one it comes from; the driver must not be sent it."""
    plans = {}

    def kept(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, label)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", kept)
    marks = spark.range(300).selectExpr("id * 7 AS _fp")
    links = link_fingerprints(written(marks, "marks"))
    plans["links"] = links._jdf.queryExecution().executedPlan().toString()
    assert {"simhash-variants", "links"} <= set(plans)
    assert not [label for label, plan in plans.items() if "Broadcast" in plan]
    assert links.count()
