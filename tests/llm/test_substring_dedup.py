import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from sievework.llm.queries import op5_substring_dedup
from sievework.llm.substring_dedup import PATH, _emit_paths, _emit_windows, paths, remove_repeats

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, span=13):
    """docs: (id, text) rows; results in the same order."""
    least = {}
    for d, text in docs:
        if d is not None:
            w = tokens(text)
            for i in range(len(w) - span + 1):
                g = tuple(w[i : i + span])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, text in docs:
        w = tokens(text)
        gone = set()
        if d is not None:
            for i in range(len(w) - span + 1):
                if least[tuple(w[i : i + span])] < d:
                    gone.update(range(i, i + span))
        left = " ".join(t for i, t in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return out


def test_supplied_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = op5_substring_dedup(spark, SF)
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = sorted(r[:4] for r in brute(docs))
    assert sorted(map(tuple, df.collect())) == want and sum(r[2] for r in want)


def test_branches_edges_and_small_words(spark, make_docs):
    """Texts of few words, cut from common passages with edits: paths branch nearly everywhere."""
    rng = random.Random(4)
    common = [[rng.choice("abcd") + rng.choice("xy") for _ in range(120)] for _ in range(3)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = list(rng.choice(common))
            a = rng.randint(0, 100)
            p = p[a : a + rng.randint(5, 60)]
            if p and rng.random() < 0.5:
                p[rng.randrange(len(p))] = rng.choice("pqr")
            w += p + [rng.choice("uvw")] * rng.choice([0, 0, 1, 20])
        docs.append((rng.choice([None, *range(60)]), " ".join(w)))
    got = remove_repeats(make_docs(docs).selectExpr("*", "1 as _key", "2 as start"), ["doc_id", "_key"]).drop("_key").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs), key=repr)


def test_odd_rows(make_docs, odd_docs):
    long = next(t for _, t in odd_docs if t and len(t) > 100_000)
    docs = odd_docs + [(11, long), (12, "\x85".join(long.split()[:40])), (13, long[1000:] + " end")]
    got = remove_repeats(make_docs(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(docs), key=repr)
    assert remove_repeats(make_docs(docs).limit(0)).collect() == []


def test_keys_inside_one_anchor_keep_64_bits():
    """Many surroundings of one frequent run: 32 bits of a path or window would agree by chance, 64 do not."""
    tokens = [f"w{i}".encode() for i in range(200_000)]
    _, path, first, length = paths(tokens, 13)
    assert path.dtype == np.uint64 and len(np.unique(path >> np.uint64(32))) > 0.99 * len(path)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([b" ".join(tokens).decode()])], names=["_key", "_id", "_text"])
    sent = np.concatenate([b.column(PATH.index("path")).to_numpy() for b in _emit_paths(13)(iter([batch]))])
    assert np.array_equal(sent.view(np.uint64), path)
    listed = pa.array([[{"anchor": 5, "start": 0, "length": len(tokens) - 12}]])
    batch = pa.RecordBatch.from_arrays([*batch.columns, listed], names=["_key", "_id", "_text", "_paths"])
    window = np.concatenate([b.column(3).to_numpy() for b in _emit_windows(13)(iter([batch]))])
    assert len(np.unique(window)) == len(window) > len(np.unique(window & 0xFFFFFFFF))
