import hashlib
import random

from sievework.llm import suffix_array as sa
from sievework.llm.queries import op12_suffix_array_dedup
from sievework.llm.suffix_dedup import PIECE, _describe, _schema, _source, known_classes, remove_repeats

SF = "/root/testdata/sf0.001"


def brute(docs, span):
    texts = [(d, (t or "").encode()) for d, t in docs]
    count = {}
    for _, b in texts:
        for i in range(len(b) - span + 1):
            count[b[i : i + span]] = count.get(b[i : i + span], 0) + 1
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_arrays_and_prefixes_against_sorting(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        monkeypatch.setattr(sa, "_LEAST", rng.choice([1, 3, 10, 1000]))
        monkeypatch.setattr(sa, "_BATCHES", rng.choice([1, 4, 64]))
        letters = rng.choice([b"ab", b"abc\0\xff", b"a", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        texts += rng.sample(texts, rng.randint(0, len(texts)))
        t, starts = sa.joined(texts)
        ends = {int(s) + len(x): i + 1 for i, (s, x) in enumerate(zip(starts, texts))}
        symbols = [ends[i] if i in ends else 1000 + int(c) for i, c in enumerate(t)]
        symbols[-1] = 0
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        order = sa.suffix_array(t, sa.BYTES + 256, sa.BYTES)
        assert order.tolist() == want
        before, common = sa.permuted_common_prefixes(t, order)
        for a, b in zip(want, want[1:]):
            n = 0
            while symbols[a + n] == symbols[b + n]:
                n += 1
            assert before[b] == a and common[b] == n


def test_supplied_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(brute(docs, 400))
    assert sorted(map(tuple, op12_suffix_array_dedup(spark, SF).collect())) == want and sum(r[2] for r in want)


def test_overlaps_periods_copies_and_split_anchors(spark, odd_docs):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdé") for _ in range(300)) for _ in range(4)] + ["a" * 300, "ab" * 200, "xyz " * 9000]
    docs = list(odd_docs)
    for _ in range(200):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p, a = rng.choice(common), rng.randint(0, 200)
            text += p[a : a + rng.randint(5, 200)] + "".join(rng.choice("uvw") for _ in range(rng.choice([0, 1, 30])))
        docs.append((rng.choice([None, *range(100)]), text))
    docs += docs[-5:] + [(400, common[-1]), (401, common[-1][7:] + "q")]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id bigint, text string, _key int, n_spans int, anchor int")
    want = sorted(brute(docs, 40), key=repr)
    for shard in (500, 1 << 20):  # with small shards nearly every anchor is split, and residues are compared block by block
        got = remove_repeats(df, ["doc_id", "_key", "anchor"], span=40, bodies=False, shard=shard).drop("_key", "anchor").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert remove_repeats(df.limit(0)).collect() == []


def test_spans_and_bytes(spark, make_docs):
    passage = "".join(chr(0x100 + i % 700) for i in range(300))
    rows = remove_repeats(make_docs([(1, "é" + passage + "tail"), (2, passage), (3, "short")])).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows] == [(606, 600, 1), (600, 600, 1), (5, 0, 0)]
    assert [bytes(r["kept"]) for r in rows] == ["étail".encode(), b"", b"short"]
    assert [tuple(s) for s in rows[0]["spans"]] == [(2, 602)]


def test_a_large_group_of_copies(spark, make_docs):
    text = " ".join(f"word{i}" for i in range(200))
    got = remove_repeats(make_docs([(i, text) for i in range(2000)] + [(None, text)] * 2000 + [(5000, "alone " * 100 + "x" * 300)]), bodies=False)
    assert got.where("n_removed = n_bytes").count() == 4000


def test_only_classes_that_may_share_a_window_go_into_arrays(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = word(16)
    near, copied = word(60), word(41)
    texts = [word(40) + shared + word(40) for _ in range(200)]  # one run of 16 bytes in common, which windows of 40 may be anchored at
    texts += [word(20) + near + word(20) for _ in range(3)] + [copied] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    known = known_classes(_source(docs, "text", "doc_id").mapInArrow(_describe(40), _schema(PIECE)), 40).collect()
    assert [r.met for r in known if r.copies == 5] and not any(r.met for r in known if r.copies == 5)
    assert [r.met for r in known if r.classes > 20] and not any(r.met for r in known if r.classes > 20)
    assert any(r.met for r in known)
    got = sorted(map(tuple, remove_repeats(docs, ["doc_id"], 40, bodies=False).collect()))
    assert got == sorted(brute(list(enumerate(texts)), 40))


def test_passages_of_more_than_fifty_words_go_from_400_bytes_on(spark, make_docs):
    rng = random.Random(11)
    words = lambda n, size: " ".join("".join(rng.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    short, long = f"0{words(57, 6)}", f"1{words(57, 6)}0"  # 399 and 400 bytes of 57 words
    docs = [(i, f"{words(60, 5)} {i}{p}{i} {words(60, 5)}") for i, p in enumerate([short, short, long, long], 2)]
    docs.append((9, words(300, 5)))
    got = sorted(map(tuple, remove_repeats(make_docs(docs), ["doc_id"], bodies=False).collect()))
    assert (len(short), len(long)) == (399, 400) and got == sorted(brute(docs, 400))
    assert [r[:4] for r in got] == [(d, len(t), 400 * (d in (4, 5)), d in (4, 5)) for d, t in docs]  # n_bytes is the size before the removal
