import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sievework.llm.packing import Encoder, Search, _narrowed, best_fit, encoder, pack_documents, pack_lengths, sequences, tokenise, widened
from sievework.llm.queries import op2_best_fit_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def brute_pieces(plain, doc_id, text, capacity):
    ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
    n = len(ids)
    cuts = [0, n] if n <= capacity else [0, *([n % capacity] if n % capacity else []), *range(n % capacity + capacity, n + 1, capacity)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def placed_well(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_supplied_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    df = op2_best_fit_packing(spark, SF)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = df.collect()
    want = [p for d, t in docs for p in brute_pieces(plain, d, t, 2048)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    used = placed_well(rows, 2048)
    least = -(-sum(p[3] for p in want) // 2048)
    assert used <= least * 1.01 + 1


def test_odd_rows_and_ids(spark, plain, make_docs, odd_docs):
    docs = make_docs(odd_docs).selectExpr("*", "1 as piece", "2 as length", "3 as sequence_id")
    packed = pack_documents(docs, PATH, capacity=64, ids=True)
    rows = packed.collect()
    want = [p for d, t in odd_docs for p in brute_pieces(plain, d, t, 64)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    placed_well(rows, 64)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in rows:
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(map(len, whole.values())) == sum(p[3] for p in want)
    assert pack_documents(docs.limit(0), PATH).collect() == []


def test_ids_travel_as_two_bytes_where_they_fit(spark):
    parts = [np.array(p, "<u4").tobytes() for p in ([1, 65535], [0], [65536, 7], [5] * 2048)]
    narrow = [_narrowed(p) for p in parts]
    assert [len(n) for n in narrow] == [4, 2, 8, 4096]
    rows = [(i, len(p) // 4, n) for i, (p, n) in enumerate(zip(parts, narrow))]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, length BIGINT, ids BINARY")
    got = {r.doc_id: r.ids for r in widened(frame, 3).collect()}
    assert got == {i: np.frombuffer(p, "<u4").tolist() for i, p in enumerate(parts)}
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id BIGINT, text STRING")
    packed = pack_documents(docs, PATH, ids=True)
    assert dict(packed.dtypes)["ids"] == "array<int>" and dict(tokenise(docs, PATH).dtypes)["ids"] == "array<int>"
    assert sorted(len(r.ids) - r.length for r in packed.collect()) == [0, 0]


ODD = [" ", "  ", "a", "B", "é", "中", "́", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "᠎", "​", "　", "﻿", "'s", "1", ".", "<|endoftext|>", "\U0001f600"]


@settings(max_examples=400, deadline=None)
@example("\n\n<|endoftext|>")
@example("\nWord, don't\n\nwords.\nno\0no")
@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join))
def test_remembered_chunks_give_the_same_ids(text):
    got = encoder(PATH).encode([text])[0]
    assert got == np.array(encoder(PATH).tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_of_a_call_reach_the_merges_once_and_together(plain):
    own, calls = Encoder(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.extend(texts)
            return merges.encode_batch_fast(texts, **options)

    merges, own.merges = own.merges, Counted()
    texts = [" ".join(f"W{chr(97 + i)}{chr(97 + j)}é{'.,' if j % 3 else ''}" for j in range(26)) for i in range(26)] * 3
    assert own.encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(calls) == 1 and calls[0].count("W") == 26 * 26


MIXED = [" ", "\n", "a", "Word", "é", "À", "×", "÷", "ÿ", "ª", "Ā", "µ", "'", "'s", ",", ".'s", "$", "_", "7", "\0", "中"]


@settings(max_examples=400, deadline=None)
@example(["a× b÷ ×c\né'. É,' \nword,\n", "", " "])
@given(st.lists(st.lists(st.sampled_from(MIXED), max_size=14).map("".join), max_size=4))
def test_letters_signs_and_marks_together(texts):
    got = encoder(PATH).encode(texts)
    assert got == [np.array(encoder(PATH).tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_memory_is_emptied(plain):
    small = Encoder(PATH, remembered=2)
    texts = ["one two three four", "five six " + "x" * 500, "one two"]
    for t in texts * 2:
        assert small.encode([t])[0] == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_bins(lengths):
    bins = pack_lengths(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(best_fit(lengths, 100))


def test_search_beats_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 700, 800).tolist()
    assert len(pack_lengths(lengths, 2048)) < len(best_fit(lengths, 2048))


def test_search_goes_on_until_nothing_helps():
    """No move, one-for-one, two-for-one or one-for-two between underfull bins is left, whatever the number of pieces in a bin."""
    rng = np.random.default_rng(4)
    for low, high, n in ((20, 60, 60), (3, 40, 40), (30, 70, 60)):
        lengths = rng.integers(low, high, n).tolist()
        search = Search(lengths, [[i] for i in range(n)], 100)
        bins = search.run()
        assert sorted(i for b in bins for i in b) == list(range(n))
        fill = [sum(lengths[i] for i in b) for b in bins]
        if len(bins) == -(-sum(lengths) // 100):
            continue
        some = [[(i,) for i in b] + [(i, j) for i in b for j in b if i < j] for b in bins]
        for g, giver in enumerate(bins):
            for t, taker in enumerate(bins):
                if g == t or fill[g] > fill[t] or fill[t] >= 100:
                    continue
                for out in some[g]:
                    for back in [(), *some[t]]:
                        if len(out) + len(back) == 1 or (len(out), len(back)) in ((1, 1), (2, 1), (1, 2)):
                            gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                            assert gain <= 0 or fill[t] + gain > 100
