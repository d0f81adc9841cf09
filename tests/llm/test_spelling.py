import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sievework.llm.queries import op13_spelling_variants
from sievework.llm.spelling import EQUAL, UNEQUAL, part, variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, damage=True):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 5
    words = {w: n for w, n in count.items() if n >= 3}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            v = w[:i] + w[i + 1 :]
            holes[i, v].add(w)
            if v in words:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n, len(near[w]), words.get(form.get(w))


def test_supplied_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_spelling_variants(spark, SF).collect()), key=repr) == sorted(brute(docs), key=repr)


def test_edits_chains_and_odd_rows(spark, make_docs, odd_docs):
    """Few letters, so that words are near each other in many ways; frequencies that make chains of forms."""
    rng = random.Random(3)
    docs = list(odd_docs)
    for length, times in ((5, 3), (6, 6), (7, 12), (8, 24), (9, 48)):
        docs += [(length, " ".join(["abcdefghi"[:length]] * times))]
    for i in range(300):
        words = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 7))) for _ in range(20)]
        docs.append((rng.choice([None, *range(50)]), rng.choice([" ", "-", "×1"]).join(words).upper() if i % 3 else " ".join(words)))
    docs.append((99, "z" * 5000 + " " + "z" * 5001 + (" " + "z" * 5001) * 3 + (" " + "z" * 5000) * 9))
    df = make_docs(docs).selectExpr("*", "1 as word", "2 as n", "3 as _id")
    for damage in (True, False):
        got = [tuple(r) for r in variants(df, damage=damage).collect()]
        want = list(brute(docs, damage))
        assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 100
    assert ("abcde", "abcdef", "abcdefghi", 3, 1, 6) in got
    assert variants(df.limit(0)).collect() == []


@pytest.mark.parametrize("letters", [EQUAL, UNEQUAL])
def test_every_letter_has_one_part(letters):
    all_parts = "".join(part(letters, p) for p in range(letters))
    assert sorted(all_parts) == sorted({*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))})
