import re
from collections import Counter
from math import comb

from sievework.llm.quality import COUNTS, allowed_rejections, judge
from sievework.llm.queries import op6_quality_rules

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
    return counts, len(w) < 50 or 100 * len(covered) > 50 * len(w)


def check(rows, texts):
    for r in rows:
        counts, failed = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == counts
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_supplied_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op6_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_odd_rows_and_names(spark, make_docs, odd_docs):
    docs = make_docs([(i, t) for i, (_, t) in enumerate(odd_docs)]).selectExpr("*", "'x' as kept", "7 as n_words", "3 as _w")
    labels = spark.createDataFrame([(None, 1, 0), (3, None, None), (3, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = judge(docs, labels).collect()
    assert len(rows) == len(odd_docs)
    check(rows, {i: t for i, (_, t) in enumerate(odd_docs)})
    assert judge(docs.limit(0), labels.limit(0)).collect() == []


def test_binomial_bound_is_exact():
    for n, share, level in [(10, 0.3, 0.05), (200, 0.02, 0.05), (500, 0.01, 1e-4), (3000, 0.004, 1e-5), (40, 0.01, 0.01)]:
        cdf, best = 0.0, -1
        for k in range(n + 1):
            cdf += comb(n, k) * share**k * (1 - share) ** (n - k)
            if cdf > level:
                break
            best = k
        assert allowed_rejections(n, share, level) == best


def test_cutoffs_reject_junk_and_keep_the_good(spark, make_docs):
    good = " ".join(f"plain word number{i}" for i in range(40))
    bad = " ".join(f"j{i}## &&u%%nk{i}" for i in range(40))
    rows = [(i, f"{good} extra{i}", "en") for i in range(6000)] + [(6000 + i, f"{bad} z{i}", "en") for i in range(50)]
    rows += [(9000 + i, f"{bad} z{i}", "fr") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)] + [(9000, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in judge(make_docs(rows), labels).collect()}
    assert all(got[i]["kept"] for i in range(6000))
    assert not any(got[6000 + i]["kept"] for i in range(50))
    assert all("symbols" in got[6000 + i]["failed_rules"] for i in range(50))
    # one label cannot show anything about French
    assert all(got[9000 + i]["kept"] for i in range(5))


def test_lost_share_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = op6_quality_rules(spark, sf)
    lost = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    n, bad = lost.count(), lost.where("not kept").count()
    assert bad <= 0.02 * n


def test_labelled_junk_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op6_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(langs, "doc_id").where("not base_failed").collect()
    junk = [r for r in rows if r["quality"] == 0]
    assert len(junk) == 291 and sum(r["kept"] for r in junk) <= 3
    for lang in ("en", "de", "es", "fr"):
        good = [r for r in rows if r["quality"] == 1 and r["lang"] == lang]
        assert sum(not r["kept"] for r in good) <= 0.02 * len(good)


def test_230_labels_of_a_language_are_enough(spark, make_docs):
    """The needed number of labels, and good documents that the bad ones look like: nothing of them may be lost."""
    good = " ".join(f"plain word number{i}" for i in range(40))
    bad = " ".join(f"j{i}## &&u%%nk{i}" for i in range(40))
    rows = [(i, f"{good} e{i}", "de") for i in range(230)] + [(1000 + i, f"{bad} z{i}", "de") for i in range(20)]
    rows += [(2000 + i, f"{good} e{i}", "fr") for i in range(227)] + [(3000 + i, f"{bad} z{i}", "fr") for i in range(20)]
    rows += [(4000 + i, f"{bad} e{i}", "es") for i in range(230)] + [(5000 + i, f"{bad} z{i}", "es") for i in range(20)]
    labels = [(d, int(d // 1000 % 2 == 0), 0) for d, _, _ in rows]
    got = judge(make_docs(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {r["doc_id"] // 1000 for r in got if not r["kept"]} == {1}
    assert sum(not r["kept"] for r in got) == 20
    assert allowed_rejections(228, 0.02, 0.01) == 0 and allowed_rejections(227, 0.02, 0.01) == -1
