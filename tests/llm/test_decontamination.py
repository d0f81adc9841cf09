import re
from collections import Counter

import pytest

from sievework.llm import decontamination
from sievework.llm.decontamination import contaminated, drop_contaminated, simhash
from sievework.llm.queries import op9_decontamination

SF = "/root/testdata/sf0.01"


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def similarity(a, b):
    a, b = Counter(grams(a)), Counter(grams(b))
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def brute(docs, items, least=0.8):
    out = {}
    known = [(i, tokens(t)) for i, t in items]
    known = [(i, w, set(grams(w))) for i, w in known if len(w) >= 5]
    for d, text in docs:
        w = tokens(text)
        places = {}
        for p, g in enumerate(grams(w)):
            places.setdefault(g, []).append(p)
        for i, v, own in known:
            n = len(v)
            starts = {s for g in own for p in places.get(g, []) for s in range(max(0, p - n + 5), min(p, len(w) - n) + 1)}
            if len(w) < n:
                starts = {0} & {0 for g in own if g in places}
            best = max(((similarity(w[s : s + n], v), -s) for s in starts), default=(0, 0))
            if best[0] >= least:
                out[d, i] = (best[0], -best[1])
    return out


def as_found(rows):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in rows}


def test_supplied_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = as_found(op9_decontamination(spark, SF).collect())
    assert got and got == brute(docs, items)


def long_item(n, tag):
    return " ".join(f"{tag}{i}" for i in range(n))


def test_edits_repeats_and_lengths(spark, make_docs):
    item, big = long_item(60, "a"), long_item(400, "big")
    edited = item.split()
    edited[2] = "other"
    shifted = item.split()
    shifted.insert(57, "more")
    often = "x y x y x y x y x y x y x y x y x y x y"
    items = [(1, item), (2, item), (3, big), (4, often), (5, "too few words"), (None, None), (6, "")]
    docs = [
        (1, f"before it {item.upper()} and after"),
        (2, " ".join(["b c d", *edited, "e f g"])),
        (3, " ".join(shifted)),
        (4, " ".join(item.split()[:40]) + " and then another thing that goes on for a while with no end in sight at all"),
        (5, f"{big} tail"),
        (6, often + " x y x y"),
        (7, item),
        (7, item),
        (11, " ".join(item.split()[:59])),
        (12, " ".join(item.split()[:46])),
        (13, " ".join(item.split()[3:53] + item.split()[:3])),
        (8, "too few words"),
        (9, None),
        (10, ""),
        (None, item),
    ]
    given = spark.createDataFrame(items, "item_id bigint, text string")
    df = make_docs(docs).selectExpr("*", "1 as item_id", "2 as n", "3 as h", "4 as _key")
    rows = contaminated(df, given).collect()
    want = brute(docs, items)
    assert as_found(rows) == want and len(rows) == len(want)
    assert (11, 1) in want and (11, 2) in want and (12, 1) not in want
    left = drop_contaminated(df, given)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if d is not None and not any(k[0] == d for k in want))
    assert contaminated(df.limit(0), given).collect() == []
    assert contaminated(df, given.limit(0)).collect() == []


@pytest.mark.parametrize("most", [127, 128, 32_768])
def test_simhash_lanes(spark, most):
    import random

    rng = random.Random(most)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(100)]
    hashes += hashes[:27]
    got = spark.createDataFrame([(hashes,)], "h array<bigint>").selectExpr(simhash("h", most)).first()[0]
    raw = [h & (1 << 64) - 1 for h in hashes]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in raw) > len(raw))
    assert got & (1 << 64) - 1 == want


@pytest.mark.parametrize("radius", [0, 3, 20, 63])
def test_blocks_cover_the_mark(radius):
    blocks = decontamination._blocks(radius)
    assert len(blocks) == radius + 1
    assert [b for at, width in blocks for b in range(at, at + width)] == list(range(64))


def test_exploded_tables_are_not_broadcast(spark, make_docs):
    """A broadcast is made of written tables, whose size Spark knows, never of windows or starts that were exploded from them."""
    item = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(i, f"a{i} b{i} {item} c{i}") for i in range(5)])
    found = contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    sent = []
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            sent.append("\n".join(lines[i + 1 : end]))
    assert sent and not [x for x in sent if "Generate" in x or "collect_list" in x]
    assert found.count() == 5
