import hashlib
import random
import re
import zlib

from sievework.llm.conversations import Survivors, damaged, repaired, summaries
from sievework.llm.queries import op11_conversation_repair

SF = "/root/testdata/sf0.001"
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows, every=False):
    """The least (cost, audit, repaired rows) over edit sequences; rows are (role, text, must_go, truncated).

    With ``every`` all sequences are tried, else the least one into each state goes on.
    """

    def inserted(paths):
        out = set()
        for state, cost, audit, kept in paths:
            for _ in range(3):
                out.add((state, cost, audit, kept))
                role, state = NEXT[state]
                cost, audit, kept = cost + 2, audit + "I", (*kept, f"{role}:")
        return out

    paths = inserted({(0, 0, "", ())})
    for role, text, gone, cut in rows:
        step = set()
        for state, cost, audit, kept in paths:
            step.add((state, cost + 3, audit + "D", kept))
            if not gone:
                if (state, role[:1]) in KEPT:
                    step.add((KEPT[state, role[:1]], cost + cut, audit + "K", (*kept, f"{role}:{text}")))
                other, behind = NEXT[state]
                step.add((behind, cost + 2 + cut, audit + "R", (*kept, f"{other}:{text}")))
        paths = inserted(step)
        if not every:
            paths = {min((p for p in paths if p[0] == state), key=lambda p: p[1:]) for state in {p[0] for p in paths}}
    return min((cost, audit, kept) for state, cost, audit, kept in paths if state in (0, 3))


def brute(rows):
    """rows: (conv_id, turn, role, text) as given; the contract's result."""
    hurt = {}
    for conv, turn, role, text in rows:
        out = hurt.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, listed in hurt.items():
        listed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told, counts, illegal = set(), [], [0, 0, 0], 0
        for i, (_, role, text) in enumerate(listed):
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            told.append((role, text, fault in (0, 1), fault == 2))
            illegal += i > 0 and listed[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in listed if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = cheapest(told)
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_supplied_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op11_conversation_repair(spark, SF).collect())) == sorted(brute(rows))


ODD = [None, "", " ", "Hello.", "Hello", "Why?\n ", "wait!", "no ", "\t\x0b", "x" * 50_000]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_odd_rows(spark):
    rng = random.Random(7)
    roles = [None, "system", "user", "assistant", "tool", "", "Unknown", "user", "assistant"]
    rows = [(rng.choice([None, *range(70)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(ODD)) for _ in range(240)]
    dropped = next(c for c in range(10**6, 2 * 10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += rows[:20] + [(dropped, 0, "user", "only row")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", present int, again int, cost int")
    got = [tuple(r) for r in summaries(damaged(df)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    assert summaries(damaged(df.limit(0))).collect() == []
    edits = [tuple(r) for r in repaired(damaged(df)).collect()]
    for conv, *_, audit, digest in got:
        mine = sorted((e[1:] for e in edits if e[0] == conv), key=lambda e: e[0])
        assert [e[0] for e in mine] == list(range(len(audit))) and "".join(e[1] for e in mine) == audit
        assert hashlib.sha256("\n".join(f"{e[3]}:{e[4]}" for e in mine if e[3] is not None).encode()).hexdigest() == digest


def test_survivors_against_all_paths_and_in_bounded_memory():
    rng = random.Random(1)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", " ", "tool", ""]), "t", rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        paths, out = Survivors(), []
        for role, text, gone, cut in rows:
            out += paths.step(role, text, None, gone, cut)
        cost, rest = paths.end()
        assert (cost, "".join(e[0] for e in out + rest)) == cheapest(rows, every=True)[:2]
    paths, final = Survivors(), 0
    for _ in range(30_000):
        final += len(paths.step(rng.choice(["user", "assistant"]), "t", None, rng.random() < 0.1, rng.random() < 0.1))
    assert final > 29_900 and paths.most < 60


def test_one_conversation_with_most_rows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Row {i % 1500}.") for i in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = {r["conv_id"]: r for r in summaries(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["duplicate"] == 1500 and got[1]["audit"] == "K" * 1500 + "D" * 1500 and got[2]["audit"] == "KK"
