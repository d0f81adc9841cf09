"""Quality rules with risk-controlled thresholds.

Each rule gives a document a score from 0 to 1000 (parts in a thousand, rounded up; higher is worse) and rejects it above
a cutoff.  Cutoffs are chosen per stratum (language) from labelled documents by fixed-sequence testing:

1. A path of joint cutoffs leads from rejecting nothing to rejecting much.  It takes one rule after the other and lowers
   its cutoff to where it tells documents labelled bad best from the rest.  The good documents of the stratum have no
   part in it.
2. Along the path an exact binomial test shows for each joint cutoff that at most the allowed share of good documents is
   rejected; the last one before the first failure is taken.  As the order of the tests does not depend on the documents
   they are made with, no test but the first failing one can go wrong first, and the level is divided by the number of
   strata only.

So with the stated confidence no stratum loses more than the allowed share of the good documents that pass the base check.
A stratum with too few labels to show that (228 for a share of 0.02 and an error of 0.05) rejects nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried, words, written

GRID = 1000
STRATA = ("en", "de", "fr", "es", "other")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "repeats", "dup_lines", "capitals", "marks", "separators")
# The characters that count as symbols, and further marks and letters that the rules look at.
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?~^=_+{}[]\\"


def _count(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def measure(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """Columns in ``carry`` and the counts of the rules; one pass over the text, no shuffle.

    Repeated 3-word windows are found inside the row: window hashes are sorted together with their places, equal
    neighbours give the places of repeated windows, and the gaps between those places give the words they cover.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*carry, body.alias("_t"), words(F.col(text)).alias("_w"))
    shaped = split.select(
        *carry,
        "_t",
        F.size("_w").cast("long").alias("n_words"),
        F.expr("filter(split(_t, '\n', -1), l -> l rlike '[^ \\\\x09-\\\\x0D]')").alias("_lines"),
        F.expr(
            "case when size(_w) > 3 then transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) "
            "else cast(array() as array<bigint>) end"
        ).alias("_h"),
    )
    placed = shaped.select(
        *carry,
        "n_words",
        (F.char_length("_t") - F.coalesce(_count(F.col("_t"), BLANK_CHARS), F.lit(0))).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _count(F.col("_t"), CAPITALS).cast("long").alias("_capitals"),
        _count(F.col("_t"), MARKS).cast("long").alias("_marks"),
        _count(F.col("_t"), "|").cast("long").alias("_separators"),
        F.expr(
            "case when size(array_distinct(_h)) < size(_h) then array_sort(transform(_h, (h, i) -> struct(h, i))) "
            "else cast(array() as array<struct<h: bigint, i: int>>) end"
        ).alias("_s"),
    )
    names = [*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_capitals", "_marks", "_separators"]
    repeated = placed.select(
        *names,
        F.expr(
            "sort_array(filter(transform(_s, (x, j) -> case when (j > 0 and _s[j - 1].h = x.h) or "
            "(j < size(_s) - 1 and _s[j + 1].h = x.h) then x.i end), p -> p is not null))"
        ).alias("_p"),
    )
    covered = (
        "aggregate(transform(_p, (p, j) -> cast(case when j < size(_p) - 1 then least(3, _p[j + 1] - p) else 3 end as bigint)), "
        "0L, (a, x) -> a + x)"
    )
    return repeated.select(*names, F.expr(covered).alias("n_repeat_words"))


def scores() -> dict[str, Column]:
    """Parts in a thousand, rounded up in whole numbers, at most 1000."""

    def share(part: str, whole: str) -> Column:
        over = F.greatest(F.col(whole), F.lit(1))
        return F.least(F.floor((F.col(part) * GRID + over - 1) / over), F.lit(GRID)).cast("int")

    return {
        "symbols": share("n_symbols", "word_chars"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_words"),
        "capitals": share("_capitals", "word_chars"),
        "marks": share("_marks", "word_chars"),
        "separators": share("_separators", "n_words"),
    }


def stratum(lang: str = "lang") -> Column:
    return F.when(F.col(lang).isin(*STRATA[:-1]), F.col(lang)).otherwise(F.lit(STRATA[-1]))


def allowed_rejections(n: int, share: float, level: float) -> int:
    """Greatest k with P(Binomial(n, share) <= k) <= level; -1 if there is none.

    Terms are summed downwards from k in logarithms; they fall off geometrically, so far fewer than k are needed.
    """

    def tail(k: int) -> float:
        term = math.exp(
            math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        )
        total = term
        for j in range(k, 0, -1):
            term *= j * (1 - share) / ((n - j + 1) * share)
            total += term
            if term < total * 1e-17:
                break
        return total

    low, high = -1, int(n * share)  # below the mean the tail is at most about a half
    while low < high:
        middle = (low + high + 1) // 2
        if tail(middle) <= level:
            low = middle
        else:
            high = middle - 1
    return low


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _bins(docs: DataFrame, *by: str) -> DataFrame:
    """Documents by ``by``, rule and score; at most 1001 rows a rule and group."""
    pairs = ", ".join(f"'{r}', {r}" for r in RULES)
    return docs.select(*by, F.expr(f"stack({len(RULES)}, {pairs}) as (rule, score)")).groupBy(*by, "rule", "score").agg(F.count("*").alias("n"))


def _above(counts: dict[int, int], cutoff: int) -> int:
    return sum(n for score, n in counts.items() if score > cutoff)


def _caught(legs: dict[str, int]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(r) > c for r, c in legs.items()], F.lit(False))


def _next_leg(left: dict[str, dict[int, int]], rest: dict[str, dict[int, int]], n_bad: int, n_rest: int) -> tuple[str, int] | None:
    """Rule and cutoff with the greatest share of bad documents not caught before less the share of the rest; the higher cutoff of equals."""
    best = (0.0, -1, "")
    for rule in reversed(RULES):
        for score in left.get(rule, ()):
            if score > 0:
                gain = _above(left[rule], score - 1) / n_bad - _above(rest.get(rule, {}), score - 1) / max(n_rest, 1)
                if gain > 0 and (gain, score - 1) >= best[:2]:
                    best = (gain, score - 1, rule)
    return (best[2], best[1]) if best[2] else None


def fit_cutoffs(scored: DataFrame, labels: DataFrame, doc_id: str, share: float, error: float) -> dict[tuple[str, str], int]:
    """Cutoff by (stratum, rule), from every labelled document of the table that passes the base check.

    ``scored`` has the id, ``_stratum``, the counts and one score column per rule.  Documents are good (a label with quality
    1), bad (labels with quality 0 only) or have no label.  The rest that bad ones are told from are those without a label
    and the good ones of other strata; where nothing is labelled bad, those without a label stand for the bad, and there
    is no rest.  Only counts per kind, stratum, rule and score (1001 at most each) reach the driver.
    """
    told = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max(F.expr("case quality when 1 then 2 when 0 then 1 end")).alias("_kind"))
    held = scored.where(~_base_failed()).select(F.col(doc_id).alias("_id"), "_stratum", *RULES)
    held = held.join(told, F.col("_id") == F.col("_labelled"), "left")
    held = written(held.select("_stratum", F.coalesce("_kind", F.lit(0)).alias("_kind"), *RULES), "quality-labelled")
    bins = _bins(held, "_kind", "_stratum").collect()
    sizes = {(k, s): sum(r["n"] for r in bins if (r["_kind"], r["_stratum"], r["rule"]) == (k, s, RULES[0])) for k in range(3) for s in STRATA}
    allowed = {s: allowed_rejections(sizes[2, s], share, error / len(STRATA)) for s in STRATA if sizes[2, s]}
    allowed = {s: k for s, k in allowed.items() if k >= 0}
    bad = 1 if any(sizes[1, s] for s in STRATA) else 0
    n_bad = sum(sizes[bad, s] for s in STRATA)
    if not allowed or not n_bad:
        return {}
    rest: dict[str, dict[str, dict[int, int]]] = {s: {r: {} for r in RULES} for s in allowed}
    n_rest = dict.fromkeys(allowed, 0)
    for s in allowed:
        for row in bins if bad else ():
            if row["_kind"] == 0 or (row["_kind"] == 2 and row["_stratum"] != s):
                counts = rest[s][row["rule"]]
                counts[row["score"]] = counts.get(row["score"], 0) + row["n"]
        n_rest[s] = sum(rest[s][RULES[0]].values())
    # The path of each stratum: its rules in order, each with the cutoff its leg ends at.
    paths: dict[str, dict[str, int]] = {s: {} for s in allowed}
    growing = list(allowed)
    while growing:
        uncaught = [held.where(F.col("_kind") == bad).where(~_caught(paths[s])).select(F.lit(s).alias("_goal"), *RULES) for s in growing]
        left: dict[str, dict[str, dict[int, int]]] = {s: {} for s in growing}
        for row in _bins(reduce(DataFrame.unionByName, uncaught), "_goal").collect():
            if row["rule"] not in paths[row["_goal"]]:
                left[row["_goal"]].setdefault(row["rule"], {})[row["score"]] = row["n"]
        legs = {s: _next_leg(left[s], rest[s], n_bad, n_rest[s]) for s in growing}
        growing = [s for s in growing if legs[s]]
        for s in growing:
            paths[s][legs[s][0]] = legs[s][1]
    # The leg that rejects a good document first, and its score there: higher scores are rejected earlier.
    met = F.lit(None).cast("struct<leg: int, score: int>")
    for s, legs_of in paths.items():
        for leg, (rule, cutoff) in reversed(list(enumerate(legs_of.items()))):
            hit = (F.col("_stratum") == s) & (F.col(rule) > cutoff)
            met = F.when(hit, F.struct(F.lit(leg).alias("leg"), F.col(rule).alias("score"))).otherwise(met)
    lost = held.where("_kind = 2").select("_stratum", met.alias("_met")).where("_met is not null").groupBy("_stratum", "_met").agg(F.count("*").alias("n"))
    steps = sorted((r["_stratum"], r["_met"]["leg"], -r["_met"]["score"], r["n"]) for r in lost.collect())
    cutoffs: dict[tuple[str, str], int] = {}
    for s, legs_of in paths.items():
        spent, stop = 0, (len(legs_of), 0)
        for _, leg, score, n in (x for x in steps if x[0] == s):
            spent += n
            if spent > allowed[s]:
                stop = (leg, -score)
                break
        for leg, (rule, cutoff) in enumerate(legs_of.items()):
            if leg <= stop[0]:
                cutoffs[s, rule] = cutoff if leg < stop[0] else stop[1]
    return cutoffs


def judge(
    docs: DataFrame,
    labels: DataFrame,
    carry: list[str] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    lang: str = "lang",
    share: float = 0.02,
    error: float = 0.05,
) -> DataFrame:
    """Counts and verdict of every document.

    Returns ``carry`` (all columns by default), the five counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.
    ``share`` bounds the good documents lost per stratum beyond the base check, ``error`` the chance that any bound is broken.

    Null and blank texts have no words and fail the base check; unknown or null languages form one stratum; documents
    with null ids are judged but never labelled; repeated rows are judged each and counted each; with no labels nothing but
    the base check rejects; an empty table gives no rows; an input column named as a result column is replaced.
    """
    results = (*COUNTS, "base_failed", "failed_rules", "kept")
    kept = [c for c in (carry or docs.columns) if c not in results]
    named = docs.select(carried(kept), F.col(doc_id).alias("_key"), stratum(lang).alias("_stratum"), F.col(text).alias("_text"))
    measured = measure(named, [CARRIED, "_key", "_stratum"], "_text")
    scored = written(measured.withColumns(scores()), "quality-counts")
    cutoffs = fit_cutoffs(scored, labels, "_key", share, error)

    def fails(rule: str) -> Column:
        tests = [(F.col("_stratum") == s) & (F.col(rule) > c) for (s, r), c in cutoffs.items() if r == rule]
        return reduce(lambda x, y: x | y, tests, F.lit(False))

    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r)) for r in RULES]))
    base = _base_failed()
    return scored.select(
        f"{CARRIED}.*",
        *COUNTS,
        base.alias("base_failed"),
        failed.alias("failed_rules"),
        (~base & (F.size(failed) == 0)).alias("kept"),
    )
