"""Spelling variants: words one edit apart, found through PartEnum signatures of their letter multisets.

A word's letters are a binary vector with one place for the k-th occurrence of each letter.  One replaced letter moves
two places of the vector, one inserted or deleted letter moves one, so words one edit apart are vectors at Hamming
distance two at most.  The places are partitioned by letter; a distance of ``k`` touches at most ``k`` of the parts, so two
vectors within it agree on all parts but some ``k``.  Every choice of ``k`` parts to leave out gives one signature, the
letters of the other parts; equal signatures meet in an equality join and the words themselves are verified.

Signatures are enumerated for the two shapes of an edit: equal lengths (distance two, ``EQUAL`` parts) and lengths one apart
(distance one, ``UNEQUAL`` parts).  An edit also leaves either the first or the last half of a word as it was, so a
signature carries one of the halves: words made of the same syllables share their letters, but seldom a half as well.

Everything is DataFrame work: texts are cut, counted with map-side partial sums, and only the vocabulary is joined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import written

# The letters of a run, and the letters that are lower-cased.
RUN = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
# Letters from frequent to rare; dealt round, the parts get about equally many letters of a word.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkqjxz"

EQUAL, UNEQUAL = 4, 2
DAMAGE = 97


def part(letters: int, number: int) -> str:
    """The letters of one of ``letters`` parts."""
    common = "".join(c for i, c in enumerate(BY_FREQUENCY) if i % letters == number)
    return common + "".join(c for c in ACCENTED if ord(c) % letters == number)


def damaged_run(doc_id: Column, run: Column) -> Column:
    """The run, or what is left of it where the checksum of ``<doc_id>:<run>`` asks for one letter to go."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(DAMAGE)) == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: bool = True, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """``word`` and ``n``, its occurrences over all texts."""
    runs = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.col(doc_id).alias("_id"), F.explode(runs).alias("run")).where(F.char_length("run") >= least_letters)
    word = damaged_run(F.col("_id"), F.col("run")) if damage else F.col("run")
    counted = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def _signatures(shape: str, length: Column, first: Column, last: Column, letters: Column, parts: int, distance: int) -> list[Column]:
    out = []
    for gone in combinations(range(parts), distance):
        rest = F.translate(letters, "".join(part(parts, p) for p in gone), "")
        named = F.lit(f"{shape}{gone}")
        out += [F.xxhash64(named, F.lit(side), length, half, rest) for side, half in (("first", first), ("last", last))]
    return out


def signatures(words: DataFrame) -> DataFrame:
    """``key``, ``role`` (0: equal lengths, 1: the shorter word, 2: the longer one), ``word`` and ``n``."""
    word, size = F.col("word"), F.char_length("word")
    letters = F.array_join(F.array_sort(F.split(word, "")), "")

    def halves(shorter: Column, longer: Column) -> tuple[Column, Column]:
        """Either the first letters before the middle of the longer word, or the last ones behind it, stay."""
        first = F.floor(longer / 2).cast("int")
        return F.substring(word, F.lit(1), first), F.right(word, longer - first)

    same = _signatures("=", size, *halves(size, size), F.col("_letters"), EQUAL, 2)
    short = _signatures("+", size + 1, *halves(size, size + 1), F.col("_letters"), UNEQUAL, 1)
    long = _signatures("+", size, *halves(size - 1, size), F.col("_letters"), UNEQUAL, 1)
    rows = [F.struct(F.lit(role).cast("tinyint").alias("role"), k.alias("key")) for role, keys in ((0, same), (1, short), (2, long)) for k in keys]
    return words.select("word", "n", letters.alias("_letters")).select("word", "n", F.inline(F.array(*rows)))


def near_pairs(words: DataFrame) -> DataFrame:
    """Every two words one edit apart, once: ``a``, ``n_a``, ``b``, ``n_b``."""
    rows = written(signatures(words), "spelling-signatures")
    left = rows.where("role < 2").select("key", F.col("role").alias("role_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.where("role <> 1").select("key", F.col("role").alias("role_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    fits = ((F.col("role_a") == 0) & (F.col("role_b") == 0) & (F.col("a") < F.col("b"))) | ((F.col("role_a") == 1) & (F.col("role_b") == 2))
    met = left.join(right, "key").where(fits & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of each word's chain of forms, found by doubling the steps.

    A form is at least twice as frequent as its word, so chains end, after at most 40 steps for a trillion occurrences.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        steps = written(steps, "spelling-roots")
        if steps.where("_moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: bool = False, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """The words of all texts with their spelling groups: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of at least ``least_letters`` code points and
    ``least_count`` occurrences.  Near words differ by one inserted, deleted or replaced code point.  The form is the near
    word with the most occurrences (ties: first in code-point order), if it has at least twice the word's own; the root is the end
    of the chain of forms.  With ``damage`` a checksum of the id and the run strikes one letter out of one run in 97, so that there is something
    to find; a null id then reads as empty.

    Null and empty texts have no words; texts are read whole, a run of any length is one word; repeated rows count each
    time; an empty table gives no rows; of the input only the id and the text are used, so other columns cannot clash.
    """
    words = written(word_counts(docs, text, doc_id, damage, least_letters, least_count), "spelling-words")
    pairs = near_pairs(words)
    sides = F.inline(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n")) for x, y in ("ab", "ba")]))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")
    near = pairs.select(sides).groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.rank") >= 2 * F.col("n")
    told = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"),
        F.when(strong, -F.col("best.rank")).alias("form_n"),
    )
    told = written(told, "spelling-near")
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
