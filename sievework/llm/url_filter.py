"""URL filtering by a bit-parallel wildcard automaton.

All glob rules become one automaton of the Shift-And kind.  Every literal of every rule owns one bit of a multiword
mask; a star is no bit but a self-loop on the bit before it.  A step over one character is, for all rules at once,

    state = (shift(state) & accepts[character]) | (state & loops[character])

and the simulation runs over a whole batch of URLs as numpy arrays of words.  A URL is matched in its canonical form,
lower-cased host followed by path.  A star left of a rule's first slash belongs to the host and does not cross a slash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = 64
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path prefix that starts with a slash."""

    action: str
    host: str
    path: str

    @property
    def label(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}*", f"*.{self.host}{self.path}*"]


class Automaton:
    """Glob patterns (``*`` any run, ``?`` any one character) packed into words of 64 bits."""

    def __init__(self, globs: Sequence[str]):
        starts, finals, literals, loops = [], [], [], {}
        bit = 0
        for glob in globs:
            starts.append(bit)
            in_host = True
            for ch in glob:
                if ch == "*":
                    loops[bit] = "host" if in_host and loops.get(bit) != "all" else "all"
                    continue
                bit += 1
                literals.append((bit, ch))
                in_host = in_host and ch != "/"
            finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // WORD))
        self.alphabet = sorted({ord(ch) for _, ch in literals if ch != "?"} | {ord("/")})
        classes = len(self.alphabet) + 1  # class 0: every character that no rule names
        index = {c: i + 1 for i, c in enumerate(self.alphabet)}
        self.start = self._mask(starts)
        self.final_bits = finals
        self.accepts = np.zeros((classes, self.words), np.uint64)
        self.loops = np.zeros((classes, self.words), np.uint64)
        for at, ch in literals:
            for c in range(classes) if ch == "?" else [index[ord(ch)]]:
                self._set(self.accepts[c], at)
        for at, kind in loops.items():
            for c in range(classes):
                if kind == "all" or c != index[ord("/")]:
                    self._set(self.loops[c], at)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // WORD] |= np.uint64(1) << np.uint64(bit % WORD)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            self._set(out, b)
        return out

    def _classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(np.asarray(self.alphabet)[place] == codes, place + 1, 0).astype(np.int16)

    def run(self, texts: Sequence[str], cells: int = 4_000_000) -> np.ndarray:
        """Boolean matrix: text by pattern.  At most ``cells`` character classes are laid out at once."""
        out = np.zeros((len(texts), len(self.final_bits)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            take = max(1, cells // max(1, len(texts[order[at]])))
            rows = order[at : at + take]
            out[rows] = self._block([self._classes(texts[i]) for i in rows])
            at += take
        return out

    def _block(self, rows: list[np.ndarray]) -> np.ndarray:
        """Rows come longest first, so those still running are always a prefix of the block."""
        lengths = np.array([len(r) for r in rows])
        longest = int(lengths.max(initial=0))
        grid = np.zeros((longest, len(rows)), np.int16)
        for i, r in enumerate(rows):
            grid[: len(r), i] = r
        state = np.tile(self.start, (len(rows), 1))
        running = np.searchsorted(-lengths, -np.arange(longest), side="left")
        one, carry = np.uint64(1), np.uint64(WORD - 1)
        for t in range(longest):
            n = running[t]
            now, kind = state[:n], grid[t, :n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            state[:n] = (moved & self.accepts[kind]) | (now & self.loops[kind])
        hits = [(state[:, b // WORD] >> np.uint64(b % WORD)) & one for b in self.final_bits]
        return np.stack(hits, axis=1).astype(bool)


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host (A-Z only) and path; both empty for null or a text without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(_UPPER), path


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule], blocked: Sequence[str] = (), url: str = "url", default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    Of the rules that fit, the one with the longest ``host + path`` decides; of equally long ones the one listed first.
    Where none fits, the globs in ``blocked`` are asked (any match blocks), else ``default`` holds.  Rules and globs are
    a parameter and travel with the task.  Null URLs and URLs without ``://`` have an empty host and path and get the
    default; repeated rows stay repeated; an empty table gives no rows; an input column with the name of a result column
    is replaced.
    """
    rules, blocked = list(rules), list(blocked)
    globs = [g for r in rules for g in r.globs()] + blocked
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].label), i))
    outcome = "host string, path string, rule string, verdict string"

    @F.pandas_udf(outcome)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for urls in batches:
            parts = [split_url(u) for u in urls]
            hits = automaton.run([h + p for h, p in parts])
            best = np.full(len(parts), -1)
            for i in reversed(ranked):
                best[hits[:, 2 * i] | hits[:, 2 * i + 1]] = i
            bad = hits[:, 2 * len(rules) :].any(axis=1)
            yield pd.DataFrame(
                {
                    "host": [h for h, _ in parts],
                    "path": [p for _, p in parts],
                    "rule": [rules[i].label if i >= 0 else None for i in best],
                    "verdict": [rules[i].action if i >= 0 else "block" if b else default for i, b in zip(best, bad)],
                }
            )

    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in names]
    judged = pages.select(*kept, judge(F.col(url)).alias("_judged"))
    return judged.select(*kept, *[F.col("_judged")[n].alias(n) for n in names])
