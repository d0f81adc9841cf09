"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns give the base spans.  The chain model reads words as shapes (letters, digits, marks, lengths), is trained on
the small labelled table of ``pii_labels``, and adds spans that the patterns do not cover, such as a telephone number
without its country code.  Words that hold no digit, at-sign, plus or bracket, and have no such neighbour, can only be
outside a span; the chain falls apart at them, so decoding the runs between them is exact.  All runs of a batch are
decoded together by Viterbi in numpy.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import CARRIED, carried
from sievework.llm.pii_labels import labelled_table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
Span = tuple[int, int, str]

# ---- base patterns ----------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, and a run is never given back, so no text takes quadratic time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[A-Za-z]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, per kind leftmost and non-overlapping, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            end = found.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ---- words and their shapes -------------------------------------------------------------------------------------

_TOLD = re.compile(r"[0-9@+()\[\]]")
_NO_LETTER = re.compile(r"[\x00-@\[-`{-\x7f]+")
_BLANK = np.zeros(0x110000, bool)
_BLANK[[ord(c) for c in " \t\n\x0b\x0c\r"]] = True
# Bounds of the counts that a shape tells apart, and the number of values of each feature.
_DIGITS, _LETTERS, _DOTS, _DASHES = (0, 1, 2, 3, 4, 6, 8, 11, 15, 16, 19), (0, 1, 4), (0, 1, 2, 3), (0, 1, 2)
_SIZES = (12, 4, 5, 4, 2, 2, 2, 2)


@lru_cache(maxsize=100_000)
def shape(word: str) -> tuple[int, ...]:
    """Counts of digits, letters, dots and dashes in steps; at-sign, plus, bracket, other mark at the end."""
    digits = sum(c in "0123456789" for c in word)
    letters = len(_NO_LETTER.sub("", word))
    marks = word[-1] < "\x80" and not word[-1].isalnum() and word[-1] not in "@.-/+()[]"
    return (
        bisect_left(_DIGITS, digits),
        bisect_left(_LETTERS, letters),
        bisect_left(_DOTS, word.count(".")),
        bisect_left(_DASHES, word.count("-") + word.count("/")),
        int("@" in word),
        int("+" in word),
        int(any(c in word for c in "()[]")),
        int(marks),
    )


_WIDTH = sum(_SIZES) + 1
N_FEATURES = 3 * _WIDTH


def _features(words: Sequence[str | None]) -> np.ndarray:
    """Feature numbers of all words but the first and last: own ones and, in numbers of their own, both neighbours'.

    None stands for the edge of the text and has one feature number of its own.
    """
    offsets = np.cumsum([0, *_SIZES])[:-1]
    own = np.array([np.full(len(_SIZES), _WIDTH - 1) if w is None else np.add(shape(w), offsets) for w in words])
    return np.concatenate((own[1:-1], own[:-2] + _WIDTH, own[2:] + 2 * _WIDTH), axis=1)


# ---- the chain --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    """Weights: feature by label, label by following label, first label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of feature rows as one array, and the mask of true places."""
    longest = max(map(len, rows))
    grid = np.zeros((len(rows), longest, rows[0].shape[1]), np.int64)
    mask = np.zeros((len(rows), longest), bool)
    for i, r in enumerate(rows):
        grid[i, : len(r)], mask[i, : len(r)] = r, True
    return grid, mask


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, decay: float = 1e-3, rate: float = 0.1) -> Chain:
    """Maximum likelihood with a quadratic penalty: exact gradients by forward-backward, Adam steps."""
    grid, mask = _padded(rows)
    n, longest = mask.shape
    k = len(LABELS)
    gold = np.zeros((n, longest), np.int64)
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    weights = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    both = mask[:, 1:]
    design = np.zeros((int(mask.sum()), N_FEATURES))
    np.add.at(design, (np.arange(len(design))[:, None], grid[mask]), 1)
    for t in range(1, rounds + 1):
        emit, step, first = weights
        score = np.zeros((n, longest, k))
        score[mask] = design @ emit
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = score[:, 0] + first
        for j in range(1, longest):
            new = _logsum(ahead[:, j - 1, :, None] + step, 1) + score[:, j]
            ahead[:, j] = np.where(mask[:, j, None], new, ahead[:, j - 1])
        back = np.zeros((n, longest, k))
        for j in range(longest - 2, -1, -1):
            new = _logsum(step + (score[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where(mask[:, j + 1, None], new, 0)
        total = _logsum(ahead[:, -1], 1)
        here = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(
            ahead[:, :-1, :, None] + step + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * both[:, :, None, None]
        hit = np.eye(k)[gold] * mask[:, :, None]
        slope = [design.T @ (hit - here)[mask], None, None]
        slope[1] = (hit[:, :-1, :, None] * hit[:, 1:, None, :] * both[:, :, None, None] - pair).sum(axis=(0, 1))
        slope[2] = (hit[:, 0] - here[:, 0]).sum(axis=0)
        for w, g, (m, v) in zip(weights, slope, moment):
            g = g / n - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Chain(*weights)


def decode(chain: Chain, rows: list[np.ndarray], cells: int = 200_000) -> list[np.ndarray]:
    """Most likely labels of each sequence (Viterbi).  Sequences of like length are laid out together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(rows[order[end]]) <= cells:
            end += 1
        some = order[at:end]
        grid, mask = _padded([rows[i] for i in some])
        score = chain.emit[grid].sum(axis=2)
        n, longest, k = score.shape
        best = score[:, 0] + chain.first
        came = np.zeros((n, longest, k), np.int8)
        for j in range(1, longest):
            options = best[:, :, None] + chain.step
            came[:, j] = options.argmax(axis=1)
            best = np.where(mask[:, j, None], options.max(axis=1) + score[:, j], best)
        label = best.argmax(axis=1)
        path = np.zeros((n, longest), np.int64)
        for j in range(longest - 1, -1, -1):
            path[:, j] = label
            label = np.where(mask[:, j], came[np.arange(n), j, label], label) if j else label
        for i, p, m in zip(some, path, mask):
            out[i] = p[m]
        at = end
    return out


def _sequences(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Runs of words that may be inside a span, as (start, end) rows, and the features of each run."""
    if not _TOLD.search(text):
        return [], []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = np.concatenate(([False], ~_BLANK[codes], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1]).reshape(-1, 2)
    told = np.zeros(len(edges) + 2, bool)
    places = np.fromiter((m.start() for m in _TOLD.finditer(text)), np.int64)
    told[np.searchsorted(edges[:, 0], places, side="right")] = True  # shifted by one, for the neighbours below
    near = told[1:-1] | told[:-2] | told[2:]
    cuts = np.flatnonzero(np.diff(np.concatenate(([False], near, [False])).astype(np.int8))).reshape(-1, 2)
    runs, features = [], []
    for a, b in cuts:
        runs.append(edges[a:b])
        words = [text[s:e] for s, e in edges[max(a - 1, 0) : b + 1]]
        features.append(_features([*[None][: int(a == 0)], *words, *[None][: int(b == len(edges))]]))
    return runs, features


def _labels_of(spans: Sequence[Span], run: np.ndarray) -> np.ndarray:
    out = np.zeros(len(run), np.int64)
    for s, e, kind in spans:
        inside = np.flatnonzero((run[:, 0] < e) & (run[:, 1] > s))
        out[inside] = LABELS.index(f"I-{kind}")
        out[inside[:1]] = LABELS.index(f"B-{kind}")
    return out


@lru_cache(maxsize=1)
def model() -> Chain:
    """The chain trained on the labelled table (fixed size, a few hundred lines); deterministic."""
    rows, labels = [], []
    for text, spans in labelled_table():
        runs, features = _sequences(text)
        rows += features
        labels += [_labels_of(spans, r) for r in runs]
    return train(rows, labels)


_EDGE = "\"'`.,;:!?<>{}*#$%&|=~^_-/[]"


def _possible(found: str, kind: str) -> bool:
    """A card number passes its checksum, the parts of an address are at most 255, a number has enough digits."""
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits) and not _LETTER.search(found)
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return kind == "email" or 7 <= len(digits) <= 15


def added_spans(texts: Sequence[str], chain: Chain) -> list[list[Span]]:
    """Spans the chain finds in each text, edge marks trimmed, without regard to the base spans."""
    parts = [_sequences(t) for t in texts]
    flat = decode(chain, [f for p in parts for f in p[1]])
    out, at = [], 0
    for text, (runs, _) in zip(texts, parts):
        spans: list[Span] = []
        for run, labels in zip(runs, flat[at : at + len(runs)]):
            j = 0
            while j < len(run):
                if labels[j] == 0:
                    j += 1
                    continue
                kind = (labels[j] - 1) // 2
                end = j + 1
                while end < len(run) and labels[end] == 2 * kind + 2:
                    end += 1
                s, e = int(run[j, 0]), int(run[end - 1, 1])
                while s < e and text[s] in _EDGE:
                    s += 1
                while e > s and (text[e - 1] in _EDGE or (text[e - 1] == ")" and "(" not in text[s:e])):
                    e -= 1
                if s < e and _possible(text[s:e], KINDS[kind]):
                    spans.append((s, e, KINDS[kind]))
                j = end
        at += len(runs)
        out.append(spans)
    return out


def find(texts: Sequence[str], chain: Chain) -> list[tuple[list[Span], list[Span]]]:
    """Per text the base spans, and all spans: base ones and those of the chain that touch none of them."""
    out = []
    for text, more in zip(texts, added_spans(texts, chain)):
        base = base_spans(text)
        out.append((base, sorted(base + _apart(base, more), key=lambda x: (x[0], KINDS.index(x[2])))))
    return out


def _apart(base: list[Span], more: list[Span]) -> list[Span]:
    """Spans of ``more`` that touch no base span; both lists are in order of their starts."""
    out, at, reach = [], 0, -1
    for span in more:
        while at < len(base) and base[at][0] < span[1]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= span[0]:
            out.append(span)
    return out


def _batches(column: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    run, size = [], 0
    for value in column:
        text = value.as_py() or ""
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


RESULTS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def find_personal_data(docs: DataFrame, carry: list[str] | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """``carry`` (all columns by default) with counts and digest of the base spans and the text of all spans.

    Offsets are code points, ends exclusive.  With ``redact`` the text column is replaced: each span by its kind in
    brackets, the first of overlapping ones standing for all; null texts stay null.  Null and empty texts have no spans;
    repeated rows are judged each; an empty table gives no rows; an input column named as a result column is replaced.
    """
    kept = [c for c in (carry or docs.columns) if c not in RESULTS and not (redact and c == text)]
    chain = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(1)
            counts, digests, all_spans, clean = [], [], [], []
            for texts in _batches(source):
                for body, (base, spans) in zip(texts, find(texts, chain)):
                    counts.append([sum(x[2] == k for x in base) for k in KINDS])
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    all_spans.append(joined(spans))
                    if redact:
                        clean.append(redacted(body, spans))
            columns = [batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]]
            columns += [pa.array(digests, pa.string()), pa.array(all_spans, pa.string())]
            columns.append(pa.array([c if s.is_valid else None for c, s in zip(clean, source)] if redact else [None] * len(batch), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[CARRIED, *RESULTS, "_clean"])

    source = docs.select(carried(kept), F.col(text).alias("_text"))
    counts_ = [F.lit(None).cast("long").alias(c) for c in RESULTS[:4]]
    texts_ = [F.lit(None).cast("string").alias(c) for c in (*RESULTS[4:], "_clean")]
    found = source.mapInArrow(run, source.select(CARRIED, *counts_, *texts_).schema)
    return found.select(f"{CARRIED}.*", *RESULTS, *([F.col("_clean").alias(text)] if redact else []))


def redacted(text: str, spans: Sequence[Span]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
