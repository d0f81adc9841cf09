"""Suffix arrays by induced sorting, and permuted common prefixes, of a shard of texts.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour; the substrings between leftmost S suffixes
(LMS) are sorted by inducing, named, and the string of names is sorted recursively where names repeat.  From the sorted LMS suffixes one
pass to the right places all L suffixes and one to the left all S suffixes, in linear time.

A pass goes over groups of neighbouring buckets: what a group induces outside is dealt to its buckets in one vector step.  The few suffixes
that it induces in itself come before, in the order of the scan; a bucket that stands alone needs no order but its own.

Texts of a shard are separated by symbols that are smaller than all bytes and all distinct, so no order and no prefix reaches over the end of a text.
"""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np

SENTINEL, SEPARATOR, BYTES = 0, 1, 2  # a byte b is the symbol b + BYTES
_BATCHES, _LEAST = 64, 1024  # how many groups of buckets a pass is cut into, and how many suffixes a group has at least


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts with a separator between them and the sentinel at the end; where each text starts."""
    whole = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = whole.astype(np.uint16) + BYTES
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    symbols[starts[1:] - 1] = SEPARATOR
    symbols[-1] = SENTINEL
    return symbols, starts


def classified(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour."""
    n = len(t)
    rising = np.empty(n, bool)
    rising[-1] = True
    rising[:-1] = t[:-1] < t[1:]
    level = np.flatnonzero(t[:-1] == t[1:])
    if len(level):  # a run of one symbol is what follows it
        last = np.append(np.diff(level) != 1, True)
        ends = level[last] + 1
        rising[level] = rising[ends[np.cumsum(np.concatenate(([0], last[:-1])))]]
    return rising


def _deal(sa: np.ndarray, pointer: np.ndarray, t: np.ndarray, found: np.ndarray, step: int) -> None:
    """Put suffixes, in order, at the pointers of their symbols' buckets and move the pointers by ``step``."""
    if not len(found):
        return
    symbol = t[found]
    order = np.argsort(symbol, kind="stable")
    symbol, found = symbol[order], found[order]
    first = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
    counts = np.diff(np.append(first, len(symbol)))
    rank = np.arange(len(symbol)) - np.repeat(first, counts)
    if step > 0:
        sa[np.repeat(pointer[symbol[first]], counts) + rank] = found
        pointer[symbol[first]] += counts
    else:
        sa[np.repeat(pointer[symbol[first]], counts) - 1 - rank] = found
        pointer[symbol[first]] -= counts


def _batches(bounds: np.ndarray, fixed: int) -> list[tuple[int, int]]:
    """Neighbouring buckets in groups of a bounded number of suffixes; a larger bucket, and each fixed symbol, stands alone."""
    size, symbols = max(int(bounds[-1]) // _BATCHES, _LEAST), len(bounds) - 1
    out, at = [(c, c + 1) for c in range(fixed)], fixed
    while at < symbols:
        upto = max(int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1, at + 1)
        out.append((at, upto))
        at = upto
    return out


def _induce_larger(t: np.ndarray, rising: np.ndarray, sa: np.ndarray, bounds: np.ndarray, lms_from: np.ndarray, batches: list[tuple[int, int]]) -> np.ndarray:
    """Place all L suffixes, left to right; returns where they end in each bucket."""
    head = bounds[:-1].copy()
    for c, upto in batches:
        lo, hi = int(bounds[c]), int(bounds[upto])
        if upto - c == 1:
            done = lo
            while done < (end := int(head[c])):  # what the bucket induces in itself comes next
                left = sa[done:end] - 1
                done = end
                left = left[left >= 0]
                _deal(sa, head, t, left[~rising[left]], 1)
            left = sa[lms_from[c] : hi] - 1
            left = left[left >= 0]
            _deal(sa, head, t, left[~rising[left]], 1)
            continue
        known = np.flatnonzero(sa[lo:hi] > 0) + lo
        left = sa[known] - 1
        inner = ~rising[left] & (t[left] < upto)
        queue = list(zip(known[inner].tolist(), left[inner].tolist()))
        while queue:  # in the order of the scan
            _, i = heappop(queue)
            at = int(head[t[i]])
            head[t[i]] = at + 1
            sa[at] = i
            if i > 0 and not rising[i - 1] and t[i - 1] < upto:
                heappush(queue, (at, i - 1))
        left = sa[lo:hi]
        left = left[left > 0] - 1
        _deal(sa, head, t, left[~rising[left] & (t[left] >= upto)], 1)
    return head


def _induce_smaller(t: np.ndarray, rising: np.ndarray, sa: np.ndarray, bounds: np.ndarray, head: np.ndarray, batches: list[tuple[int, int]], fixed: int) -> None:
    """Place all S suffixes but the fixed ones, right to left."""
    tail = bounds[1:].copy()

    def smaller(left: np.ndarray) -> np.ndarray:
        left = left[left > 0] - 1
        return left[rising[left] & (t[left] >= fixed)]

    for c, upto in reversed(batches):
        lo, hi = int(bounds[c]), int(bounds[upto])
        if upto - c == 1:
            if c < fixed:
                continue  # these stand already, and L suffixes stand before them
            done = hi
            while done > (end := int(tail[c])):
                left = smaller(sa[end:done][::-1])
                done = end
                _deal(sa, tail, t, left, -1)
            _deal(sa, tail, t, smaller(sa[lo : head[c]][::-1]), -1)
            continue
        known = np.flatnonzero(sa[lo:hi] > 0) + lo
        left = sa[known] - 1
        inner = rising[left] & (t[left] >= c)
        queue = list(zip((-known[inner][::-1]).tolist(), left[inner][::-1].tolist()))
        while queue:
            _, i = heappop(queue)
            at = int(tail[t[i]]) - 1
            tail[t[i]] = at
            sa[at] = i
            if i > 0 and rising[i - 1] and t[i - 1] >= c:
                heappush(queue, (-at, i - 1))
        left = smaller(sa[lo:hi][::-1])
        _deal(sa, tail, t, left[t[left] < c], -1)


def _induced(t: np.ndarray, rising: np.ndarray, lms: np.ndarray, bounds: np.ndarray, fixed: int) -> np.ndarray:
    """All suffixes, induced from the leftmost smaller ones in the given order."""
    sa = np.full(len(t), -1, np.int32)
    symbol = t[lms]
    per = np.bincount(symbol, minlength=len(bounds) - 1)
    lms_from = bounds[1:] - per
    order = np.argsort(symbol, kind="stable")
    slots = np.repeat(lms_from - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(len(lms))
    sa[slots] = lms[order]
    batches = _batches(bounds, fixed)
    head = _induce_larger(t, rising, sa, bounds, lms_from, batches)
    sa[slots[symbol[order] >= fixed]] = -1
    _induce_smaller(t, rising, sa, bounds, head, batches, fixed)
    return sa


def _named(t: np.ndarray, order: np.ndarray, length: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings at ``order`` (sorted): equal ones share a name; those marked ``alone`` equal none."""
    same = (length[1:] == length[:-1]) & ~alone[1:] & ~alone[:-1]
    pair = np.flatnonzero(same)
    a, b, size, at = order[pair], order[pair + 1], length[pair], 0
    while len(pair):
        unlike = t[a + at] != t[b + at]
        same[pair[unlike]] = False
        at += 1
        stay = ~unlike & (size > at)
        pair, a, b, size = pair[stay], a[stay], b[stay], size[stay]
    return np.concatenate(([0], np.cumsum(~same)))


def suffix_array(t: np.ndarray, symbols: int, fixed: int = 1) -> np.ndarray:
    """Order of all suffixes of ``t``, whose last symbol is its only 0.

    Symbols below ``fixed`` other than the sentinel are separators: each is smaller than the ones behind it.
    """
    n = len(t)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    rising = classified(t)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    bounds = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=symbols))))
    order = _induced(t, rising, lms, bounds, fixed)
    leftmost = np.zeros(n, bool)
    leftmost[lms] = True
    order = order[leftmost[order]]
    place = np.zeros(n, np.int32)  # of an LMS suffix among them, by position
    place[lms] = np.arange(len(lms), dtype=np.int32)
    reach = np.append(lms[1:], n - 1)
    which = place[order]
    alone = (t[order] < fixed) | (t[reach[which]] < fixed)
    names = _named(t, order, reach[which] - order + 1, alone)
    if names[-1] + 1 < len(order):
        reduced = np.empty(len(lms), np.uint16 if names[-1] < 1 << 16 else np.int32)
        reduced[which] = names
        order = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return _induced(t, rising, order.astype(np.int64), bounds, fixed)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the suffix before it in order (-1: none) and the length of their common prefix inside their texts.

    Only where the symbols to the left differ is a prefix compared; from there on it shrinks by one a position.  Prefixes
    shorter than ``least`` may count as less; most are told by their eight bytes before that place.
    """
    n = len(t)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    ends = np.flatnonzero(t < BYTES)
    i = np.arange(n)
    follows = (before > 0) & (i > 0)
    follows[follows] = (t[i[follows] - 1] == t[before[follows] - 1]) & (t[i[follows] - 1] >= BYTES)
    start = np.flatnonzero(~follows)
    common = np.zeros(len(start), np.int32)
    active = np.flatnonzero(before[start] >= 0)
    a, b = start[active], before[start[active]].astype(np.int64)
    left = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
    raw = np.concatenate(((t - np.uint16(BYTES)).astype(np.uint8), np.zeros(8, np.uint8)))
    eight = np.ndarray((n,), "<u8", raw, strides=(1,))
    if least >= 8:
        stay = left >= least
        active, a, b, left = active[stay], a[stay], b[stay], left[stay]
        stay = eight[a + least - 8] == eight[b + least - 8]
        active, a, b, left = active[stay], a[stay], b[stay], left[stay]
    at = 0
    while len(active):
        unlike = eight[a + at] ^ eight[b + at]
        low = unlike & (~unlike + np.uint64(1))  # its lowest set bit
        length = np.where(unlike == 0, 8, np.frexp(low.astype(np.float64))[1] - 1 >> 3)
        common[active] = np.minimum(at + length, left)
        at += 8
        stay = (unlike == 0) & (left > at)
        active, a, b, left = active[stay], a[stay], b[stay], left[stay]
    last = np.cumsum(~follows) - 1
    return before, np.maximum(common[last] - (i - start[last]), 0)


def repeated(texts: Sequence[bytes], span: int) -> np.ndarray:
    """Over all texts and the separators between them: True where a run of ``span`` bytes starts that starts elsewhere too."""
    t, _ = joined(texts)
    before, common = permuted_common_prefixes(t, suffix_array(t, BYTES + 256, BYTES), span)
    found = common >= span
    found[before[found]] = True
    return found
