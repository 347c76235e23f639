"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The induction goes through the buckets of first symbols. All suffixes that one bucket (or one
run of equal symbols in it) induces are placed at once, in scan order, so the array is filled in
linear time without a step for each suffix.

The reduced string of leftmost S substrings, about a third as long, is sorted by prefix doubling and not by
another induction: its alphabet is nearly as large as itself, so an induction takes a Python step for each
symbol, which costs about twice as much as all the rest. Common prefixes are compared
eight symbols at a time up to the limit instead of being carried along in text order, for the same reason.
"""

from __future__ import annotations

import numpy as np


def _spread(positions: np.ndarray, symbols: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Appends the positions to the buckets of their symbols, keeping their order."""
    if len(positions) < 2:
        for p, s in zip(positions, symbols, strict=True):
            into[s].append(np.array([p]))
        return
    order = np.argsort(symbols.astype(np.uint16) if symbols.max() < 1 << 16 else symbols, kind="stable")
    positions, symbols = positions[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for s, part in zip(symbols[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
        into[s].append(part)


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as the order of the leftmost S suffixes ``lms`` determines it."""
    n, top = len(text), int(alphabet[-1]) + 1
    empty = np.zeros(0, np.int64)
    left: list[list[np.ndarray]] = [[] for _ in range(top)]
    starts: list[list[np.ndarray]] = [[] for _ in range(top)]
    _spread(lms, text[lms], starts)
    if not is_s[n - 1]:
        left[text[n - 1]].append(np.array([n - 1]))
    large: list[np.ndarray] = [empty] * top
    for c in alphabet.tolist():
        layer, done = np.concatenate(left[c]) if left[c] else empty, []
        while len(layer):
            done.append(layer)
            before = layer[layer > 0] - 1
            before = before[~is_s[before]]
            symbols = text[before]
            _spread(before[symbols > c], symbols[symbols > c], left)
            layer = before[symbols == c]
        large[c] = np.concatenate(done) if done else empty
        if starts[c]:
            before = np.concatenate(starts[c])
            before = before[before > 0] - 1
            before = before[~is_s[before]]
            _spread(before, text[before], left)
    right: list[list[np.ndarray]] = [[] for _ in range(top)]
    parts: list[np.ndarray] = []
    for c in alphabet[::-1].tolist():
        layer, done = np.concatenate(right[c]) if right[c] else empty, []
        while len(layer):
            done.append(layer)
            before = layer[layer > 0] - 1
            before = before[is_s[before]]
            symbols = text[before]
            _spread(before[symbols < c], symbols[symbols < c], right)
            layer = before[symbols == c]
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[is_s[before]]
        _spread(before, text[before], right)
        parts += [np.concatenate(done)[::-1] if done else empty, large[c]]
    return np.concatenate(parts[::-1])


def _is_s(text: np.ndarray) -> np.ndarray:
    """Suffixes that are smaller than the next one; the last one is larger than the empty one."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(differs, np.arange(n - 1))
    known = after < len(differs)
    out = np.zeros(n, bool)
    at = differs[after[known]]
    out[: n - 1][known] = text[at] < text[at + 1]
    return out


def _names(text: np.ndarray, ordered: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of the sorted LMS substrings, equal for equal ones; ``ends`` is the last index of each."""
    a, b = ordered[:-1], ordered[1:]
    size = ends - ordered
    same = size[1:] == size[:-1]
    active, j = np.flatnonzero(same), 0
    while len(active):
        ok = text[a[active] + j] == text[b[active] + j]
        same[active[~ok]] = False
        active = active[ok]
        j += 1
        active = active[size[1:][active] >= j]
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in order; symbols are small non-negative integers."""
    text = text.astype(np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    alphabet, is_s = np.unique(text), _is_s(text)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(lms):
        return _induce(text, is_s, lms, alphabet)
    ends = np.concatenate([lms[1:], [n - 1]])  # the last one ends with the text: no other substring has its end
    mark = np.zeros(n, bool)
    mark[lms] = True
    rough = _induce(text, is_s, lms, alphabet)
    ordered = rough[mark[rough]]
    end_of = np.zeros(n, np.int64)
    end_of[lms] = ends
    size = end_of[ordered]
    size[ordered == lms[-1]] += n  # a length of its own
    name = np.zeros(n, np.int64)
    name[ordered] = _names_safe(text, ordered, size, n)
    order = _sort_reduced(name[lms])
    return _induce(text, is_s, lms[order], alphabet)


def _names_safe(text: np.ndarray, ordered: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    padded = np.concatenate([text, np.full(1, -1)])
    return _names(padded, ordered, ends) if len(ordered) > 1 else np.zeros(len(ordered), np.int64)


def _sort_reduced(names: np.ndarray) -> np.ndarray:
    """The order of the reduced string's suffixes, by doubling: stretches of names get ranks, then pairs of neighbouring stretches, until all differ."""
    m = len(names)
    rank, reach = names, 1
    while True:
        behind = np.zeros(m, np.int64)
        if reach < m:
            behind[: m - reach] = rank[reach:] + 1
        key = rank * (m + 1) + behind
        if m < 1 << 20:  # key and place fit into one number
            both = np.sort(key.astype(np.uint64) << np.uint64(20) | np.arange(m, dtype=np.uint64))
            order, ordered = (both & np.uint64((1 << 20) - 1)).astype(np.int64), both >> np.uint64(20)
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        fresh = ordered[1:] != ordered[:-1]
        rank = np.zeros(m, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(fresh)])
        if fresh.all():
            return order
        reach *= 2


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """By text position: how long a prefix its suffix shares with the one before it in the order, up to ``limit``."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.int64), np.full(limit + 1, -1)])
    out = np.zeros(n, np.int64)
    active = np.flatnonzero(before >= 0)
    wide = np.zeros(len(padded), np.uint64)
    for j in range(8):  # eight symbols in one number; symbols are below 255
        wide[: len(padded) - j] = wide[: len(padded) - j] << np.uint64(8) | (padded[j:] + 1).astype(np.uint64)
    j = 0
    while len(active) and j + 8 <= limit:
        ok = wide[active + j] == wide[np.minimum(before[active] + j, n)]
        ok &= before[active] + j < n
        out[active[ok]] = j + 8
        rest = active[~ok]
        _finish(padded, before, out, rest, j, 8, n)
        active, j = active[ok], j + 8
    _finish(padded, before, out, active, j, limit - j, n)
    return out


def _finish(padded: np.ndarray, before: np.ndarray, out: np.ndarray, active: np.ndarray, j: int, most: int, n: int) -> None:
    for k in range(j, j + most):
        if not len(active):
            return
        left, right = active + k, before[active] + k
        ok = (left < n) & (right < n)
        ok[ok] = padded[left[ok]] == padded[right[ok]]
        active = active[ok]
        out[active] = k + 1
