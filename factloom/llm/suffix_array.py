"""Suffix arrays by induced sorting, and permuted common prefixes, for the shards of operator 4.

Induced sorting (Nong, Zhang and Chan, 2009): suffixes are classified, the leftmost-smaller
substrings sorted and named, the string of their names sorted by recursion whatever the number of
names, and everything induced from that. On the bytes whole buckets are induced at a time with a
few array operations; the strings of names below have many small buckets and go suffix by suffix.
Both are linear.
"""

from __future__ import annotations

import numpy as np

#: Suffixes a bucket, on average, from which whole buckets are induced at once and not suffix by suffix.
FULL = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes (smaller than the suffix after them); the last is S."""
    n = len(s)
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    less[-1] = 1
    at = np.where(less != 0, np.arange(n), n)
    return less[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _append(pending: list[list[np.ndarray]], s: np.ndarray, p: np.ndarray) -> None:
    """Puts the suffixes p, in order, at the end of their characters' lists."""
    if not len(p):
        return
    c = s[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.concatenate([[0], (c[1:] != c[:-1]).nonzero()[0] + 1, [len(c)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        pending[c[a]].append(p[a:b])


def _bucket(start: list[np.ndarray], s: np.ndarray, c: int, stype: np.ndarray, want: bool) -> np.ndarray:
    """A bucket's suffixes with those it induces into itself (runs of one character)."""
    parts, now = list(start), np.concatenate(start) if start else np.empty(0, np.int64)
    while len(now):
        p = now[now > 0] - 1
        now = p[(s[p] == c) & (stype[p] == want)]
        if len(now):
            parts.append(now)
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _induce(s: np.ndarray, size: int, lms: np.ndarray, stype: np.ndarray) -> np.ndarray:
    """All suffixes sorted, from the LMS suffixes (or substrings) in sorted order."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _append(seeds, s, lms)
    pending: list[list[np.ndarray]] = [[] for _ in range(size)]
    larger: list[np.ndarray] = []
    for c in range(size):
        own = _bucket(pending[c], s, c, stype, False)
        larger.append(own)
        scan = np.concatenate([own, *seeds[c]])
        p = scan[scan > 0] - 1
        _append(pending, s, p[~stype[p] & (s[p] > c)])
    pending = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        own = _bucket(pending[c], s, c, stype, True) if c else np.array([len(s) - 1])
        out += [own, larger[c][::-1]]
        scan = np.concatenate(out[-2:])
        p = scan[scan > 0] - 1
        _append(pending, s, p[stype[p] & (s[p] < c)])
    return np.concatenate(out)[::-1]


def _induce_each(s: np.ndarray, size: int, lms: np.ndarray, stype: np.ndarray) -> np.ndarray:
    """What _induce gives, one suffix at a time: for strings whose buckets hold few suffixes each."""
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    # Characters of one type, -1 for the other; none comes before suffix 0, which also fills empty places.
    larger, smaller = np.where(stype, -1, s), np.where(stype, s, -1)
    larger[-1] = smaller[-1] = -1
    larger, smaller, out = larger.tolist(), smaller.tolist(), [0] * len(s)
    at = tails.copy()
    for p, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist()):
        at[c] -= 1
        out[at[c]] = p
    for q in out:  # sees what was put further on
        c = larger[q - 1]
        if c >= 0:
            out[heads[c]] = q - 1
            heads[c] += 1
    for q in reversed(out):
        c = smaller[q - 1]
        if c >= 0:
            tails[c] -= 1
            out[tails[c]] = q - 1
    return np.array(out, np.int64)


def _sort(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of s, whose last character is its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _induce if n >= FULL * size else _induce_each
    stype = _types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = stype[1:] & ~stype[:-1]
    lms = is_lms.nonzero()[0]
    # Sort the LMS substrings and name them.
    first = induce(s, size, lms, stype)
    ordered = first[is_lms[first]]
    end = np.empty(n, np.int64)
    end[lms] = np.append(lms[1:], n - 1)
    length = end[ordered] - ordered
    same = np.concatenate([[False], length[1:] == length[:-1]])
    same[0] = False
    open_, t = same.nonzero()[0], 0
    while len(open_):
        equal = s[ordered[open_ - 1] + t] == s[ordered[open_] + t]
        same[open_[~equal]] = False
        open_ = open_[equal]
        open_ = open_[length[open_] > t]
        t += 1
    name = np.cumsum(~same) - 1
    if name[-1] + 1 < len(lms):
        named = np.empty(n, np.int64)
        named[ordered] = name
        ordered = lms[_sort(named[lms], int(name[-1]) + 1)]
    return induce(s, size, ordered, stype)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffix array of a byte string."""
    if not len(data):
        return np.empty(0, np.int64)
    s = np.append(data.astype(np.int32) + 1, 0).astype(np.int32)
    return _sort(s, 257)[1:]


def permuted_lcp(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each text position the common prefix with the suffix before it in `sa`, up to `limit`.

    Of two neighbours in the text the second's value is the first's less one at least, so
    positions are filled from far apart to close by, each starting from what its left neighbour
    implies.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for b in range(8):
        words = words << np.uint64(8) | padded[b : b + n]
    plcp = np.zeros(n, np.int64)
    step = 256
    at = np.arange(0, n, step)
    low = np.zeros(len(at), np.int64)
    while True:
        _extend(words, padded, before, plcp, at, low, limit, n)
        if step == 1:
            return plcp
        step //= 2
        at = np.arange(step, n, 2 * step)
        low = np.maximum(plcp[at - step] - step, 0)


def _extend(words: np.ndarray, padded: np.ndarray, before: np.ndarray, plcp: np.ndarray, at: np.ndarray, low: np.ndarray, limit: int, n: int) -> None:
    has = before[at] >= 0
    at, length = at[has], low[has].copy()
    plcp[at] = length
    other = before[at]
    for wide, table in ((8, words), (1, padded)):
        a, o, l = at, other, plcp[at]
        while len(a):
            ok = (l < limit) & (np.maximum(a, o) + l + wide <= n)
            a, o, l = a[ok], o[ok], l[ok]
            ok = table[a + l] == table[o + l]
            a, o, l = a[ok], o[ok], l[ok] + wide
            plcp[a] = l
    plcp[at] = np.minimum(plcp[at], limit)
