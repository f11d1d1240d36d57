"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are smaller ("S") or larger ("L") than their right neighbour. The leftmost S of each run
(LMS) starts a substring that reaches to the next one; if these are sorted, all other suffixes
follow by induction: a scan of the buckets from left to right places the L suffixes, one from right
to left the S suffixes. The substrings are sorted by the same induction, named, and, where names
repeat, the string of names is sorted recursively.

For byte strings a bucket's entries are induced together, as arrays; in the recursion, where
there are many small buckets, one by one.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
SMALL = 512


def types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last symbol is the unique smallest one, and S."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        step = np.sign(s[1:].astype(np.int64) - s[:-1])
        # Equal neighbours are of the type of the next difference.
        at = np.where(step != 0, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return out


def _push(sa: np.ndarray, at: np.ndarray, entries: np.ndarray, symbols: np.ndarray, up: bool
          ) -> None:
    """Put ``entries`` into their symbols' buckets, in order, from ``at`` on (or back from it)."""
    order = np.argsort(symbols, kind="stable")
    symbols, entries = symbols[order], entries[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    counts = np.diff(np.r_[first, len(symbols)])
    rank = np.arange(len(symbols)) - np.repeat(first, counts)
    base = at[symbols]
    sa[base + rank if up else base - 1 - rank] = entries
    at[symbols[first]] += counts if up else -counts


def _induce_arrays(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    n = len(s)
    sizes = np.bincount(s, minlength=k)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of_lms = np.bincount(s[lms], minlength=k)
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    lms_end = np.cumsum(of_lms)
    sa = np.full(n, -1, np.int64)
    head = starts.copy()
    for c in range(k):
        if not sizes[c]:
            continue
        done = starts[c]
        while done < head[c]:
            found = sa[done:head[c]]
            done = int(head[c])
            before = found[found > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _push(sa, head, before, s[before], True)
        found = by_symbol[lms_end[c] - of_lms[c]:lms_end[c]]
        before = found[found > 0] - 1
        if len(before):
            _push(sa, head, before, s[before], True)
    l_end = head  # the L suffixes of a bucket end here
    tail = ends.copy()
    for c in range(k - 1, -1, -1):
        if not sizes[c]:
            continue
        if c == 0:  # the sentinel, which has no smaller symbol before it
            sa[0], tail[0] = n - 1, 0
        done = ends[c]
        while done > tail[c]:
            found = sa[tail[c]:done][::-1]
            done = int(tail[c])
            before = found[found > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _push(sa, tail, before, s[before], False)
        found = sa[starts[c]:l_end[c]][::-1]
        before = found[found > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _push(sa, tail, before, s[before], False)
    return sa


def _induce_each(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    n = len(s)
    sizes = np.bincount(s, minlength=k)
    ends = np.cumsum(sizes)
    text, small = s.tolist(), is_s.tolist()
    sa = [-1] * n
    tail = ends.tolist()
    for i in reversed(lms.tolist()):
        tail[text[i]] -= 1
        sa[tail[text[i]]] = i
    head = (ends - sizes).tolist()
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings (in text order), by their sorted order; and how many."""
    m = len(lms)
    rank = np.empty(len(s), np.int64)
    rank[lms] = np.arange(m)
    length = np.r_[np.diff(lms) + 1, 1]  # the last one is the sentinel alone
    which = rank[ordered]
    a, b = ordered[:-1], ordered[1:]
    la, lb = length[which[:-1]], length[which[1:]]
    differ = la != lb
    open_ = np.flatnonzero(~differ)
    offset = 0
    while len(open_):
        unlike = s[a[open_] + offset] != s[b[open_] + offset]
        differ[open_[unlike]] = True
        offset += 1
        open_ = open_[~unlike]
        open_ = open_[la[open_] > offset]
    name = np.r_[0, np.cumsum(differ)]
    out = np.empty(m, np.int64)
    out[which] = name
    return out, int(name[-1]) + 1


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Of whole numbers below ``k``; the last is 0 and occurs only there."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    is_s = types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _induce_arrays if k <= SMALL else _induce_each
    rough = induce(s, is_s, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names, count = _names(s, lms, ordered)
    if count < len(lms):
        ordered = lms[suffix_array(names, count)]
    return induce(s, is_s, ordered, k)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``text`` (bytes): the suffix before it in the suffix array (-1: none), and
    how much they have in common, up to ``most``. In text order, eight bytes at a time."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    steps = -(-most // 8)
    padded = np.r_[text, np.zeros(8 * steps + 8, np.uint8)]
    eight = np.zeros(n + 8 * steps, np.uint64)
    for i in range(8):
        eight |= padded[i:i + len(eight)].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    open_ = np.flatnonzero(before >= 0)
    for step in range(steps):
        x = eight[open_ + 8 * step] ^ eight[before[open_] + 8 * step]
        same = x == 0
        ended = open_[~same]
        y = x[~same]
        low = (y & (~y + np.uint64(1))).astype(np.float64)
        out[ended] = 8 * step + (np.log2(low).astype(np.int64) >> 3)
        open_ = open_[same]
    out[open_] = most
    return before, np.minimum(out, most)
