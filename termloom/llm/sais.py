"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified, the substrings between leftmost-smaller positions are
sorted and named, the string of names is sorted by the same function, and the
order of all suffixes is induced from it: at every level, whatever the alphabet.

The scans of induced sorting run over ranges of buckets.  A bucket induces into
itself or into buckets further on in the scan; a range within which nothing
induces anything is done at once, by a few array operations.  A bucket that
induces into itself (a symbol next to itself) is done in waves, each of which
takes what the wave before has put there.
"""

from __future__ import annotations

import numpy as np

#: So few suffixes are put down one by one, which is faster than array operations.
FEW = 24


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last is, before the end)."""
    n = len(s)
    sign = np.zeros(n, np.int8)
    sign[:-1] = np.where(s[:-1] < s[1:], 1, np.where(s[:-1] > s[1:], -1, 0))
    sign[-1] = -1  # the empty suffix after it is the smallest
    at = np.where(sign != 0, np.arange(n), n - 1)
    return sign[np.minimum.accumulate(at[::-1])[::-1]] > 0


def scatter(sa: np.ndarray, chars: np.ndarray, items: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Puts items at the edges of their buckets, in order; step 1 moves edges up, -1 down."""
    order = np.argsort(chars, kind="stable")
    c, x = chars[order], items[order]
    starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    counts = np.append(starts[1:], len(c)) - starts
    within = np.arange(len(c)) - np.repeat(starts, counts)
    if step > 0:
        sa[edge[c] + within] = x
        edge[c[starts]] += counts
    else:
        sa[edge[c] - 1 - within] = x
        edge[c[starts]] -= counts


def buckets_ahead(s: np.ndarray, small: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the first one that it, or one after it, induces into on the
    way up, and the last one that it, or one before it, induces into on the way down."""
    own = ~small[:-1]
    up = np.full(k, k, np.int64)
    np.minimum.at(up, s[1:][own], s[:-1][own].astype(np.int64))
    down = np.full(k, -1, np.int64)
    np.maximum.at(down, s[1:][~own], s[:-1][~own].astype(np.int64))
    return np.minimum.accumulate(up[::-1])[::-1], np.maximum.accumulate(down)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, ends: np.ndarray, ahead: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The order of all suffixes that the given order of leftmost-smaller ones induces."""
    n, k = len(s), len(ends)
    begins = np.append(0, ends[:-1])
    sa = np.full(n, -1, np.int32)
    heads, tails = begins.copy(), ends.copy()
    if len(lms):
        scatter(sa, s[lms[::-1]], lms[::-1], tails, -1)
    scatter(sa, s[-1:], np.array([n - 1], np.int32), heads, 1)
    up, down = (x.tolist() for x in ahead)

    def put(part: np.ndarray, kind: bool, edge: np.ndarray, step: int) -> None:
        if len(part) <= FEW:
            for p in part.tolist():
                if p > 0 and small[p - 1] == kind:
                    c = s[p - 1]
                    sa[edge[c] - (step < 0)] = p - 1
                    edge[c] += step
            return
        before = part[part > 0] - 1
        before = before[small[before] == kind]
        if len(before):
            scatter(sa, s[before], before, edge, step)

    # Larger types, upwards; the leftmost-smaller suffixes stand at the ends of their buckets.
    c = 0
    while c < k:
        if up[c] > c:
            put(sa[begins[c] : ends[up[c] - 1]], False, heads, 1)
            c = up[c]
            continue
        done = begins[c]
        while done < heads[c]:
            part, done = sa[done : heads[c]], heads[c]
            put(part, False, heads, 1)
        put(sa[tails[c] : ends[c]], False, heads, 1)
        c += 1
    # Smaller types, downwards; they take the places of the leftmost-smaller ones too.
    tails, c = ends.copy(), k - 1
    while c >= 0:
        if down[c] < c:
            put(sa[begins[down[c] + 1] : ends[c]][::-1], True, tails, -1)
            c = down[c]
            continue
        done = ends[c]
        while tails[c] < done:
            part, done = sa[tails[c] : done][::-1], tails[c]
            put(part, True, tails, -1)
        put(sa[begins[c] : heads[c]][::-1], True, tails, -1)
        c -= 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of an array of small non-negative integers, in order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    k = int(s.max()) + 1
    s = s.astype(np.uint16 if k < 1 << 16 else np.int32)  # numpy sorts 16 bits by radix
    small = classify(s)
    ends, ahead = np.cumsum(np.bincount(s, minlength=k)), buckets_ahead(s, small, k)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(lms):
        return induce(s, small, lms, ends, ahead)
    # Sort the substrings between leftmost-smaller positions.
    first = induce(s, small, lms[np.argsort(s[lms], kind="stable")], ends, ahead)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # Name them: equal neighbours share a name.
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # the last one ends with the text's end
    a, b = ordered[:-1], ordered[1:]
    la, lb = length[number[a]], length[number[b]]
    same = (la == lb) & (a != lms[-1]) & (b != lms[-1])
    pairs = np.flatnonzero(same)
    if k <= 256 and len(pairs):  # eight symbols at once; what goes on beyond those is compared below
        words = byte_words(s, 0)
        x = words[a[pairs]] ^ words[b[pairs]]
        low = np.minimum(la[pairs], 8).astype(np.uint64) * np.uint64(8)
        differ = (x << (np.uint64(64) - low)) != 0
        same[pairs[differ]] = False
        pairs = pairs[~differ & (la[pairs] > 8)]
    if len(pairs):
        ln = la[pairs]
        offset = np.arange(ln.sum()) - np.repeat(np.cumsum(ln) - ln, ln)
        differ = s[np.repeat(a[pairs], ln) + offset] != s[np.repeat(b[pairs], ln) + offset]
        same[pairs] = ~np.logical_or.reduceat(differ, np.cumsum(ln) - ln)
    names = np.empty(len(lms), np.int32)
    names[number[ordered]] = np.cumsum(np.append(True, ~same)) - 1
    if names[number[ordered[-1]]] == len(lms) - 1:
        return induce(s, small, ordered, ends, ahead)
    return induce(s, small, lms[suffix_array(names)], ends, ahead)


def byte_words(s: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on (and of ``more`` positions beyond the end) as one number, first lowest."""
    padded = np.concatenate([s.astype(np.uint8), np.zeros(more + 16, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(s) + more + 8, 8), (1, 1))).view(np.uint64).ravel()


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, in text order, the bytes (at most ``most``) that its
    suffix shares with the suffix before it in the suffix array."""
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    words = byte_words(s, most)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(phi >= 0)
    other = phi[at]
    for k in range(0, most, 8):
        x = words[at + k] ^ words[other + k]
        gone = x != 0
        if gone.any():
            low = x[gone] & (~x[gone] + np.uint64(1))
            out[at[gone]] += np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
            at, other = at[~gone], other[~gone]
        out[at] += 8
    # A shared prefix ends with the shorter of the two suffixes.
    ok = phi >= 0
    out[ok] = np.minimum(out[ok], n - np.maximum(np.flatnonzero(ok), phi[ok]))
    return np.minimum(out, most)
