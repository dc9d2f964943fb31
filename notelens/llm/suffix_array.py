"""Suffix arrays by induced sorting, with array operations, and permuted longest common prefixes.

Suffixes are classed as smaller or larger than their right neighbour. The leftmost smaller (LMS)
positions are sorted by inducing their substrings from their first bytes and are named; where names
repeat, the string of names is sorted in turn by the same method. From the sorted LMS suffixes one pass
over the buckets from left to right induces the larger suffixes, and one from right to left the smaller
ones, which is the same pass over the mirrored alphabet. A pass takes several buckets at once, as many
as induce nothing into each other; where buckets are tiny it takes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

FULL = 8  # from so many suffixes a bucket on, buckets are worth an array operation
STEP = 16  # every so many places a common prefix is measured from its start; the others go on from there


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each range, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _spread_singly(t: np.ndarray, allowed: np.ndarray, seeds: np.ndarray, start: np.ndarray, seed_from: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The same pass one suffix at a time, for buckets of a few suffixes each."""
    chars, may, given, begin = t.tolist(), allowed.tolist(), seeds.tolist(), seed_from.tolist()
    head, out = start.tolist(), [0] * int(allowed.sum())
    for bucket in live.tolist():
        done = int(start[bucket])
        while done < head[bucket]:
            p = out[done] - 1
            done += 1
            if p >= 0 and may[p]:
                c = chars[p]
                out[head[c]] = p
                head[c] += 1
        for q in given[begin[bucket] : begin[bucket + 1]]:
            if q and may[q - 1]:
                c = chars[q - 1]
                out[head[c]] = q - 1
                head[c] += 1
    return np.array(out, np.int64)


def _spread(t: np.ndarray, sigma: int, allowed: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The allowed suffixes in order, induced from the seeds, which come in order of their bucket. In each bucket
    what was induced goes before the seeds."""
    size = np.bincount(t[allowed], minlength=sigma)
    start = np.cumsum(size) - size
    seed_from = np.searchsorted(t[seeds], np.arange(sigma + 1))
    live = np.flatnonzero((size > 0) | (np.diff(seed_from) > 0))
    if len(t) < FULL * len(live):
        return _spread_singly(t, allowed, seeds, start, seed_from, live)
    head, out = start.copy(), np.empty(int(size.sum()), np.int64)
    at, width = 0, 1

    def before(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the suffixes have an allowed one in front, those, and their buckets."""
        p = found - 1
        has = np.flatnonzero((p >= 0) & allowed[p])
        p = p[has]
        return has, p, t[p]

    def put(p: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(c, kind="stable")
        c, p = c[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(c)))
        out[head[c] + np.arange(len(c)) - np.repeat(first, n)] = p
        head[c[first]] += n

    while at < len(live):
        some = live[at : at + width]
        if width > 1:
            old, new = head[some] - start[some], seed_from[some + 1] - seed_from[some]
            total = old + new
            offset = np.cumsum(total) - total
            found = np.empty(int(total.sum()), np.int64)
            found[_ranges(offset, old)] = out[_ranges(start[some], old)]
            found[_ranges(offset + old, new)] = seeds[_ranges(seed_from[some], new)]
            has, p, c = before(found)
            inside = c[c <= some[-1]]
            if len(inside):  # a bucket that gets more from here must wait
                some = some[: int(np.searchsorted(some, inside.min()))]
                kept = has < int(total[: len(some)].sum())
                p, c = p[kept], c[kept]
            if len(some):
                put(p, c)
                at += len(some)
                width = 2 * width if not len(inside) else max(1, len(some))
                continue
        bucket = int(live[at])
        done = start[bucket]
        while done < head[bucket]:
            wave, done = out[done : head[bucket]].copy(), int(head[bucket])
            put(*before(wave)[1:])
        if seed_from[bucket + 1] > seed_from[bucket]:
            put(*before(seeds[seed_from[bucket] : seed_from[bucket + 1]])[1:])
        at, width = at + 1, 2
    return out


def _induce(t: np.ndarray, sigma: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array of t (which ends with its one 0) from LMS positions in order."""
    larger = _spread(t, sigma, ~smaller, lms)
    rest = smaller.copy()
    rest[-1] = False  # nothing stands behind the end to induce it
    low = _spread(sigma - 1 - t, sigma, rest, larger[::-1])[::-1]
    n_larger, n_low = np.bincount(t[larger], minlength=sigma), np.bincount(t[low], minlength=sigma)
    first = 1 + np.cumsum(n_larger + n_low) - n_larger - n_low
    sa = np.empty(len(t), np.int64)
    sa[0] = len(t) - 1
    sa[_ranges(first, n_larger)] = larger
    sa[_ranges(first + n_larger, n_low)] = low
    return sa


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Name of each LMS substring in text order, and how many names there are; order: by substring."""
    stop = np.append(lms[1:], lms[-1])
    length = np.empty(len(t), np.int64)
    length[lms] = stop - lms + 1
    a, b = order[:-1], order[1:]
    differ = length[a] != length[b]
    open_ = np.flatnonzero(~differ)
    at = 0
    while len(open_):
        unequal = t[a[open_] + at] != t[b[open_] + at]
        differ[open_[unequal]] = True
        at += 1
        open_ = open_[~unequal]
        open_ = open_[length[a[open_]] > at]
    name = np.empty(len(t), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(differ)])
    return name[lms], int(differ.sum()) + 1


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (bytes or other small numbers) in order."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.append(text.astype(np.int64) + 1, 0)
    return _sorted(t, int(t.max()) + 1)[1:]


def _sorted(t: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t))
    where = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(where[::-1])[::-1]  # the next place whose neighbour differs; there always is one
    smaller = np.append(step[after] > 0, True)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) == 1:
        return _induce(t, sigma, smaller, lms)
    rough = _induce(t, sigma, smaller, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    names, kinds = _names(t, lms, rough[is_lms[rough]])
    order = np.argsort(names) if kinds == len(lms) else _sorted(names, kinds)
    return _induce(t, sigma, smaller, lms[order])


def permuted_lcp(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each start in the text, how far its suffix agrees with the one before it in order, up to cap. A suffix
    agrees at most one place less than the one that starts a place earlier, so most need few comparisons."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.zeros(n, np.uint64)  # eight bytes from each place
    padded = np.concatenate([text.astype(np.uint64), np.zeros(8, np.uint64)])
    for i in range(8):
        words |= padded[i : n + i] << np.uint64(8 * i)

    def agree(own: np.ndarray, done: np.ndarray, most: int) -> np.ndarray:
        """How far these suffixes agree, of which so much is known."""
        known = done.copy()
        limit = np.where(before[own] >= 0, np.minimum(most, n - np.maximum(own, before[own])), 0)
        live = np.flatnonzero(known < limit)
        while len(live):
            x = words[own[live] + known[live]] ^ words[before[own[live]] + known[live]]
            same = x == 0
            low = x & (~x + np.uint64(1))
            step = np.full(len(x), 8, np.int64)
            step[~same] = np.log2(low[~same].astype(np.float64)).astype(np.int64) >> 3
            known[live] = np.minimum(limit[live], known[live] + step)
            live = live[same]
            live = live[known[live] < limit[live]]
        return known

    every = np.arange(0, n, STEP)
    measured = agree(every, np.zeros(len(every), np.int64), cap + STEP)
    least = np.maximum(0, np.repeat(measured, STEP)[:n] - np.arange(n) % STEP)
    plcp = np.minimum(least, cap)
    rest = np.flatnonzero(least < cap)
    plcp[rest] = agree(rest, plcp[rest], cap)
    return plcp
