"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix.  Groups are handled in descending order: by then
a group's common prefix is final, and each member hands it to the nearest earlier suffix of a
lower group (its previous smaller suffix), which moves to the upper end of its own group.  When
all groups are done a suffix is its Lyndon prefix followed by its next smaller suffix, so going
through the suffixes in ascending order and appending to each group the ones that continue with
the current suffix puts every group in order; nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> np.ndarray:
    """Starts of the suffixes of a sequence of integers, in ascending order of the suffixes."""
    t = np.asarray(symbols, dtype=np.int64)
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first = np.argsort(t, kind="stable")
    opens = np.flatnonzero(np.concatenate(([True], np.diff(t[first]) != 0)))
    sizes = np.diff(np.append(opens, n))
    start = np.empty(n, dtype=np.int64)
    start[first] = np.repeat(opens, sizes)
    place = np.empty(n, dtype=np.int64)
    place[first] = np.arange(n)
    size_at = np.zeros(n, dtype=np.int64)
    size_at[opens] = sizes
    order, start, place, size_at = first.tolist(), start.tolist(), place.tolist(), size_at.tolist()
    length, smaller = [1] * n, [-1] * n

    end = n
    while end:
        j = order[end - 1]
        low = start[j]
        if end - low == 1:
            p = j - 1
            while p >= 0 and start[p] >= low:
                p = smaller[p]
            smaller[j] = p
            if p >= 0:
                length[p] += length[j]
                g = start[p]
                s = size_at[g] - 1
                if s:
                    size_at[g] = s
                    new = g + s
                    q, at = order[new], place[p]
                    order[at], order[new] = q, p
                    place[q], place[p] = at, new
                    start[p] = new
                    size_at[new] = 1
            end = low
            continue
        heirs: dict[int, int] = {}
        for j in sorted(order[low:end]):
            p = j - 1
            while p >= 0 and start[p] >= low:
                p = smaller[p]
            smaller[j] = p
            if p >= 0:
                heirs[p] = heirs.get(p, 0) + 1
        shared = length[j]
        classes: dict[int, list[int]] = {}
        for p, k in heirs.items():
            classes.setdefault(k, []).append(p)
            length[p] += k * shared
        # More copies of the prefix sort higher, so they take the upper end first.
        for k in sorted(classes, reverse=True):
            left: dict[int, int] = {}
            for p in classes[k]:
                g = start[p]
                s = size_at[g] - 1
                size_at[g] = s
                new = g + s
                q, at = order[new], place[p]
                order[at], order[new] = q, p
                place[q], place[p] = at, new
                left[g] = left.get(g, 0) + 1
            opened = {g: g + size_at[g] for g in left}
            for p in classes[k]:
                start[p] = opened[start[p]]
            for g, m in left.items():
                size_at[opened[g]] = m
        end = low

    follows = np.arange(n) + np.asarray(length)
    by_next = np.argsort(follows, kind="stable")
    edge = np.searchsorted(follows[by_next], np.arange(n + 2)).tolist()
    by_next = by_next.tolist()
    fill, out, s = list(start), [0] * n, n
    slot = list(range(n))
    for i in range(n):
        for k in range(edge[s], edge[s + 1]):
            j = by_next[k]
            g = fill[j]
            out[slot[g]] = j
            slot[g] += 1
        s = out[i]
    return np.asarray(out, dtype=np.int64)
