"""Suffix sorting by linear grouping.

Suffixes are first grouped by their longest Lyndon prefix: groups are processed in descending order, and each sends the
suffixes its members point to (the nearest one to the left that lies in a smaller group) into new groups right behind
their old ones, those with more pointers further behind. The final order then is read off from left to right with the
same pointers; nothing is renamed and no smaller string is solved on the way.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_order(s: Sequence[int]) -> list[int]:
    """The starts of all suffixes of ``s`` in lexicographic order; the last symbol must be the unique least one."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    group = [0] * n  # the first slot of a suffix's group
    size = [0] * (n + 1)
    at = 0
    for slot, i in enumerate(order):
        if s[i] != s[order[at]]:
            at = slot
        place[i] = slot
        group[i] = at
        size[at] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        if len(members) > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if pointers:
            by_count: dict[int, list[int]] = {}
            for p, c in pointers.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_count[c]:
                    g = group[p]
                    last = g + size[g] - 1
                    size[g] -= 1
                    q, slot = order[last], place[p]
                    order[slot], place[q] = q, slot
                    order[last], place[p] = p, last
                    moved.setdefault(g, []).append(p)
                for g, gone in moved.items():
                    new = g + size[g]
                    for p in gone:
                        group[p] = new
                    size[new] = len(gone)
        end = first
    out = [-1] * n
    free = list(range(n))  # by group: its next slot
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for slot in range(n):
        j = out[slot] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
