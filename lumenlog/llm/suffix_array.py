"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix: first by their first symbol, then the groups are taken in descending order, and each
group moves the suffixes that its members' previous-smaller pointers name into a higher group (their prefix grows by
the group's). In ascending order each placed suffix then emits, along the same pointers, the next suffix of each of their
groups. Nothing is renamed and nothing recurses; both phases are linear.
"""

from __future__ import annotations


def lyndon_groups(s) -> tuple[list[int], list[int]]:
    """(group, previous) of each suffix of ``s`` (bytes or integers from 0). A group is named by its first place in the suffix
    array; previous[i] is the last suffix before i in a lower group (-1: none)."""
    n = len(s)
    members: dict[int, list[int]] = {}
    by_symbol: dict[int, list[int]] = {}
    for i, ch in enumerate(s):
        by_symbol.setdefault(ch, []).append(i)
    group, previous = [0] * n, [-1] * n
    size, first_at = {}, [0] * (n + 1)  # first_at[e]: the group whose last place is e
    at = 0
    for ch in sorted(by_symbol):
        own = by_symbol[ch]
        members[at], size[at] = own, len(own)
        for i in own:
            group[i] = at
        at += len(own)
        first_at[at - 1] = at - len(own)
    last = n - 1
    while last >= 0:
        g = first_at[last]
        own = members.pop(g)
        if len(own) != size[g]:
            own = [i for i in own if group[i] == g]
        last = g - 1
        if len(own) == 1:  # most groups
            i = own[0]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = previous[p]
            previous[i] = p
            if p < 0:
                continue
            rounds = ((p,),)
        else:
            own.sort()
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and group[p] >= g:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if not times:
                continue
            if len(times) == 1:
                rounds = (tuple(times),)
            else:  # more repeats of the group's prefix sort higher
                by_times: dict[int, list[int]] = {}
                for p, t in times.items():
                    by_times.setdefault(t, []).append(p)
                rounds = [by_times[t] for t in sorted(by_times, reverse=True)]
        for movers in rounds:
            if len(movers) == 1:
                p = movers[0]
                h = group[p]
                if size[h] > 1:
                    size[h] -= 1
                    new = h + size[h]
                    first_at[new], first_at[new - 1] = new, h
                    size[new], members[new], group[p] = 1, [p], new
                continue
            moved: dict[int, list[int]] = {}
            for p in movers:
                moved.setdefault(group[p], []).append(p)
            for h, ps in moved.items():
                if size[h] > len(ps):
                    size[h] -= len(ps)
                    new = h + size[h]
                    first_at[new + len(ps) - 1], first_at[new - 1] = new, h
                    size[new], members[new] = len(ps), ps
                    for p in ps:
                        group[p] = new
    return group, previous


def suffix_array(s) -> list[int]:
    """The starts of the suffixes of ``s`` in ascending order; a suffix sorts before its extensions."""
    n = len(s)
    group, previous = lyndon_groups(s)
    free, order, placed = list(range(n)), [0] * n, bytearray(n)
    i, j = -1, n - 1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
        i += 1
        if i >= n:
            return order
        j = order[i] - 1
