"""Suffix array by linear grouping (after Baier, 2016), without recursion or renaming.

Phase one groups suffixes by their Lyndon prefix. Groups are taken in descending
order. For each suffix of the group taken, the pointer to the previous smaller suffix
is found along the pointers known so far; the suffixes pointed to have their Lyndon
prefix extended by that of the group, once for each pointer, and move to new groups
right above their old ones, more copies higher up. Phase two places suffixes in
ascending order: once a suffix has its place, those whose Lyndon prefix ends before it
take the next free places of their groups.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order; symbols are positive integers.

    The end of the sequence counts as smaller than any symbol.
    """
    text = [*symbols, 0]
    n = len(text)
    firsts: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        firsts.setdefault(symbol, []).append(i)
    members = [firsts[symbol] for symbol in sorted(firsts)]
    size = [len(m) for m in members]
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    group = [0] * n
    for k, some in enumerate(members):
        for i in some:
            group[i] = k
    previous, done = [-1] * n, bytearray(n)

    current = len(members) - 1
    while current >= 0:
        here = members[current]
        if len(here) > size[current]:
            here = members[current] = [i for i in here if group[i] == current]
        if len(here) > 1:
            here.sort()
            pointers: dict[int, int] = {}
            for i in here:
                p = i - 1
                while p >= 0 and (done[p] or group[p] == current):
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            by_copies: dict[int, dict[int, list[int]]] = {}
            for p, copies in pointers.items():
                by_copies.setdefault(copies, {}).setdefault(group[p], []).append(p)
            for i in here:
                done[i] = 1
            for copies in sorted(by_copies, reverse=True):
                for old, moved in by_copies[copies].items():
                    if len(moved) == size[old]:
                        continue
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                    for p in moved:
                        group[p] = new
        elif here:
            i = here[0]
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            done[i] = 1
            if p >= 0 and size[group[p]] > 1:
                old, new = group[p], len(members)
                members.append([p])
                size.append(1)
                size[old] -= 1
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
                group[p] = new
        current = below[current]

    start, at, k = [0] * len(members), 0, 0
    while k >= 0:
        start[k] = at
        at += size[k]
        k = above[k]
    order, placed = [0] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for i in order:
        j = i - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return order[1:]
