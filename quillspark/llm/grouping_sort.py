"""Suffix arrays by linear grouping construction (Baier, 2016), for one text or for many short ones side by side.

First, suffixes are grouped by their Lyndon prefix. Groups start as first symbols and are visited from the highest to the
lowest: each member points to the nearest suffix to its left in a lower group (previous smaller), and the suffixes so
pointed at are moved, most pointed at first, into new groups just above their old ones. Second, the order inside
the groups follows in one pass from the smallest suffix up, along the same pointers. There is no recursion and no renaming.

``suffix_array`` visits one group after the other. ``suffix_arrays`` takes the same steps for many texts at once: step k
visits the k-th highest group of each text with array operations, so its cost is shared by all of them.
"""

from __future__ import annotations

import numpy as np

#: Longer texts are sorted alone; a batch of the others has this many bytes.
SHORT, BATCH = 6_000, 300_000


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in order; a suffix comes before those that it begins."""
    n = len(text)
    if not n:
        return []
    counts = [0] * 257
    for c in text:
        counts[c + 1] += 1
    for c in range(256):
        counts[c + 1] += counts[c]
    begin = counts[:256]
    group = [begin[c] for c in text]  # where the suffix's group begins
    size = [0] * (n + 1)
    order, place = [0] * n, [0] * n
    for i, g in enumerate(group):
        at = g + size[g]
        size[g] += 1
        order[at] = i
        place[i] = at
    previous = [-1] * n

    high = n - 1
    while high >= 0:
        g = group[order[high]]
        pointed: dict[int, int] = {}
        members = order[g : high + 1]
        if len(members) > 1:
            members.sort()
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, []).append(j)
            levels = [by_count[t] for t in sorted(by_count, reverse=True)]
        for level in levels:
            if len(level) == 1:
                moved = {group[level[0]]: level}
            else:
                moved = {}
                for j in level:
                    moved.setdefault(group[j], []).append(j)
            for old, js in moved.items():
                left = size[old] - len(js)
                size[old] = left
                if not left:  # the whole group moves: it keeps its place
                    size[old] = len(js)
                    continue
                new = end = old + left
                end += len(js) - 1
                for j in js:  # swap to the end of the old group
                    at, other = place[j], order[end]
                    order[at], order[end] = other, j
                    place[other], place[j] = at, end
                    group[j] = new
                    end -= 1
                size[new] = len(js)
        high = g - 1

    # From the smallest up: whoever stands before a placed suffix is the next of its own group.
    done = [False] * n
    order = [-1] * n
    fill = group  # next free place of a suffix's group, moved on through ``taken``
    taken = [0] * (n + 1)
    j = n - 1
    while j >= 0 and not done[j]:
        g = fill[j]
        order[g + taken[g]] = j
        taken[g] += 1
        done[j] = True
        j = previous[j]
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not done[j]:
            g = fill[j]
            order[g + taken[g]] = j
            taken[g] += 1
            done[j] = True
            j = previous[j]
    return order


def suffix_arrays(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Suffix arrays of many texts: text t is ``data[first[t] : first[t] + length[t]]``, and one byte before it is unused.

    Returns an array of positions of ``data``: the places of text t hold its suffixes in order.
    """
    out = np.full(len(data), -1, np.int64)
    for t in np.flatnonzero(length > SHORT).tolist():
        a, b = int(first[t]), int(first[t] + length[t])
        out[a:b] = np.array(suffix_array(data[a:b].tobytes()), np.int64) + a
    short = np.flatnonzero((length <= SHORT) & (length > 0))
    short = short[np.argsort(-length[short], kind="stable")]  # alike in length, so that they end together
    part = np.cumsum(length[short] + 1) // BATCH
    for k in np.unique(part):
        own = short[part == k]
        n = length[own]
        begin = np.cumsum(n + 1) - n  # a guard before each text
        slots = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        source = slots + np.repeat(first[own] - begin, n)
        order = _side_by_side(data[source], slots, begin, n)
        out[source] = order[slots] + np.repeat(first[own] - begin, n)
    return out


def _side_by_side(symbols: np.ndarray, slots: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``suffix_arrays`` of one batch, texts in descending length; ``slots`` are the places of ``symbols``."""
    n = int(slots[-1]) + 1
    text = np.repeat(np.arange(len(first)), length)
    by_symbol = np.argsort(text * 256 + symbols, kind="stable")
    order, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order[slots] = slots[by_symbol]
    place[order[slots]] = slots
    key = (text * 256 + symbols)[by_symbol]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(key)]]))
    group, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # guards are below every group
    group[order[slots]] = np.repeat(slots[begins], sizes)
    size[slots[begins]] = sizes
    previous, pointed = np.zeros(n, np.int64), np.zeros(n, bool)

    low, high = first, first + length - 1
    while len(high):
        g = group[order[high]]
        count = high - g + 1
        if int(count.sum()) == len(g):
            members, own = order[high], g
        else:
            own = np.repeat(g, count)
            members = order[np.repeat(g - (np.cumsum(count) - count), count) + np.arange(len(own))]
        j = members - 1
        walk = np.flatnonzero(group[j] > own)
        while len(walk):
            to = previous[j[walk]]
            j[walk] = to
            walk = walk[group[to] > own[walk]]
        previous[members] = j
        same = np.flatnonzero(group[j] == own)
        while len(same):  # a member of the same group to the left points where this one does
            to = previous[j[same]]
            j[same] = to
            previous[members[same]] = to
            same = same[group[to] == own[same]]
        target = np.sort(j[group[j] >= 0])
        if len(target):
            begins = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            times = np.diff(np.concatenate([begins, [len(target)]]))
            _raise(target[begins], times, order, place, group, size, pointed)
        going = g - 1 >= low
        low, high = low[going], (g - 1)[going]

    done, taken, order = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    done[first - 1] = True

    def put(j: np.ndarray) -> None:
        while len(j):
            g = group[j]
            order[g + taken[g]] = j
            taken[g] += 1
            done[j] = True
            j = previous[j]
            j = j[~done[j]]

    put(first + length - 1)
    live = len(first) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
    for i, k in enumerate(live.tolist()):
        j = order[first[:k] + i] - 1
        put(j[~done[j]])
    return order


def _raise(p: np.ndarray, times: np.ndarray, order: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, pointed: np.ndarray) -> None:
    """Move the suffixes ``p`` (each once) to the end of their groups, by how often they are pointed at, as new groups."""
    old = group[p]
    by = np.argsort(old * (int(times.max()) + 1) + times, kind="stable")
    p, old, times = p[by], old[by], times[by]
    new_group = np.concatenate([[True], old[1:] != old[:-1]])
    begins = np.flatnonzero(new_group)
    moved = np.diff(np.concatenate([begins, [len(p)]]))
    stay = size[old[begins]] - moved
    edge = old + np.repeat(stay, moved)  # where the movers of the group begin
    to = edge + np.arange(len(p)) - np.repeat(begins, moved)
    classes = np.flatnonzero(new_group | np.concatenate([[True], times[1:] != times[:-1]]))
    members = np.diff(np.concatenate([classes, [len(p)]]))
    pointed[p] = True
    there, was = order[to], place[p]
    displaced, free = there[~pointed[there]], was[was < edge]  # as many of each in every group
    pointed[p] = False
    order[free] = displaced
    place[displaced] = free
    order[to] = p
    place[p] = to
    group[p] = np.repeat(to[classes], members)
    size[old[begins]] = stay
    size[to[classes]] = members
