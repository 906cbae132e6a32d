"""Linear suffix sorting by Lyndon-prefix groups.

Suffixes are grouped by their longest Lyndon prefix. Groups are closed from
the greatest down: each member of a closing group extends the prefix of its
*previous smaller* suffix, so those suffixes move to higher groups, ordered by
how many members they received. Pointers to previous smaller suffixes are
found by walking over those of higher groups, whose pointers are shortened as
they are passed; a member that is met before its own turn is done first, so no
group is ever sorted and every step is paid for once. When all groups are closed, a second pass
emits the order: a suffix is its Lyndon prefix followed by its next smaller
suffix, so within a group suffixes follow the order in which their next
smaller suffixes are emitted. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

UNSET = -2


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (integers of at least 0) in ascending order; the empty one is left out."""
    if len(symbols) == 0:
        return np.zeros(0, np.int64)
    text = np.append(np.asarray(symbols, np.int64) + 1, 0)
    n = len(text)
    by_symbol = np.argsort(text, kind="stable")
    ordered = text[by_symbol]
    opens = np.append(True, ordered[1:] != ordered[:-1])
    start_of_slot = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    start = np.empty(n, np.int64)
    start[by_symbol] = start_of_slot
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    slots, group, at = by_symbol.tolist(), start.tolist(), place.tolist()
    size = np.bincount(start_of_slot, minlength=n).tolist()
    smaller, jump = [UNSET] * n, [UNSET] * n  # previous smaller suffix; the same, shortened as later groups skip more

    end = n
    while end > 0:
        first = group[slots[end - 1]]
        members = slots[first:end]
        end = first
        found = []
        for member in members:
            if jump[member] != UNSET:
                continue
            waiting = [member]
            while waiting:
                i = waiting[-1]
                j = i - 1
                if j >= 0 and group[j] >= first:
                    passed = []
                    while j >= 0 and group[j] >= first and jump[j] != UNSET:
                        passed.append(j)
                        j = jump[j]
                    for k in passed:
                        jump[k] = j
                    if j >= 0 and group[j] >= first:  # a member that hasn't had its turn
                        waiting.append(j)
                        continue
                waiting.pop()
                smaller[i] = jump[i] = j
                if j >= 0:
                    found.append(j)
        if not found:
            continue
        if len(found) == 1:
            levels = [found]
        else:
            got = Counter(found)
            if len(got) == len(found):
                levels = [found]
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in got.items():
                    by_count.setdefault(c, []).append(p)
                levels = [by_count[c] for c in sorted(by_count, reverse=True)]
        for parents in levels:
            for p in parents:
                g = group[p]
                last = size[g] = size[g] - 1
                last += g
                here, other = at[p], slots[last]
                slots[here], slots[last] = other, p
                at[other], at[p] = here, last
            for p in parents:
                g = group[p]
                new = g + size[g]
                group[p] = new
            for p in parents:
                size[group[p]] += 1

    order, free, emitted = [0] * n, {}, bytearray(n)
    order[0] = n - 1
    emitted[n - 1] = 1
    free = list(range(n))
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not emitted[i]:
            emitted[i] = 1
            g = group[i]
            order[free[g]] = i
            free[g] += 1
            i = smaller[i]
    return np.array(order[1:], np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in ``order``, at most ``most`` and each one's ``room``."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    limit = np.minimum(np.minimum(room[a], room[b]), most)
    alive = np.arange(len(b))
    for k in range(most):
        alive = alive[limit[alive] > k]
        alive = alive[symbols[a[alive] + k] == symbols[b[alive] + k]]
        if not len(alive):
            break
        lcp[alive + 1] += 1
    return lcp
