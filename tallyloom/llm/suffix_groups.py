"""Suffix arrays of small sets of byte strings, by a linear grouping construction without recursion.

Suffixes start in groups by their first byte. Groups are processed in descending order; by then a group holds the
suffixes that begin with one Lyndon word u, the longest Lyndon prefix of each. For each of them the nearest earlier
suffix of a lower group is found along previous-smaller pointers; its Lyndon prefix goes on with u, so it moves behind the
rest of its group, and further the more copies of u follow. Afterwards each group's order is emitted from left to right:
when a suffix is placed, those whose Lyndon prefix ends where it begins are the next of their groups.
"""

from __future__ import annotations

import numpy as np


def _grouped(symbols: np.ndarray, ends: int) -> tuple[list[int], list[int], list[int]]:
    """Suffixes by groups in order, each suffix's group (its start) and its previous-smaller pointer.

    ``symbols`` begin and end with 0, which ends a string and occurs ``ends`` times.
    """
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sizes = np.diff(np.append(heads, len(order)))
    by_order = np.repeat(heads, sizes)
    group_of, place_of = np.empty_like(order), np.empty_like(order)
    group_of[order], place_of[order] = by_order, np.arange(len(order))
    order, group, place, prev = order.tolist(), group_of.tolist(), place_of.tolist(), [-1] * len(order)
    size = [0] * len(order)
    for h, s in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[h] = s

    end = len(order)
    while end > ends:
        at = group[order[end - 1]]
        if end - at == 1:
            i = order[at]
            p = i - 1
            while group[p] >= at:
                p = prev[p]
            prev[i] = p
            g = group[p]
            if g and (s := size[g]) > 1:
                last, k = g + s - 1, place[p]
                q = order[last]
                order[k], place[q], order[last], place[p] = q, k, p, last
                size[g], size[last], group[p] = s - 1, 1, last
        else:
            found: dict[int, int] = {}
            for i in order[at:end]:
                if prev[i] >= 0:
                    continue
                walk = [(i, i - 1)]  # members whose pointer waits for that of an earlier member
                while walk:
                    i, p = walk.pop()
                    while group[p] >= at and (q := prev[p]) >= 0:
                        p = q
                    if group[p] >= at:
                        walk += [(i, p), (p, p - 1)]
                        continue
                    prev[i] = p
                    if group[p]:
                        found[p] = found.get(p, 0) + 1
            levels: dict[int, list[int]] = {}
            for p, n in found.items():
                levels.setdefault(n, []).append(p)
            for level in sorted(levels, reverse=True):  # different counts of the group's members, so few that sorting them is linear in its size
                moved: dict[int, list[int]] = {}
                for p in levels[level]:
                    g = group[p]
                    s = size[g] = size[g] - 1
                    last, k = g + s, place[p]
                    q = order[last]
                    order[k], place[q], order[last], place[p] = q, k, p, last
                    moved.setdefault(g, []).append(p)
                for g, members in moved.items():
                    if s := size[g]:
                        size[g + s] = len(members)
                        for p in members:
                            group[p] = g + s
                    else:
                        size[g] = len(members)
        end = at
    return order, group, prev


def _emitted(order: list[int], group: list[int], prev: list[int], ends: int) -> list[int]:
    """The suffix array, from groups and previous-smaller pointers; the ends of strings come first, in their order."""
    out, following, waiting = [0] * len(order), list(range(len(order))), [True] * len(order)
    out[:ends] = order[:ends]
    for j in order[:ends]:
        waiting[j] = False
    for k in range(len(out)):
        p = out[k] - 1
        while p >= 0 and waiting[p]:
            g = group[p]
            out[following[g]] = p
            following[g] += 1
            waiting[p] = False
            p = prev[p]
    return out


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, as places in the strings laid out with one place before each and one after the last; and
    where each string starts there. A string's end is less than any byte; equal suffixes are in the strings' order."""
    return _sorted(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64))


def _sorted(body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for strings of these sizes that follow each other in ``body``, of any symbols from 0."""
    symbols = np.zeros(len(body) + len(sizes) + 1, np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
    symbols[np.arange(len(body)) + np.repeat(np.arange(len(sizes)) + 1, sizes)] = body.astype(np.int32) + 1
    ends = len(sizes) + 1
    if not len(body):
        return np.zeros(0, np.int64), starts
    return np.array(_emitted(*_grouped(symbols, ends), ends), np.int64)[ends:], starts


def repeated_runs(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of ``length`` bytes within a string, in suffix order: its string, its start there, and the number of
    its run of equal ones."""
    return symbol_runs(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64), length)


def symbol_runs(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeated_runs`` for strings of these sizes that follow each other in ``text``, of any symbols from 0."""
    order, starts = _sorted(text, sizes)
    of = np.searchsorted(starts, order, "right") - 1
    at = order - starts[of]
    full = sizes[of] - at >= length
    of, at = of[full], at[full]
    if not len(of):
        return of, at, of
    begin = (np.cumsum(sizes) - sizes)[of] + at
    new = np.ones(len(of), bool)
    for a in range(0, len(of) - 1, 1 << 14):
        part = text[begin[a : a + (1 << 14) + 1, None] + np.arange(length)]
        new[a + 1 : a + len(part)] = (part[1:] != part[:-1]).any(1)
    return of, at, np.cumsum(new) - 1
