"""Suffix sorting by grouping, in linear time.

First, suffixes are put into groups by the prefix that ends before the next smaller suffix, their Lyndon prefix.
Groups start from first characters and are taken from the largest down. For each member the nearest suffix on its left
that stands in a smaller group is its previous smaller suffix; those pointed at by the group leave their own group for
a new one right behind it, those pointed at more often further behind. Pointers of larger groups are final when a
smaller group is taken, so the search jumps along them.

Second, suffixes are put in order within their groups, from the smallest up: a suffix takes the next free place of its
group when the next smaller suffix behind its Lyndon prefix has been placed. Nothing is renamed and no shorter
problem is solved on the way.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(data: Sequence[int]) -> list[int]:
    """Starts of the suffixes of `data` (non-negative integers) in ascending order."""
    text = [x + 1 for x in data] + [0]  # an end that is smaller than everything
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # where a suffix stands in `order`
    group = [0] * n  # the first place of its group
    size = [0] * n  # by first place
    first = 0
    for k, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = k
        place[i], group[i] = k, first
        size[first] += 1
    previous = [-1] * n

    end = n - 1
    while end >= 0:
        first = group[order[end]]
        if first == end:
            j = (i := order[end]) - 1
            while j >= 0 and group[j] >= first:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                _split([j], order, place, group, size)
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[first : end + 1]):
                j = i - 1
                while j >= 0 and group[j] >= first:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_times: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                by_times.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(by_times, reverse=True):
                for leaving in by_times[times].values():
                    _split(leaving, order, place, group, size)
        end = first - 1

    result = [-1] * n
    placed = bytearray(n)
    result[0], placed[n - 1] = n - 1, 1
    filled = [0] * n
    for k in range(n):
        j = result[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[g + filled[g]] = j
            filled[g] += 1
            placed[j] = 1
            j = previous[j]
    return result[1:]


def _split(leaving: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Members of one group move to its end and form a new group there."""
    old = group[leaving[0]]
    m = len(leaving)
    if m == size[old]:
        return
    to = old + size[old]
    size[old] -= m
    new = old + size[old]
    size[new] = m
    for j in leaving:
        to -= 1
        other, at = order[to], place[j]
        order[at], place[other] = other, at
        order[to], place[j] = j, to
        group[j] = new
