"""Repeated strings of a minimum length, from a Burrows-Wheeler transform.

The suffixes of several byte strings (none longer than its own string) are sorted by their first
symbols, as many as the minimum length needs. Breadth-first backward extension of intervals then
finds, level by level, the places where neighbouring suffixes share a prefix of exactly that many
symbols; what is left after the last level below the minimum length shares at least that length.
"""

from __future__ import annotations

import numpy as np

#: Symbols that the first sort packs into a key: 7 of 9 bits.
_PACKED = 7


def _unfinished(rank: np.ndarray, slots: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Those of the slots whose suffix shares its rank with another."""
    r = rank[sa[slots]]
    same = np.zeros(len(slots), dtype=bool)
    equal = r[1:] == r[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    return slots[same]


def _suffixes(symbols: np.ndarray, segment: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """Positions sorted by their suffixes' first ``least`` symbols at least.

    symbols: bytes + 1, with a 0 at the end of each string; the ends sort by their string's number.
    left: symbols up to and including the end.
    """
    n = len(symbols)
    key = np.zeros(n, dtype=np.int64)
    for k in range(min(_PACKED, n)):
        here = np.where(left[: n - k] > k, symbols[k:], 0) if k else symbols
        key[: n - k] += here.astype(np.int64) << (9 * (_PACKED - 1 - k))
    ended = left <= _PACKED
    sa = np.lexsort((np.where(ended, segment + 1, 0), key))
    new = np.ones(n, dtype=bool)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | ended[sa][1:] | ended[sa][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots, h = _unfinished(rank, np.arange(n), sa), _PACKED
    while len(slots) and h < least:
        at = sa[slots]
        # a suffix that shares its rank has more than h symbols left, so at + h is in its string
        pair = rank[at] * n + rank[at + h]
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
        sa[slots] = at
        new = np.ones(len(slots), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots, h = _unfinished(rank, slots, sa), 2 * h
    return sa


def repeated_starts(strings: list[bytes], least: int) -> list[np.ndarray]:
    """For each string, a mask of the positions where a substring of ``least`` bytes starts that also
    starts elsewhere in the strings."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    n = int((lengths + 1).sum())
    symbols = np.zeros(n, dtype=np.uint16)
    inside = np.ones(n, dtype=bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8)
    symbols[inside] += 1
    segment = np.repeat(np.arange(len(strings)), lengths + 1)
    left = ends[segment] - np.arange(n) + 1
    sa = _suffixes(symbols, segment, left, least)
    # the transform: the symbol before each suffix, 0 where a string begins (nothing extends there)
    before = np.where(left[sa] == lengths[segment[sa]] + 1, 0, symbols[sa - 1]).astype(np.int64)
    order = np.argsort(before, kind="stable")  # places by symbol: the last-to-first mapping inverted
    first_of = np.searchsorted(before[order], np.arange(258))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    starts = np.searchsorted(symbols[sa], np.arange(258))  # where the suffixes of each first symbol begin
    to = starts[before] + place - first_of[before]
    behind, ahead = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)  # the nearest of the same symbol
    same = before[order][1:] == before[order][:-1]
    behind[order[1:][same]] = order[:-1][same]
    ahead[order[:-1][same]] = order[1:][same]
    usable = before > 0
    known = np.zeros(n + 1, dtype=bool)  # places whose common prefix with the place before is known
    known[0] = known[n] = True
    # level 0: the intervals of single symbols; each end of a string is a symbol of its own
    m = len(strings)
    bounds = np.unique(np.concatenate((np.arange(m), starts[1:][starts[1:] < n], [n])))
    lows, highs = bounds[:-1], bounds[1:] - 1
    known[bounds] = True
    for _ in range(1, least):
        if not len(lows):
            break
        width = highs - lows + 1
        cut = np.cumsum(width)
        own = np.repeat(np.arange(len(lows)), width)
        at = np.arange(cut[-1]) - np.repeat(cut - width, width) + np.repeat(lows, width)
        good = usable[at]
        own, at = own[good], at[good]
        last, first = ahead[at] > highs[own], behind[at] < lows[own]
        # in an interval the first and the last place of each symbol map to the ends of a new interval
        top, bottom = to[at[last]], to[at[first]]
        top = top[np.argsort(own[last] * n + top, kind="stable")]
        bottom = bottom[np.argsort(own[first] * n + bottom, kind="stable")]
        fresh = ~known[top + 1]
        known[top[fresh] + 1] = True
        lows, highs = bottom[fresh], top[fresh]
    shares = ~known
    marked = np.zeros(n, dtype=bool)
    marked[sa] = shares[:-1] | shares[1:]
    return [marked[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
