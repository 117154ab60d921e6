"""Ratcliff-Obershelp similarity of many pairs at once, and bounds that tell where it need not be found.

The similarity of a to b is twice the number of characters in their matching blocks over the sum of
their lengths. Blocks: the longest common stretch (the first in a, then the first in b, of equals),
then the same left and right of it. All open stretches of all pairs are searched together, character
by character of a, each step over all places of b; so a pair costs numpy some microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells (pairs times places of b) that a step handles at once; classes of characters in a bound.
CELLS, CLASSES = 1 << 15, 64
#: From so many characters of b on, those of more than one in a hundred (and one more) are popular (fixed values).
POPULAR_FROM, POPULAR_SHARE = 200, 100


class Strings:
    """Code points of many strings, end to end."""

    def __init__(self, each: Sequence[str]):
        self.size = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        self.start = np.cumsum(self.size) - self.size
        self.points = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def take(self, start: np.ndarray, size: np.ndarray, width: int, none: int) -> np.ndarray:
        """Stretches as rows of ``width`` code points; ``none`` stands behind their ends."""
        at = np.arange(width)[None, :]
        inside = at < size[:, None]
        points = self.points if len(self.points) else np.zeros(1, np.uint32)
        return np.where(inside, points[np.minimum(start[:, None] + at, len(points) - 1)].astype(np.int64), none)

    def classes(self) -> np.ndarray:
        """How many characters of each class every string has, a row a string."""
        of = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(of * CLASSES + self.points % CLASSES, minlength=len(self.size) * CLASSES).reshape(-1, CLASSES)


def _popular(b: Strings) -> np.ndarray:
    """Which characters of the strings are too common there to begin a block."""
    out = np.zeros(len(b.points), dtype=bool)
    for k in np.flatnonzero(b.size >= POPULAR_FROM):
        own = slice(b.start[k], b.start[k] + b.size[k])
        _, kind, n = np.unique(b.points[own], return_inverse=True, return_counts=True)
        out[own] = n[kind] > b.size[k] // POPULAR_SHARE + 1
    return out


def _longest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and b: where the longest common stretch starts in both, and its length (three rows)."""
    steps = a.shape[1]
    kind = np.int32 if steps < 1 << 15 else np.int64
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # a place a row, so that a step is whole rows
    # a run of n that ends at i counts as n * (steps + 2) - (i + 1): the longest, then the first, is largest
    best, run = np.zeros(b.shape, dtype=kind), np.zeros((b.shape[0] + 1, b.shape[1]), dtype=kind)
    value, same = np.empty(b.shape, dtype=kind), np.empty(b.shape, dtype=bool)
    for i in range(steps):
        np.equal(b, a[i], out=same)
        run[1:] = run[:-1]
        run[1:] += 1
        run[1:] *= same
        np.multiply(run[1:], steps + 2, out=value)
        value -= i + 1
        np.maximum(best, value, out=best)
    j = best.argmax(axis=0)
    top = best[j, np.arange(b.shape[1])]
    n = -(-top // (steps + 2))
    last = n * (steps + 2) - top - 1
    found = top > 0
    return np.where(found, np.stack((last + 1 - n, j + 1 - n, n)), 0)


def _matched(a: Strings, b: Strings, autojunk: bool) -> np.ndarray:
    total = np.zeros(len(a.size), dtype=np.int64)
    popular = _popular(b) if autojunk and (b.size >= POPULAR_FROM).any() else None
    pair, a_at, a_n, b_at, b_n = np.arange(len(a.size)), a.start, a.size, b.start, b.size
    while len(pair):
        some = (a_n > 0) & (b_n > 0)
        pair, a_at, a_n, b_at, b_n = (x[some] for x in (pair, a_at, a_n, b_at, b_n))
        order = np.argsort(b_n, kind="stable")  # rows of like length are searched together
        pair, a_at, a_n, b_at, b_n = (x[order] for x in (pair, a_at, a_n, b_at, b_n))
        found = [np.zeros((3, 0), dtype=np.int64)]
        low = 0
        while low < len(pair):
            # as many rows as fit at the width of the last of them
            high = low + max(1, int(np.searchsorted(b_n[low:] * np.arange(1, len(pair) - low + 1), CELLS)))
            own = slice(low, high)
            left = a.take(a_at[own], a_n[own], int(a_n[own].max()), -1)
            right = b.take(b_at[own], b_n[own], int(b_n[own].max()), -2)
            if popular is not None:
                at = np.minimum(b_at[own][:, None] + np.arange(right.shape[1])[None, :], len(popular) - 1)
                right = np.where(popular[at], -2, right)
            found.append(_longest(left, right))
            low = high
        i, j, n = np.concatenate(found, axis=1).astype(np.int64)
        if popular is not None:
            i, j, n = _widened(a, b, a_at, a_n, b_at, b_n, i, j, n)
        np.add.at(total, pair, n)
        has = n > 0
        pair, a_at, a_n, b_at, b_n, i, j, n = (x[has] for x in (pair, a_at, a_n, b_at, b_n, i, j, n))
        pair, a_at, b_at = np.concatenate((pair, pair)), np.concatenate((a_at, a_at + i + n)), np.concatenate((b_at, b_at + j + n))
        a_n, b_n = np.concatenate((i, a_n - i - n)), np.concatenate((j, b_n - j - n))
    return total


def _widened(a: Strings, b: Strings, a_at: np.ndarray, a_n: np.ndarray, b_at: np.ndarray, b_n: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks lengthened on both sides by equal characters, popular ones too."""
    i, j, n = i.copy(), j.copy(), n.copy()
    same = lambda x, y: a.points[x] == b.points[y]
    todo = np.flatnonzero((i > 0) & (j > 0))
    while len(todo):
        todo = todo[same(a_at[todo] + i[todo] - 1, b_at[todo] + j[todo] - 1)]
        i[todo], j[todo], n[todo] = i[todo] - 1, j[todo] - 1, n[todo] + 1
        todo = todo[(i[todo] > 0) & (j[todo] > 0)]
    todo = np.arange(len(n))
    while len(todo):
        todo = todo[(i[todo] + n[todo] < a_n[todo]) & (j[todo] + n[todo] < b_n[todo])]
        todo = todo[same(a_at[todo] + i[todo] + n[todo], b_at[todo] + j[todo] + n[todo])]
        n[todo] += 1
    return i, j, n


def ratios(a: Sequence[str], b: Sequence[str], autojunk: bool = False) -> np.ndarray:
    """Similarity of each a to its b (the order matters); two empty strings are 1.

    autojunk: characters that are popular in a b of 200 or more begin no block, but lengthen it.
    """
    left, right = Strings(a), Strings(b)
    whole = left.size + right.size
    return np.where(whole > 0, 2.0 * _matched(left, right, autojunk) / np.maximum(whole, 1), 1.0)


def bounds(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """What the similarity of each a to its b is at most: by the characters, in classes, that both have."""
    left, right = Strings(a), Strings(b)
    whole = left.size + right.size
    out, step = np.ones(len(left.size)), 16_384
    for low in range(0, len(a), step):
        own = slice(low, low + step)
        common = np.minimum(Strings(a[own]).classes(), Strings(b[own]).classes()).sum(axis=1)
        out[own] = np.where(whole[own] > 0, 2.0 * common / np.maximum(whole[own], 1), 1.0)
    return out


def most_similar(group: np.ndarray, a: Sequence[str], b: Sequence[str], k: int, autojunk: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and ratios of the k most similar of each group, best first (ties: b in code-point order), and how many ratios were found.

    group: the group of each row, ascending. Ratios are found by falling bound, as many in a round as
    are wanted, and only while a group's next bound reaches its k-th ratio.
    """
    bound = bounds(a, b)
    order = np.lexsort((-bound, group))
    first = np.searchsorted(group[order], group[order])
    turn = (np.arange(len(order)) - first) // max(k, 1)
    done = np.zeros(0, dtype=np.int64)
    ratio = np.full(len(order), -1.0)
    level = np.full(int(group.max(initial=-1)) + 1, -1.0)
    for r in range(int(turn.max(initial=-1)) + 1):
        own = order[turn == r]
        own = own[bound[own] >= level[group[own]] - 1e-12]
        if not len(own):
            break
        ratio[own] = ratios([a[i] for i in own], [b[i] for i in own], autojunk)
        done = np.concatenate((done, own))
        best = done[np.lexsort((-ratio[done], group[done]))]
        place = np.arange(len(best)) - np.searchsorted(group[best], group[best])
        level[group[best[place == k - 1]]] = ratio[best[place == k - 1]]
    text = np.array([b[i] for i in done], dtype=object)
    rank = np.empty(len(done), dtype=np.int64)
    rank[np.argsort(text, kind="stable")] = np.arange(len(done))
    done_order = np.lexsort((rank, -ratio[done], group[done]))
    best = done[done_order]
    best = best[np.arange(len(best)) - np.searchsorted(group[best], group[best]) < k]
    return best, ratio[best], len(done)
