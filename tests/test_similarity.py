import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from fieldweave.functions import similarity
from fieldweave.functions.similarity import bounds, most_similar, ratios


def strings(n, letters, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(draw.choice(letters)) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def want(a, b, autojunk):
    return [SequenceMatcher(None, x, y, autojunk=autojunk).ratio() for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("letters", [["ab"], ["abc"], ["abcdefgh_"], ["é😀a", "_"]])
def test_ratios_of_many_pairs_with_ties(letters):
    a, b = strings(25_000, letters, 24, 1), strings(25_000, letters, 24, 2)
    assert ratios(a, b).tolist() == want(a, b, False)
    assert (bounds(a, b) >= ratios(a, b) - 1e-12).all()


@pytest.mark.parametrize("cells", [64, 1 << 15])
def test_popular_characters(monkeypatch, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    a, b = strings(120, ["ab", "abcdefghijklmnopqrstuvwxyz 0123456789", "".join(map(chr, range(200, 400)))], 260, 3), strings(120, ["ab", "abcdefghijklmnopqrstuvwxyz 0123456789", "".join(map(chr, range(200, 400)))], 300, 4)
    b += ["x" * 250, "xy" * 120, "".join(chr(500 + k) for k in range(210)) + "zz"]
    a += ["x" * 20, "yx", "zz" + "".join(chr(500 + k) for k in range(100))]
    assert ratios(a, b, True).tolist() == want(a, b, True)
    assert ratios(a, b, False).tolist() == want(a, b, False)


def test_nothing_and_long_strings():
    assert ratios([], []).tolist() == [] and ratios(["", "a", ""], ["", "", "b"]).tolist() == [1.0, 0.0, 0.0]
    a = strings(1, ["abcde"], 4000, 5)[0] + "tail"
    assert ratios([a], [a[7:]]).tolist() == want([a], [a[7:]], False)


def test_the_most_similar_of_each_group():
    a, b = strings(3000, ["abcd"], 9, 6), strings(3000, ["abcd"], 9, 7)
    group = np.sort(np.random.default_rng(0).integers(0, 90, 3000))
    ratio = want(a, b, False)
    best, found, _ = most_similar(group, a, b, 4)
    expected = [i for g in range(90) for i in sorted(np.flatnonzero(group == g), key=lambda i: (-ratio[i], b[i]))[:4]]
    assert [(group[i], b[i]) for i in best] == [(group[i], b[i]) for i in expected] and found.tolist() == [ratio[i] for i in expected]
    assert len(most_similar(np.zeros(0, np.int64), [], [], 3)[0]) == 0
