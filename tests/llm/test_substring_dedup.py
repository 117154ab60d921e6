import random
from collections import Counter

import numpy as np
import pytest

from fieldweave.llm import substring_dedup
from fieldweave.llm.bwt import repeated_starts
from fieldweave.llm.substring_dedup import dedup_substrings


def brute_force(texts, least):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + least] for r in raws for i in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if n[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        runs = [(m.start(), m.end()) for m in __import__("re").finditer(b"\1+", bytes(gone))]
        out.append((runs, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


def test_repeated_starts():
    rng = random.Random(1)
    for _ in range(150):
        least, letters = rng.choice([1, 2, 5, 8, 17, 30]), rng.choice([b"ab", b"aaab", bytes(range(256))])
        base = bytes(rng.choices(letters, k=rng.randrange(1, 80)))
        strings = []
        for _ in range(rng.randrange(1, 8)):
            own = bytearray(base)
            own[rng.randrange(len(own))] = rng.choice(letters)
            strings.append(bytes(own)[rng.randrange(0, 9) :] + bytes(rng.choices(letters, k=rng.randrange(0, 9))))
        n = Counter(s[i : i + least] for s in strings for i in range(len(s) - least + 1))
        want = [[i + least <= len(s) and n[s[i : i + least]] > 1 for i in range(len(s))] for s in strings]
        assert [m.tolist() for m in repeated_starts(strings, least)] == want


def texts():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh éß\n", k=n))
    base, passage = text(1500), text(520)
    out = [base, base, base[:700] + "X" + base[701:], base[200:900], text(3000), "", None, "a" * 1000, "a" * 399, "ab" * 700]
    out += [text(rng.randrange(0, 900)) + passage[: rng.randrange(300, 520)] + text(rng.randrange(0, 600)) for _ in range(25)]
    own = list(passage)
    for k in range(40):
        own[rng.randrange(len(own))] = "Z"
        out.append("".join(own) + text(30))
    return out + [text(100) + passage + text(50) + passage, "license " * 200]


@pytest.mark.parametrize(("group", "piece"), [(3000, 1 << 21), (3, 1000)])
def test_against_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    rows = texts()
    df = spark.createDataFrame([(None if k == 4 else k, t, "r", "k") for k, t in enumerate(rows)], "doc_id long, text string, removed string, key string")
    got = {4 if r.doc_id is None else r.doc_id: ([tuple(x) for x in r.removed], bytes(r.kept)) for r in dedup_substrings(df).collect()}
    assert [got[k] for k in range(len(rows))] == brute_force(rows, 400)


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "x" + "y" * 50 + str(list(range(200))))] * 2, "doc_id long, text string")
    assert [bytes(r.kept) for r in dedup_substrings(df).collect()] == [b"", b""]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stretches_cover_all_windows():
    data = np.frombuffer(random.Random(2).randbytes(5000), dtype=np.uint8)
    bounds = np.array([0, 100, 2500, 2900, 5000])
    start, count, lead, _ = substring_dedup.stretches(data, bounds, 400, substring_dedup.Rolling(100))
    windows = [s + i for s, c in zip(start, count, strict=True) for i in range(c)]
    assert windows == [*range(100, 2101), 2500, *range(2900, 4601)]
    assert all(0 <= g - i <= 300 for g, c in zip(lead, count, strict=True) for i in (0, c - 1))


def test_shareable_ranges_hold_every_shared_window():
    rng = random.Random(4)
    for least in (120, 400):
        base = rng.randbytes(2 * least)
        strings, leads = [], []
        for _ in range(12):
            own, lead = bytearray(base), least  # the anchor: 20 bytes from the middle of the base
            for _ in range(rng.randrange(0, 3)):
                at = rng.choice([*range(least), *range(least + 20, 2 * least)])
                own[at] = rng.randrange(256)
            low, high = rng.randrange(0, 60), rng.randrange(2 * least - 60, 2 * least)
            strings.append(bytes(own[low:high]))
            leads.append(lead - low)
        n = Counter((s[i : i + least], lead - i) for s, lead in dict(zip(strings, leads, strict=True)).items() for i in range(max(0, lead + 20 - least), min(lead, len(s) - least) + 1))
        for s, lead, (low, high) in zip(strings, leads, substring_dedup.shareable(strings, leads, least), strict=True):
            shared = [i for i in range(max(0, lead + 20 - least), min(lead, len(s) - least) + 1) if n[s[i : i + least], lead - i] > 1]
            assert all(low <= i and i + least <= high for i in shared)


def test_columns_of_any_name_pass_through(spark):
    text = "".join(random.Random(6).choices("abcdefgh", k=600))
    rows = [(1, text, [1], "k", "p", 5), (2, "é" + text[:450], None, None, None, None), (3, None, [2], "k", "p", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed array<int>, Kept string, __parts string, __key int")
    got = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    assert got[1].asDict() == dict(zip(df.columns, rows[0], strict=True)) | {"text": text[450:]}
    assert (got[2].text, got[2].removed, got[2].Kept) == ("é", None, None) and got[3].text == "" and got[3].removed == [2]


def test_shorter_repeats_are_counted(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_substrings(df, shorter=150).collect()}
    assert [([tuple(x) for x in got[k].removed], bytes(got[k].kept)) for k in range(len(rows))] == brute_force(rows, 400)
    assert [got[k].repeated for k in range(len(rows))] == [sum(j - i for i, j in runs) for runs, _ in brute_force(rows, 150)]
    with pytest.raises(ValueError):
        dedup_substrings(df, shorter=500)
