import csv
import json
import os
import random
from collections import Counter

import numpy as np
import pytest

from fieldweave.functions.text import LABELS
from fieldweave.operators import grouping
from fieldweave.operators.grouping import improving_moves, split_rows
from fieldweave.plans.prepare import FILES, check_parameters, prepare
from fieldweave.sources.pairs import read_csv


def write(path, rows, columns=("A", "B", "label")):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([columns, *rows])
    return str(path)


def rows_of(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def chains(n=20):
    out = []
    for k in range(n):
        out += [(f"srcA{k}", f"tgtB{k}", "DIRECT"), (f"tgt-b{k}", f"mid.C{k}", "DERIVATION"), (f"midC{k}", f"end_D{k}", "NO_MATCH")]
    return out


def test_components_stay_whole_and_rows_are_kept(spark, tmp_path):
    source = write(tmp_path / "in.csv", chains())
    report = prepare(spark, source, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted(FILES)
    got = {s: rows_of(tmp_path / "out" / f"{s}.csv") for s in ("train", "validation", "test")}
    assert Counter((r["A"], r["B"], r["label"]) for s in got.values() for r in s) == Counter(chains())
    number = {s: {"".join(c for c in r["A"] if c.isdigit()) for r in own} for s, own in got.items()}
    assert not number["train"] & number["test"] and not number["train"] & number["validation"] and not number["validation"] & number["test"]
    for s, ratio in zip(("train", "validation", "test"), (0.7, 0.15, 0.15), strict=True):
        assert abs(len(got[s]) / 60 - ratio) <= 0.05
        order = [chains().index((r["A"], r["B"], r["label"])) for r in got[s]]
        assert order == sorted(order)
    assert report["connected_components"]["count"] == 20 and report["ready_for_training"]
    first = {n: (tmp_path / "out" / n).read_bytes() for n in FILES}
    prepare(spark, source, str(tmp_path / "out"))
    assert {n: (tmp_path / "out" / n).read_bytes() for n in FILES} == first


def test_audit(spark, tmp_path):
    rows = chains() + [("srcA0", "tgtB0", "DIRECT"), ("srcA1", "tgtB1", " direct "), ("x1", "y1", "DIRECT"), ("X1", "y1", "NO_MATCH"), ("p", "q", "DIRECT"), ("p", "q", "DERIVATION"), ("p", "q", "DIRECT")]
    rows += [("", "b", "DIRECT"), ("a", "b", ""), ("a", "b", "OTHER"), (" _.- ", "b", "DIRECT"), ("", "", "")]
    report = prepare(spark, write(tmp_path / "in.csv", rows), str(tmp_path / "out"))
    q = report["data_quality"]
    assert (q["total_rows"], q["clean_rows"], q["duplicate_rows_removed"], q["conflicting_rows"], q["rejected_rows"]) == (72, 60, 2, 5, 5)
    assert (q["conflicting_raw_pairs"], q["conflicting_normalized_pairs"], q["rows_with_missing_values"]) == (1, 2, 3)
    assert q["missing"] == {"A": 2, "B": 1, "label": 2} and q["invalid_label_counts"] == {"OTHER": 1}
    bad = rows_of(tmp_path / "out" / "rejected_rows.csv")
    assert [r["reason"] for r in bad] == ["missing_A", "missing_label", "invalid_label", "empty_normalized_A", "missing_A;missing_B;missing_label"]
    assert [r["source_row"] for r in bad] == [str(k) for k in range(69, 74)]
    clash = rows_of(tmp_path / "out" / "conflicting_pairs.csv")
    assert [r["conflict_type"] for r in clash] == ["normalized_pair"] * 2 + ["raw_pair"] * 3
    assert json.loads((tmp_path / "out" / "split_statistics.json").read_text()) == report
    assert "# Split report" in (tmp_path / "out" / "split_report.md").read_text()


def test_giant_component_is_not_cut(spark, tmp_path):
    report = prepare(spark, write(tmp_path / "in.csv", [("hub", f"t{k}", LABELS[k % 3]) for k in range(30)]), str(tmp_path / "out"))
    assert report["status"] == "unusable" and sorted(s["rows"] for s in report["splits"].values()) == [0, 0, 30]


def test_quoted_cells_and_extra_columns(spark, tmp_path):
    rows = [('say ""hi""', "line\nbreak", "DIRECT", "no", "x"), ("001_code", "a,b", "NO_MATCH", "yes", "y"), ("c", "d", "DIRECT", "?", "z")]
    path = write(tmp_path / "in.csv", rows, ("A", "B", "label", "synthetic", "extra"))
    got = read_csv(spark, path, ("A", "B")).orderBy("source_row").collect()
    assert [(r.A, r.B, r.source_row) for r in got] == [(a, b, k + 2) for k, (a, b, *_) in enumerate(rows)]
    report = prepare(spark, path, str(tmp_path / "out"))
    assert report["data_quality"]["rejection_reasons"] == {"invalid_synthetic_marker": 1, "synthetic_record": 1}


@pytest.mark.parametrize("columns", [("A", "label"), ("A", "B"), ("B", "label"), ("A", "A", "B", "label")])
def test_bad_headers(spark, tmp_path, columns):
    with pytest.raises(ValueError):
        prepare(spark, write(tmp_path / "in.csv", [["x"] * len(columns)], columns), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_ragged_rows_publish_nothing(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("A,B,label\na,b,DIRECT\na,b\n")
    with pytest.raises(Exception):  # noqa: B017
        prepare(spark, str(path), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_parameters():
    for ratios in ((0.5, 0.5, 0.5), (1.2, -0.1, -0.1), (float("nan"), 0, 1)):
        with pytest.raises(ValueError):
            check_parameters(ratios, (0.4, 0.7))
    with pytest.raises(ValueError):
        check_parameters((0.7, 0.15, 0.15), (0.4, 1.7))


def shares(got):
    sizes = Counter(got.values())
    return {k: n / len(got) for k, n in sizes.items()}


def splits_of(spark, components, ratios=(0.7, 0.15, 0.15), seed=42):
    """components: id, rows of each label."""
    rows = [(c, label) for c, *n in components for label, k in zip(LABELS, n, strict=True) for _ in range(k)]
    got = split_rows(spark.createDataFrame(rows, "component_id long, label string"), ratios, seed).collect()
    assert sorted((r.component_id, r.label) for r in got) == sorted(rows)
    per = {}
    for r in got:
        assert per.setdefault(r.component_id, r.split) == r.split
    return per


def test_each_split_gets_a_component_and_the_seed_decides(spark):
    assert sorted(splits_of(spark, [(k, 1 + k % 4, 0, 0) for k in range(3)]).values()) == ["test", "train", "validation"]
    assert sorted(splits_of(spark, [(0, 900, 0, 0), (1, 40, 0, 0), (2, 1, 1, 0)], (0.98, 0.01, 0.01)).values()) == ["test", "train", "validation"]
    assert len(set(splits_of(spark, [(k, 1, 0, 0) for k in range(4)], (0.9, 0.05, 0.05)).values())) == 3
    many = [(k, 1, 1, 0) for k in range(100)]
    first = splits_of(spark, many, (0.8, 0.2, 0.0), 5)
    assert first == splits_of(spark, many, (0.8, 0.2, 0.0), 5) != splits_of(spark, many, (0.8, 0.2, 0.0), 6)
    assert "test" not in first.values() and abs(shares(first)["train"] - 0.8) <= 0.02


def test_labels_are_balanced_too(spark):
    rng = random.Random(2)
    parts = [(k, *(rng.randrange(0, 9) if rng.random() < 0.5 else 0 for _ in LABELS)) for k in range(300)]
    parts = [p for p in parts if sum(p[1:])]
    got = splits_of(spark, parts)
    for label in range(3):
        whole = sum(p[1 + label] for p in parts)
        for split, ratio in (("train", 0.7), ("validation", 0.15), ("test", 0.15)):
            assert abs(sum(p[1 + label] for p in parts if got[p[0]] == split) / whole - ratio) <= 0.02


def test_very_many_components_follow_the_same_rule(spark):
    many = 200_001  # of two kinds, beside one large one
    rows = spark.range(many).selectExpr("id AS component_id", "IF(id % 3 = 0, 'DIRECT', 'NO_MATCH') AS label")
    rows = rows.union(spark.range(20_000).selectExpr("-1L", "'DERIVATION'"))
    got = split_rows(rows, (0.5, 0.3, 0.2)).toPandas()
    assert len(got) == many + 20_000 and got.groupby("component_id")["split"].nunique().max() == 1
    small = got[got["component_id"] >= 0]
    sizes = got["split"].value_counts(normalize=True)
    assert all(abs(sizes[s] - r) < 0.005 for s, r in (("train", 0.5), ("validation", 0.3), ("test", 0.2)))
    of_kind = small.groupby("label")["split"].value_counts(normalize=True).unstack()
    assert (of_kind.loc["DIRECT"] - of_kind.loc["NO_MATCH"]).abs().max() < 0.005


def test_no_rows_no_splits(spark):
    assert splits_of(spark, []) == {}


def deviation(components, got, ratios, kinds=range(4)):
    """What the improving pass lessens: squared deviations of labels (0 to 2) and of all rows (3), as shares."""
    out = 0.0
    for k in kinds:
        rows = {c: sum(n) if k == 3 else n[k] for c, *n in components}
        for split, ratio in zip(("train", "validation", "test"), ratios, strict=True):
            out += (sum(n for c, n in rows.items() if got[c] == split) / max(1, sum(rows.values())) - ratio) ** 2
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("kind", ["even", "skewed", "large"])
def test_the_improving_pass_lessens_deviations(spark, monkeypatch, seed, kind):
    rng = random.Random(seed)
    if kind == "even":
        parts = [(k, 2, 1, 1) for k in range(40)]
    elif kind == "skewed":  # rare labels, together in few components
        parts = [(k, rng.randrange(1, 6), rng.randrange(40) if rng.random() < 0.1 else 0, rng.randrange(90) if rng.random() < 0.05 else 0) for k in range(120)]
    else:
        parts = [(k, *(rng.randrange(0, 200) for _ in LABELS)) for k in range(12)] + [(k, 1, 0, 0) for k in range(12, 40)]
    ratios = (0.7, 0.15, 0.15)
    after = splits_of(spark, parts, ratios, seed)
    monkeypatch.setattr(grouping, "improving_moves", lambda *a: [])
    before = splits_of(spark, parts, ratios, seed)
    for kinds in ((0,), (1,), (2,), (3,)):
        assert deviation(parts, after, ratios, kinds) <= deviation(parts, before, ratios, kinds) + 1e-9
    assert kind != "skewed" or deviation(parts, after, ratios) < deviation(parts, before, ratios)


def test_moves_keep_every_component_and_split():
    rng = np.random.default_rng(1)
    kinds, count = rng.integers(0, 9, (30, 3)), rng.integers(0, 4, (30, 3))
    after = count.copy()
    for kind, a, b, n in improving_moves(kinds, count, (0.5, 0.3, 0.2)):
        after[kind, a] -= n
        after[kind, b] += n
    assert (after >= 0).all() and (after.sum(axis=1) == count.sum(axis=1)).all() and (after.sum(axis=0) > 0).all()
    assert improving_moves(np.array([[1, 0, 0]]), np.array([[1, 1, 1]]), (1, 0, 0)) == []
    assert improving_moves(np.zeros((0, 3)), np.zeros((0, 3)), (0.7, 0.15, 0.15)) == []


def test_a_garbage_column_of_labels_is_counted(spark, tmp_path, monkeypatch):
    from fieldweave.operators import quality

    monkeypatch.setattr(quality, "REPORTED_LABELS", 2)
    rows = chains(3) + [("a", "b", f"L{k % 7}") for k in range(16)]
    q = prepare(spark, write(tmp_path / "in.csv", rows), str(tmp_path / "out"))["data_quality"]
    assert q["invalid_label_counts"] == {"L0": 3, "L1": 3} and q["other_invalid_labels"] == {"labels": 5, "rows": 10}
