import json

import numpy as np
import pytest

from fieldweave.cli import main
from fieldweave.config import MatcherConfig
from fieldweave.operators import matching, metrics, model
from fieldweave.operators.model import ModelBundle, random_bundle
from fieldweave.plans.evaluate import evaluate
from fieldweave.sources.pairs import DataValidationError, check_pairs, read_labelled
from tests.test_prepare import rows_of, write

SMALL = MatcherConfig(char_embedding_dim=4, cnn_channels=3, field_embedding_dim=5, classifier_hidden_dim=6, classifier_second_hidden_dim=4, max_length=8, dropout=0.0, embedding_epochs=2, classifier_epochs=2, top_k=3)
TOKENS = ["<PAD>", "<UNK>", *"_abcdefghijklmnopqrstuvwxyz"]


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = model.initial_weights(SMALL, len(TOKENS), 3)
    kernels = SMALL.cnn_kernel_sizes
    a_ids, b_ids = rng.integers(0, len(TOKENS), (4, 8)), rng.integers(0, len(TOKENS), (4, 8))
    y, weight = np.array([0, 1, 2, 0]), np.array([1.0, 0.25, 1.0, 0.5])

    def both(w):
        a, b = model.encode(w, kernels, a_ids), model.encode(w, kernels, b_ids)
        return model.cosine_loss(a, b, y > 0, weight, 0.0)[0] + model.label_loss(model.logits(w, a, b), y, weight)[0]

    kept_a, kept_b, kept = {}, {}, {}
    a, b = model.encode(w, kernels, a_ids, kept_a), model.encode(w, kernels, b_ids, kept_b)
    _, da, db = model.cosine_loss(a, b, y > 0, weight, 0.0)
    _, d = model.label_loss(model.logits(w, a, b, kept), y, weight)
    grads, da2, db2 = model.logits_back(w, kept, d)
    left, right = model.encode_back(w, kernels, kept_a, da + da2), model.encode_back(w, kernels, kept_b, db + db2)
    grads |= {k: left[k] + right[k] for k in left}
    for name, g in grads.items():
        for at in zip(*(rng.integers(0, n, 6) for n in g.shape), strict=True):
            if name == "chars" and at[0] == 0:
                continue
            old = w[name][at]
            w[name][at] = old + 1e-6
            up = both(w)
            w[name][at] = old - 1e-6
            down = both(w)
            w[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5), (name, at)


def test_unit_vectors_and_saved_weights(tmp_path):
    bundle = random_bundle(TOKENS, SMALL)
    v = bundle.encode(np.array([[2, 3, 4, 0, 0, 0, 0, 0], [5, 6, 7, 8, 9, 10, 11, 12]]))
    assert np.allclose((v * v).sum(axis=1), 1)
    bundle.save(tmp_path)
    again = ModelBundle.load(tmp_path)
    assert all((again.weights[k] == x).all() for k, x in bundle.weights.items()) and again.config == SMALL and again.tokens == TOKENS
    assert model.label_map({"0": "NO_MATCH", "1": "DIRECT", "2": "DERIVATION"}) == again.labels
    with pytest.raises(ValueError):
        model.label_map({"DIRECT": 0, "NO_MATCH": 1, "DERIVATION": 2})
    (tmp_path / "vocab.json").unlink()
    with pytest.raises(FileNotFoundError):
        ModelBundle.load(tmp_path)


def test_pairs_and_groups_agree(spark):
    bundle = random_bundle(TOKENS, SMALL)
    pairs = spark.createDataFrame([("userId", "user_id", 1), ("userId", "user_id", 1), ("x", "yz", 2)], "A string, B string, n int")
    got = matching.predict_pairs(bundle, pairs).collect()
    assert len(got) == 3 and all(abs(r.p_no_match + r.p_direct + r.p_derivation - 1) < 1e-5 for r in got)
    source = spark.createDataFrame([(1, "userId"), (2, "User-ID"), (3, "zz")], "source_row long, A string")
    target = spark.createDataFrame([(1, "Ｕser_id"), (2, "user_id"), (3, "other"), (4, "third")], "source_row long, B string")
    results, candidates = (d.orderBy("source_row").collect() for d in matching.match_groups(bundle, source, target, review=0.0, auto=1.0))
    assert [r.source_row for r in results] == [1, 2, 3] and results[0][2:] == results[1][2:]
    assert {c.candidate_B for c in candidates} <= {"Ｕser_id", "other", "third"} and len(candidates) == 9
    pair = spark.createDataFrame([(c.A, c.candidate_B) for c in candidates], "A string, B string")
    own = {(r.A, r.B): r.match_probability for r in matching.predict_pairs(bundle, pair).collect()}
    assert all(own[c.A, c.candidate_B] == pytest.approx(c.match_probability, abs=1e-6) for c in candidates)
    nothing = matching.match_groups(bundle, source, target.limit(0))[0].collect()
    assert [(r.status, r.best_B, r.match_probability, r["rank"]) for r in nothing] == [("NO_MATCH", "", 0.0, 0)] * 3 and all(np.isnan(r.retrieval_similarity) for r in nothing)
    assert matching.match_groups(bundle, source.limit(0), target)[0].count() == 0
    with pytest.raises(ValueError):
        matching.match_groups(bundle, source, target, review=0.9, auto=0.5)


def test_evaluation_of_a_split(spark):
    rows = check_pairs(spark.createDataFrame([("a", "b", "DIRECT", 2, "true"), ("A", "c", "no_match", 3, "TRUE"), ("d", "e", "DERIVATION", 4, "false"), ("f", "b", "NO_MATCH", 5, "true")], "A string, B string, label string, source_row long, group_truth_complete string"), "split")
    report = evaluate(random_bundle(TOKENS, SMALL), rows, ks=(1, 2))
    end = report["end_to_end"]
    assert (end["total_sources"], end["evaluated_sources"], end["known_positive_sources"], end["no_match_only_sources"]) == (3, 2, 2, 1)
    assert report["retrieval"]["candidate_targets"] == 3 and report["retrieval"]["ranking_is_complete"] and report["retrieval"]["Recall@1"] <= report["retrieval"]["Recall@2"]
    assert report["data_summary"]["unique_source_fields"] == 4 and report["pair_classification"]["no_match_metrics_available"]
    with pytest.raises(ValueError):
        evaluate(random_bundle(TOKENS, SMALL), rows, ks=(1, 20), depth=5)


@pytest.mark.parametrize(
    ("rows", "why"),
    [
        ([("", "b", "DIRECT", 2, "true")], "blank"), ([("__", "b", "DIRECT", 2, "true")], "empty after"), ([("a", "b", "X", 2, "true")], "unknown label"), ([], "no rows"),
        ([("a", "b", "DIRECT", 2, "true"), ("A", "b", "NO_MATCH", 3, "true")], "row 3 says NO_MATCH"), ([("a", "b", "DIRECT", 2, "1")], "not one boolean"), ([("a", "b", "DIRECT", 2, "true"), ("a", "c", "DIRECT", 3, "false")], "not one boolean"),
    ],
)
def test_checks_of_a_split(spark, rows, why):
    with pytest.raises(DataValidationError, match=why):
        check_pairs(spark.createDataFrame(rows, "A string, B string, label string, source_row long, group_truth_complete string"), "split")


def test_configuration(tmp_path):
    MatcherConfig().save(tmp_path / "c.json")
    assert MatcherConfig.load(tmp_path / "c.json") == MatcherConfig()
    for bad in ({"seed": -1}, {"seed": True}, {"max_length": 3}, {"dropout": 1.0}, {"review_threshold": 0.99}, {"cnn_kernel_sizes": []}, {"unknown": 1}, {"learning_rate": 0}, {"fine_tune_encoder": 1}, {"synthetic_negative_weight": 0}):
        with pytest.raises(ValueError):
            MatcherConfig.from_dict(bad)


def test_figures(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 0)], "truth int, prediction int")
    got = metrics.classification_metrics(rows)
    assert got["accuracy"] == 0.5 and got["confusion_matrix"] == [[1, 0, 0], [0, 0, 1], [1, 0, 1]]
    assert got["per_class"]["DIRECT"] == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 1}
    ranks = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("c", "x", 1)], "source string, target string, rank int")
    truth = spark.createDataFrame([("a", "y"), ("a", "z"), ("b", "q")], "source string, target string")
    assert metrics.retrieval_metrics(ranks, truth, ks=(1, 2)).first().asDict() == {"evaluated_sources": 2, "recall_at_1": 0.0, "recall_at_2": 0.5, "mrr": 0.25, "skipped_sources": 1}
    none = spark.createDataFrame([("s", False, False, False, False, 0.9)], "source string, positive boolean, target_ok boolean, label_ok boolean, complete boolean, confidence double")
    r = metrics.end_to_end_metrics(none).first()
    assert r.overall_end_to_end_accuracy is None and r.coverage is None and r.unknown_no_match_sources == 1 and r.all_sources_auto_accept_coverage == 0.0
    with pytest.raises(ValueError):
        metrics.threshold_table(none, (1.5,))


def test_the_whole_chain(spark, tmp_path, monkeypatch):
    rows = [(f"user{c}Id", f"usr_{c}_id", "DIRECT") for c in "abcdefghijklmnopqrst"] + [(f"total{c}", f"sum.{c}", "DERIVATION") for c in "abcdefghijklmnopqrst"]
    source = write(tmp_path / "in.csv", rows)
    assert main(["prepare", "--input", source, "--output-dir", str(tmp_path / "d")]) == 0
    assert main(["validate", "--data-dir", str(tmp_path / "d"), "--output", str(tmp_path / "v.json")]) == 0
    SMALL.save(tmp_path / "c.json")
    assert main(["train", "--config", str(tmp_path / "c.json"), "--data-dir", str(tmp_path / "d"), "--artifacts-dir", str(tmp_path / "runs")]) == 0
    (run,) = (tmp_path / "runs").iterdir()
    assert {"config.json", "vocab.json", "label_map.json", "weights.npz", "data_validation.json", "training_history.json", "validation_metrics.json", "test_metrics.json", "training.log"} <= {p.name for p in run.iterdir()}
    history = json.loads((run / "training_history.json").read_text())
    assert history["negatives"].keys() == {"hard", "random"} and history["encoder"][-1]["train_loss"] <= history["encoder"][0]["train_loss"]
    assert main(["evaluate", "--model-dir", str(run), "--data-dir", str(tmp_path / "d"), "--output", str(tmp_path / "e.json")]) == 0
    a, b = write(tmp_path / "a.csv", [("userAId",), ("x",)], ("A",)), write(tmp_path / "b.csv", [("usr_a_id",), ("sum.b",)], ("B",))
    assert main(["match-groups", "--model-dir", str(run), "--source", a, "--target", b, "--output", str(tmp_path / "m.csv"), "--save-candidates", "--threshold", "0", "--auto-accept-threshold", "1"]) == 0
    assert [r["A"] for r in rows_of(tmp_path / "m.csv")] == ["userAId", "x"] and len(rows_of(tmp_path / "m_candidates.csv")) == 4
    assert main(["predict-pairs", "--model-dir", str(run), "--a", "x", "--b", "y"]) == 0
    both = write(tmp_path / "p.csv", [("x", "y"), ("x", "y")], ("A", "B"))
    assert main(["predict-pairs", "--model-dir", str(run), "--input", both, "--output", str(tmp_path / "q.csv")]) == 0 and len(rows_of(tmp_path / "q.csv")) == 2
    assert main(["predict-pairs", "--model-dir", str(run), "--a", "x"]) == 2
    leaking = write(tmp_path / "leak.csv", [("userAId", "usr_a_id", "DIRECT"), *rows[:40]])
    assert main(["train", "--config", str(tmp_path / "c.json"), "--data-dir", str(tmp_path / "d"), "--test", leaking, "--artifacts-dir", str(tmp_path / "none")]) == 2
    assert not (tmp_path / "none").exists()
    with pytest.raises(DataValidationError):
        read_labelled(spark, write(tmp_path / "e.csv", []), "empty")


def test_an_empty_split_is_reported(spark):
    rows = check_pairs(spark.createDataFrame([], "A string, B string, label string, source_row long"), "split", allow_empty=True)
    report = evaluate(random_bundle(TOKENS, SMALL), rows)
    assert report["retrieval"]["evaluated_sources"] == 0 and report["retrieval"]["recall_at_1"] == 0.0 and "empty" in report["end_to_end"]["warning"]
    assert report["end_to_end"]["overall_end_to_end_accuracy"] is None and report["pair_classification"]["accuracy"] == 0.0


def test_training_pairs_are_checked(spark):
    from fieldweave.plans.train import encoded_pairs

    for row, why in ((("a", "b", "X", False), "unknown label"), (("_", "b", "DIRECT", False), "empty name"), (("a", "b", "DIRECT", True), "synthetic")):
        with pytest.raises(DataValidationError, match=why):
            encoded_pairs(spark.createDataFrame([row], "A string, B string, label string, synthetic boolean"), TOKENS, SMALL)
    pairs = encoded_pairs(spark.createDataFrame([("a", "b", "NO_MATCH", True), ("a", "c", "DIRECT", False)], "A string, B string, label string, synthetic boolean"), TOKENS, MatcherConfig(synthetic_negative_weight=0.25))
    assert sorted((r.label, r.weight) for r in pairs.collect()) == [(0, 0.25), (1, 1.0)] and sorted(r.number for r in pairs.collect()) == [0, 1]


def training_frame(spark, n, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, len(TOKENS), (2, n, 8))
    rows = [(k, ids[0, k].tolist(), ids[1, k].tolist(), int(rng.integers(3)), float(rng.choice([1.0, 0.5]))) for k in range(n)]
    return spark.createDataFrame(rows, "number long, a array<int>, b array<int>, label int, weight double")


def as_pairs(df):
    rows = df.orderBy("number").collect()
    return model.Pairs(np.array([r.a for r in rows]), np.array([r.b for r in rows]), np.array([r.label for r in rows]), np.array([r.weight for r in rows]), np.array([r.number for r in rows]))


@pytest.mark.parametrize("fine", [False, True])
def test_tasks_together_learn_what_one_process_learns(spark, fine):
    config = MatcherConfig(**(SMALL.to_dict() | {"dropout": 0.3, "batch_size": 16, "fine_tune_encoder": fine, "embedding_epochs": 3}))
    train, validation = training_frame(spark, 75, 1), training_frame(spark, 20, 2)
    one, losses = model.train_model(as_pairs(train), as_pairs(validation), TOKENS, config)
    for tasks in (1, 4):
        many, found = model.train_on(train, validation.repartition(3), TOKENS, config, tasks)
        assert all(np.allclose(many.weights[k], x, atol=1e-6) for k, x in one.weights.items())
        for phase, history in losses.items():
            assert [list(h.values()) for h in found[phase]] == [pytest.approx(list(h.values()), abs=1e-6) for h in history]
    assert losses["encoder"][-1]["train_loss"] < losses["encoder"][0]["train_loss"]


class Single(model.Alone):
    """In place of the tasks together, where one task has all pairs: no socket is opened."""

    def __init__(self):
        if len(model.BarrierTaskContext.get().getTaskInfos()) > 1:
            raise ValueError("another task has some of the pairs")

    def close(self):
        pass


def test_training_without_validation_pairs(spark):
    config = MatcherConfig(**(SMALL.to_dict() | {"embedding_epochs": 1, "classifier_epochs": 1}))
    train, none = as_pairs(training_frame(spark, 40, 1)), model.Pairs(np.zeros((0, 8), int), np.zeros((0, 8), int), np.zeros(0, int), np.zeros(0), np.zeros(0, int))
    judged, figures = model.train_model(train, as_pairs(training_frame(spark, 20, 2)), TOKENS, config)
    bundle, found = model.train_model(train, none, TOKENS, config)
    assert all((bundle.weights[k] == x).all() for k, x in judged.weights.items())
    for phase, history in figures.items():
        assert found[phase] == [h | {"validation_loss": None, "validation_accuracy": None} for h in history]
    # nothing stops it early, and the last epoch's weights stay
    more = MatcherConfig(**(config.to_dict() | {"embedding_epochs": 6, "early_stopping_patience": 1}))
    last, found = model.train_model(train, none, TOKENS, more)
    assert [h["epoch"] for h in found["encoder"]] == [1, 2, 3, 4, 5, 6] and (last.weights["conv3.w"] != bundle.weights["conv3.w"]).any()
    with pytest.raises(ValueError, match="training pairs"):
        model.train_model(none, train, TOKENS, config)


def test_training_losses_where_one_component_holds_all_rows(spark, tmp_path, monkeypatch):
    from fieldweave.queries import q27_training_losses

    monkeypatch.setattr(model, "Together", Single)
    monkeypatch.setattr(model, "training_tasks", lambda *_: 1)
    parts = [(1, "red bolt", 1), (2, "red bolt", 1), (3, "red bolt", 1), (41, "old ring", 5), (42, "old ring", 5), (82, "hot nut", 7)]
    spark.createDataFrame([(k, n, "Brand#1", "SMALL", z) for k, n, z in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = q27_training_losses(spark, str(tmp_path)).collect()
    assert [(r.phase, r.epoch) for r in rows] == [("encoder", 1), ("classifier", 1)]
    assert all(r.train_loss > 0 and 0 <= r.train_accuracy <= 1 and r.validation_loss is None and r.validation_accuracy is None for r in rows)


def test_pairs_are_dealt_over_the_asked_number_of_tasks(spark, monkeypatch):
    # sessions that raise the counts of repartition() left some pairs to tasks beyond those asked for, or no slots for them
    train, validation = training_frame(spark, 75, 1), training_frame(spark, 20, 2)
    one, _ = model.train_model(as_pairs(train), as_pairs(validation), TOKENS, SMALL)
    monkeypatch.setattr(model, "Together", Single)
    monkeypatch.setattr(type(train), "repartition", lambda self, n, *cols, f=type(train).repartition: f(self, n + 1 if cols else n, *cols))
    found, _ = model.train_on(train, validation, TOKENS, SMALL, 1)
    assert all(np.allclose(found.weights[k], x, atol=1e-6) for k, x in one.weights.items())


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1025])
def test_a_keyed_permutation(n):
    found = model.permuted(np.arange(n), n, 5)
    assert sorted(found.tolist()) == list(range(n))
    assert model.permuted(np.arange(n)[::-1], n, 5).tolist() == found[::-1].tolist()
    assert n < 100 or (found != model.permuted(np.arange(n), n, 6)).mean() > 0.9


def test_dropped_units_and_the_number_of_tasks():
    kept = model.kept_units(np.arange(500), 20, 0.3, 1)
    assert abs((kept == 0).mean() - 0.3) < 0.02 and set(np.unique(kept)) == {0, 1 / 0.7}
    assert (model.kept_units(np.arange(100, 200), 20, 0.3, 1) == kept[100:200]).all()
    assert model.training_tasks(MatcherConfig(), 100, 10_000, 64) == 8 and model.training_tasks(MatcherConfig(batch_size=4096), 100, 10_000, 200) < 64
    assert model.training_tasks(MatcherConfig(), 100, 40_000_000, 64) == 10
    with pytest.raises(ValueError):
        model.training_tasks(MatcherConfig(), 100, 10**9, 64)


def test_pairs_of_wrong_weights_labels_and_lengths(spark):
    good = training_frame(spark, 4, 1)
    for change, why in (("weight", "weights"), ("label", "labels"), ("a", "length")):
        from pyspark.sql import functions as F

        bad = good.withColumn(change, {"weight": F.lit(1.5), "label": F.lit(3), "a": F.array(F.lit(1))}[change])
        with pytest.raises(ValueError, match=why):
            model.train_on(bad, good, TOKENS, SMALL, 1)
    with pytest.raises(ValueError, match="gap"):
        model.label_map({"NO_MATCH": 0, "DIRECT": 1, "DERIVATION": 3})


def test_a_vocabulary_as_an_object(spark, tmp_path):
    from pyspark.sql import functions as F

    from fieldweave import CharVocabulary, Vocabulary

    v = Vocabulary.build(spark.createDataFrame([("ab",), ("b",)], "n string"), "n")
    assert v.itos == ("<PAD>", "<UNK>", "a", "b") and v.stoi["b"] == 3 and len(v) == 4 and Vocabulary is CharVocabulary
    v.save(tmp_path / "v.json")
    assert Vocabulary.load(tmp_path / "v.json").token_to_id == v.token_to_id
    r = spark.createDataFrame([("abz",)], "n string").select(v.encode(F.col("n"), 4).alias("ids")).select("ids", v.decode(F.col("ids")).alias("back")).first()
    assert (r.ids, r.back) == ([2, 3, 1, 0], "ab<UNK>")
    for bad in (["a", "b"], ["<PAD>", "<UNK>", "a", "a"], ["<PAD>", "<UNK>", "ab"]):
        with pytest.raises(ValueError):
            Vocabulary(bad)


def test_public_names():
    import fieldweave

    assert all(getattr(fieldweave, name) is not None for name in fieldweave.__all__) and set(fieldweave.__all__) <= set(dir(fieldweave))
    with pytest.raises(AttributeError):
        fieldweave.nothing  # noqa: B018


@pytest.mark.parametrize("wrong", [{"top_k": "3"}, {"seed": True}, {"dropout": None}, {"fine_tune_encoder": 1}, {"cnn_kernel_sizes": 3}])
def test_settings_of_a_wrong_type(wrong):
    with pytest.raises(TypeError):
        MatcherConfig(**wrong)
