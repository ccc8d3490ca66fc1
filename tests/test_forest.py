"""Forests whose trees are grown in tasks, against brute force."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark.operators import classify, forest
from silvaspark.params import Landscape


def hills(spark, n):
    """Three classes around centres that overlap; one row in 50 lacks a feature."""
    rng = np.random.default_rng(3)
    kind = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 3)) + np.stack([kind * 2.0, (kind == 1) * 2.0, np.zeros(n)], axis=1)
    rows = [(i, int(k) * 10, *map(float, v)) for i, (k, v) in enumerate(zip(kind, x, strict=True))]
    return spark.createDataFrame(rows, "id int, class_id int, u double, v double, w double").withColumn("w", F.when(F.col("id") % 50 > 0, F.col("w")))


@pytest.fixture(scope="module")
def model(spark):
    train = hills(spark, 3000).filter("id % 4 > 0")
    return classify.train_forest(train, ["u", "v", "w"], Landscape(n_estimators=12))


def test_trees_stay_in_the_shared_folder(model):
    assert sorted(r["tree"] for r in model.trees.select("tree").collect()) == list(range(12))
    assert len(pickle.dumps((model.features, model.classes, model.params))) < 1000


def test_votes_are_the_mean_of_the_trees(spark, model):
    rows = hills(spark, 3000).filter("id % 4 = 0")
    found = {r["id"]: (r["prediction"], r["confidence"]) for r in classify.predict(model, rows, ["u", "v", "w"]).collect()}
    trees = [pickle.loads(r["data"]) for r in model.trees.collect()]
    assert len(found) == 750
    right = whole = 0
    for r in rows.collect():
        if r["w"] is None:
            assert found[r["id"]] == (None, None)
            continue
        total = np.zeros(3)
        for t in trees:
            k = 0
            while t["feature"][k] >= 0:
                k = t["left"][k] + (r["uvw"[t["feature"][k]]] > t["limit"][k])
            total += t["share"][k]
        assert found[r["id"]][0] == 10 * total.argmax() and abs(found[r["id"]][1] - total.max() / 12) < 1e-6
        right, whole = right + (found[r["id"]][0] == r["class_id"]), whole + 1
    assert right / whole > 0.8
    assert sum(model.importances()) == pytest.approx(1) and model.importances()[0] > 0.5


def test_splits_lower_the_impurity_most():
    rng = np.random.default_rng(1)
    bins, kind, weights = rng.integers(0, 8, (400, 1)).astype(np.uint8), rng.integers(0, 3, 400), np.array([1.0, 2.0, 0.5])
    kind[bins[:, 0] > 4] = 2
    tree = forest.grow(bins, kind, weights, [np.arange(7.0)], (7, 0), 30, 20)
    times = np.random.default_rng((7, 0)).poisson(1.0, 400)
    sums = lambda on: np.bincount(kind[on], times[on], 3) * weights
    part = lambda s: (s * s).sum() / s.sum()
    gains = [part(sums(bins[:, 0] <= c)) + part(sums(bins[:, 0] > c)) for c in range(7)]
    assert tree["limit"][0] == np.argmax(gains)
    leaf = forest_leaves(tree, bins)
    assert min(times[leaf == k].sum() for k in np.unique(leaf)) >= 20
    for k in np.unique(leaf):
        assert np.allclose(tree["share"][k], sums(leaf == k) / sums(leaf == k).sum(), atol=1e-6)


def forest_leaves(tree, bins):
    out = []
    for value in bins[:, 0]:
        k = 0
        while tree["feature"][k] >= 0:
            k = tree["left"][k] + (value > tree["limit"][k])
        out.append(k)
    return np.array(out)


def test_no_training_rows(spark, model):
    empty = hills(spark, 10).filter("id < 0")
    assert classify.predict(model, empty, ["u", "v", "w"]).count() == 0


@pytest.mark.parametrize("name", ["classification_report", "rf_importance", "confusion_matrix"])
def test_queries_grow_no_trees_on_the_driver(spark, monkeypatch, name):
    from pyspark.ml.classification import RandomForestClassifier

    from silvaspark.plans.catalogue import QUERIES

    monkeypatch.setattr(RandomForestClassifier, "fit", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
