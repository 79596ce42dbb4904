"""The forest on counted cells against rows, brute force and pyspark.ml's."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from airgrid.operators import forest
from airgrid.operators import models as m

NAMES = ["a", "b", "c", "d"]


def entropy(y):
    p = np.bincount(y) / len(y)
    return -sum(q * np.log2(q) for q in p if q)


def test_a_tree_of_counts_is_the_tree_of_rows_and_its_first_split_gains_most():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (900, 3))
    y = ((x[:, 0] * x[:, 1] > 7) + (rng.random(900) < 0.2)).astype(int)
    cell, at, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
    counts = np.zeros((len(cell), 3))
    np.add.at(counts, (of.ravel(), y), 1)
    rows = forest.grow(x, np.eye(3)[y], [6] * 3, 6, 3, np.random.default_rng(1))
    cells = forest.grow(cell, counts, [6] * 3, 6, 3, np.random.default_rng(1))
    assert all((a == b).all() for a, b in zip(rows, cells)) and len(cells[0]) > 15
    gains = {(f, s): entropy(y) - sum(entropy(y[k]) * k.mean() for k in (x[:, f] <= s, x[:, f] > s)) for f in range(3) for s in range(5)}
    assert abs(gains[cells[0][0], cells[1][0]] - max(gains.values())) < 1e-12
    stats = cells[3]
    got = forest.votes((*cells[:3], stats / stats.sum(1, keepdims=True)), cell)
    assert np.allclose(got.sum(1), 1) and (got.argmax(1) == counts.argmax(1)).mean() > 0.8


def test_the_forest_counts_rows_and_predicts_as_the_library_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(-1, 1, (6000, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (rng.random(6000) < 0.2)
    rows = [(*map(float, v), float(w), i % 3) for i, (v, w) in enumerate(zip(x, y))] + [(None, 1.0, 1.0, 1.0, 0.0, 0), (1.0, float("nan"), 1.0, 1.0, 0.0, 1), (99.0, -99.0, 99.0, 0.0, 1.0, 0)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int").cache()
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    library = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="skip"), RandomForestClassifier(labelCol="y", numTrees=30, maxDepth=6, impurity="entropy", seed=7)]).fit(train).transform(test)

    def read(got):
        return np.array([[r.y, r.prediction, *r.probability, sum(r.rawPrediction)] for r in got.select("y", "prediction", "probability", "rawPrediction").collect()])

    want = read(library)
    few = m.forest_classifier(NAMES, "y", 30, 6)
    few.getStages()[-1].most = 10
    assert (read(few.fit(train).transform(test)) == want).all()  # too many cells: the library reads the rows
    monkeypatch.setattr(forest, "RandomForestClassifier", None)
    got, again = (m.forest_classifier(NAMES, "y", 30, 6).fit(rows).transform(test) for rows in (train, train.repartition(7)))
    assert got.columns == library.columns
    got, again = read(got), read(again)
    assert got.shape == want.shape and (got == again).all()
    assert np.allclose(got[:, 2:5].sum(1), 1) and np.allclose(got[:, 5], 30)
    assert abs((got[:, 0] == got[:, 1]).mean() - (want[:, 0] == want[:, 1]).mean()) < 0.02
    assert (got[:, 1] == want[:, 1]).mean() > 0.95 and np.abs(got[:, 2:5] - want[:, 2:5]).mean() < 0.05


def test_a_tree_of_sums_is_the_tree_of_rows_and_its_first_split_takes_most_variance():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (900, 3))
    y = np.round(x[:, 0] * x[:, 1] + rng.normal(size=900), 1) * 8  # sums are exact
    cell, of = np.unique(x, axis=0, return_inverse=True)
    sums = np.zeros((len(cell), 2))
    np.add.at(sums, of.ravel(), np.stack([np.ones(900), y], 1))
    rows = forest.grow(x, np.stack([np.ones(900), y], 1), [6] * 3, 6, 3, np.random.default_rng(1), forest._square)
    cells = forest.grow(cell, sums, [6] * 3, 6, 3, np.random.default_rng(1), forest._square)
    assert all(np.allclose(a, b) for a, b in zip(rows, cells)) and len(cells[0]) > 15
    gains = {(f, s): y.var() - sum(y[k].var() * k.mean() for k in (x[:, f] <= s, x[:, f] > s)) for f in range(3) for s in range(5)}
    assert abs(gains[cells[0][0], cells[1][0]] - max(gains.values())) < 1e-9
    says = forest.votes((*cells[:3], cells[3][:, 1] / cells[3][:, 0]), x)
    assert ((y - says) ** 2).mean() < 0.2 * y.var()
    same = forest.grow(cell, sums[:, :1] * [1, 0.1], [6] * 3, 6, 3, np.random.default_rng(1), forest._square)
    assert len(same[0]) == 1  # equal labels are not split


def test_folds_are_trained_on_sums_and_predict_as_the_library_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(-1, 1, (6000, 4)), 1)
    y = np.round(1000 + 3 * x[:, 0] + 2 * x[:, 1] * x[:, 2] + 0.5 * rng.normal(size=6000), 2)
    rows = [(i, *map(float, v), float(w), i % 3) for i, (v, w) in enumerate(zip(x, y))]
    rows += [(6000, None, 1.0, 1.0, 1.0, 0.0, 0), (6001, 1.0, float("nan"), 1.0, 1.0, 0.0, 1), (6002, 1.0, 0.0, 0.0, 0.0, 1003.0, 2), (6003, 1.0, 0.0, 0.0, 0.0, 1003.0, 2)]
    d = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, fold int").cache()

    def read(got):
        return np.array(sorted([r.id, r.y, r.prediction] for r in got.select("id", "y", "prediction").collect()))

    few = m.forest_regressor(NAMES, "y", 30, 6)
    library = Pipeline(stages=[few.getStages()[0], RandomForestRegressor(labelCol="y", numTrees=30, maxDepth=6, seed=7)])
    want = read(m.out_of_fold(d, library, 3))
    few.getStages()[-1].most = 10
    train, test = d.filter("fold <> 0"), d.filter("fold = 0")
    assert (read(few.fit(train).transform(test)) == read(library.fit(train).transform(test))).all()  # too large a grid: the library reads the rows
    for module in (m, forest):
        monkeypatch.setattr(module, "RandomForestRegressor", None)
    out = m.out_of_fold(d, m.forest_regressor(NAMES, "y", 30, 6), 3)
    assert out.columns == [*d.columns, "prediction"]
    got, again = read(out), read(m.out_of_fold(d.repartition(7), m.forest_regressor(NAMES, "y", 30, 6), 3))
    assert got.shape == want.shape and (got == again).all() and (got[:, :2] == want[:, :2]).all()
    r2 = [1 - ((k[:, 1] - k[:, 2]) ** 2).sum() / ((k[:, 1] - k[:, 1].mean()) ** 2).sum() for k in (got, want)]
    assert abs(r2[0] - r2[1]) < 0.03 and np.corrcoef(got[:, 2], want[:, 2])[0, 1] > 0.97


def test_a_large_cell_is_dealt_out_and_bad_labels_are_refused(spark, monkeypatch):
    y = np.random.default_rng(1).normal(size=900)
    d = spark.createDataFrame([(1.0, 2.0, float(v)) for v in y] * 2 + [(1.0, 2.0, 5.0)] * 200, "a double, b double, y double")
    mean, spread = np.r_[y, y, [5.0] * 200].mean(), np.r_[y, y, [5.0] * 200].std()
    for part, rows in ((1 << 17, 4096), (100, 7)):
        monkeypatch.setattr(forest, "PART", part)
        monkeypatch.setattr(forest, "ROWS", rows)
        got = {r.prediction for r in m.forest_regressor(["a", "b"], "y", 40, 3).fit(d).transform(d).collect()}
        assert len(got) == 1 and abs(got.pop() - mean) < 5 * spread / np.sqrt(2000 * 40)
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            m.forest_regressor(["a", "b"], "y").fit(d.union(spark.createDataFrame([(1.0, 2.0, bad)], d.schema)))
    with pytest.raises(ValueError, match="no rows"):
        m.forest_regressor(["a", "b"], "y").fit(d.limit(0))
