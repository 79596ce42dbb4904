"""Trained models over feature tables: trees, nearest neighbours, out-of-fold predictions, search and dense scoring."""

import itertools
import math
import random
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidatorModel
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import CountedForest, CountedRegressor
from .lineage import cut
from .match import candidates, known


def _over(features: list[str], learner: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), learner])


def forest_classifier(features: list[str], label: str, trees: int = 200, depth: int = 12, seed: int = 7) -> Pipeline:
    """Random forest by entropy; rows with a null feature are left out.  ``label`` counts from 0."""
    return _over(features, CountedForest(features, label, trees, depth, seed))


def forest_regressor(features: list[str], label: str, trees: int = 200, depth: int = 12, seed: int = 7) -> Pipeline:
    return _over(features, CountedRegressor(features, label, trees, depth, seed))


def bagged_trees(features: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 7) -> Pipeline:
    """A forest whose trees see all features."""
    return _over(features, RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=seed))


def boosted_trees(features: list[str], label: str, rounds: int = 50, depth: int = 4, seed: int = 7) -> Pipeline:
    return _over(features, GBTRegressor(labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed))


def out_of_fold(df: DataFrame, learner: Pipeline, k: int) -> DataFrame:
    """``df`` (with ``fold`` 0..k-1) and a prediction from the model that didn't see the row's fold."""
    df = cut(df)  # trees read their rows several times; folds are trained beside each other
    with ThreadPool(k) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(lambda i: learner.fit(df.filter(F.col("fold") != i))), range(k))
    parts = [model.transform(df.filter(F.col("fold") == i)) for i, model in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*df.columns, "prediction")


def _searched(df: DataFrame, features: list[str], label: str, maps: list[dict], folds: int, seed: int) -> CrossValidatorModel:
    """The boosted trees of best mean R squared over ``folds`` among ``maps`` (parameter name to value).

    The first rounds of a long boosting are those of a short one, so of ``maps`` that differ in maxIter only the longest is trained;
    all that are trained run beside each other, on rows that are dealt once."""
    learner = boosted_trees(features, label, seed=seed)
    tree = learner.getStages()[-1]
    rows = cut(df.withColumn("__deal", F.floor(F.rand(seed) * folds)))
    maps = [{"maxIter": tree.getMaxIter()} | one for one in maps]
    rest = [tuple(sorted((n, v) for n, v in one.items() if n != "maxIter")) for one in maps]
    longest = {key: max(one["maxIter"] for one, other in zip(maps, rest) if other == key) for key in rest}

    def fit(data: DataFrame, values: dict) -> Model:
        return learner.fit(data, {tree.getParam(n): v for n, v in values.items()})

    def errors(job: tuple) -> list[float]:
        """R squared of each number of rounds."""
        key, i = job
        model = fit(rows.filter(F.col("__deal") != i), dict(key) | {"maxIter": longest[key]})
        left = model.stages[0].transform(rows.filter(F.col("__deal") == i))
        spread = left.agg(F.var_pop(label)).first()[0]
        return [1 - e / spread for e in model.stages[-1].evaluateEachIteration(left, "squared")]

    jobs = [(key, i) for key in longest for i in range(folds)]
    with ThreadPool(min(8, len(jobs))) as pool:
        found = dict(zip(jobs, pool.map(inheritable_thread_target(df.sparkSession)(errors), jobs)))
    means = [sum(found[key, i][one["maxIter"] - 1] for i in range(folds)) / folds for one, key in zip(maps, rest)]
    return CrossValidatorModel(fit(rows.drop("__deal"), maps[means.index(max(means))]), means)


def search_boosted(df: DataFrame, features: list[str], label: str, draws: dict[str, list], folds: int = 3, seed: int = 7) -> Model:
    """The boosted trees of best R squared over the grid of ``draws`` (parameter name to values)."""
    return _searched(df, features, label, [dict(zip(draws, values)) for values in itertools.product(*draws.values())], folds, seed)


def draw(ranges: dict[str, Sequence], n: int, seed: int) -> list[dict]:
    """``n`` different combinations of the ranges' values (all, if there are fewer), drawn by ``seed`` without listing the others."""
    total = math.prod(map(len, ranges.values()))
    out = []
    for place in random.Random(seed).sample(range(total), min(n, total)):
        one = {}
        for name, values in ranges.items():
            place, at = divmod(place, len(values))
            one[name] = values[at]
        out.append(one)
    return out


def search_random(df: DataFrame, features: list[str], label: str, ranges: dict[str, Sequence], draws: int = 30, folds: int = 10, seed: int = 7) -> Model:
    """The boosted trees of best mean R squared over ``folds`` among ``draws`` random combinations of ``ranges`` (parameter name to
    a range or list).  The same seed draws and deals the same."""
    return _searched(df, features, label, draw(ranges, draws, seed), folds, seed)


def knn_regress(train: DataFrame, test: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(id, prediction): mean y of the k rows of ``train`` (id, x, y) nearest to each of ``test`` (id, x), ties by id.
    Test rows with a null feature have a null prediction; such training rows are left out.  For how blocks meet see ``candidates``."""
    lost = test.filter(~known("x")).select("id", F.lit(None).cast("double").alias("prediction"))
    left = test.filter(known("x")).select("id", "x")
    right = train.filter(known("x")).select(F.col("id").alias("at"), F.col("x").alias("y"), F.col("y").alias("value"))
    met = candidates(left, right, k, "id", "at", block, digits=9)
    best = met.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "at", "value"))), 1, k).alias("n"))
    return best.select("id", F.expr("aggregate(n, 0D, (a, e) -> a + e.value) / size(n)").alias("prediction")).union(lost)


def mlp_score(df: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], features: list[str], key: str) -> DataFrame:
    """(key, score): sigmoid layers (weights, bias) and a linear last one of width 1; a null feature gives a null score."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], 1)
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                x = 0.5 * np.tanh(0.5 * x) + 0.5 if i < len(layers) - 1 else x
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(x[:, 0], mask=np.isnan(x[:, 0]))], ["key", "score"])

    return df.select(key, *features).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
