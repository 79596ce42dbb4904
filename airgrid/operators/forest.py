"""Random forests of classes and of numbers that are grown on counted cells instead of rows."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Bins of a feature, as those of RandomForestClassifier.
BINS = 32
#: Trees whose sums travel together, rows of a cell that one task draws, and cells and rows that it draws at a time.
TREES, PART, CELLS, ROWS = 8, 1 << 17, 512, 4096


def _entropy(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy in bits and sum of class weights (last axis)."""
    total = weight.sum(-1)
    share = weight / np.maximum(total, 1e-300)[..., None]
    return -(share * np.log2(np.where(share > 0, share, 1.0))).sum(-1), total


def _square(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative square of the mean, whose gain by a split is that of the variance, and sum of weights (last axis: sum of weights,
    which are whole, and weighted sum of labels)."""
    total = weight[..., 0]
    return -((weight[..., 1] / np.maximum(total, 1)) ** 2), total


def grow(bins: np.ndarray, weight: np.ndarray, sizes: list[int], depth: int, look: int, rng: np.random.Generator, impurity: Callable = _entropy) -> tuple[np.ndarray, ...]:
    """One tree by entropy over cells (``bins``: bin of each feature; ``weight``: weight of each class): feature (-1: leaf), split
    (bins up to it go to ``child``, others to the next node), child and class weights of each node.  Each node looks at ``look``
    features.  As the library's forests do, a split must gain, and two leaves of one parent that predict alike are merged.
    With ``_square`` by variance; weights are then the sum of weights and the weighted sum of labels."""
    kinds = weight.shape[1]
    feature, split, child, stats = [], [], [], []
    rows, first, n = np.flatnonzero(impurity(weight)[1] > 0), 0, 1
    node = np.zeros(len(rows), np.int64)
    for level in range(depth + 1):
        w = weight[rows]
        total = np.stack([np.bincount(node, w[:, k], n) for k in range(kinds)], 1)
        own, size = impurity(total)
        best, which, where = np.maximum(-1e-12 * own, 0), np.full(n, -1), np.zeros(n, np.int64)  # gains of a variance are rounded
        open_ = (own > 1e-15) | (impurity is _square) if level < depth else np.zeros(n, bool)
        chosen = np.argsort(rng.random((n, len(sizes))), 1)[:, :look]
        for f in range(len(sizes)):
            mine = open_ & (chosen == f).any(1)
            if not mine.any() or sizes[f] < 2:
                continue
            place = np.cumsum(mine) - 1
            pick = np.flatnonzero(mine[node])
            at = place[node[pick]] * sizes[f] + bins[rows[pick], f]
            left = np.stack([np.bincount(at, w[pick, k], mine.sum() * sizes[f]) for k in range(kinds)], 1)
            left = left.reshape(-1, sizes[f], kinds).cumsum(1)[:, :-1]
            right = total[mine][:, None] - left
            (hl, nl), (hr, nr) = impurity(left), impurity(right)
            gain = own[mine][:, None] - (nl * hl + nr * hr) / size[mine][:, None]
            gain[(nl < 1) | (nr < 1)] = -1
            top = gain.argmax(1)
            gain = gain[np.arange(len(top)), top]
            better = gain > best[mine]
            to = np.flatnonzero(mine)[better]
            best[to], which[to], where[to] = gain[better], f, top[better]
        parts = which >= 0
        down = first + n + 2 * (np.cumsum(parts) - 1)
        feature.append(which)
        split.append(where)
        child.append(np.where(parts, down, -1))
        stats.append(total)
        if not parts.any():
            break
        stay = parts[node]
        rows, node = rows[stay], node[stay]
        node = down[node] - first - n + (bins[rows, which[node]] > where[node])
        first, n = first + n, 2 * int(parts.sum())
    feature, split, child, stats = map(np.concatenate, (feature, split, child, stats))
    says = -impurity(stats)[0] * np.sign(stats[:, 1]) if impurity is _square else stats.argmax(1)
    for i in np.flatnonzero(feature >= 0)[::-1]:
        a = child[i]
        if feature[a] < 0 and feature[a + 1] < 0 and says[a] == says[a + 1]:
            feature[i] = -1
    return feature, split, child, stats


def votes(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Shares of the classes in the leaf of each cell."""
    feature, split, child, share = tree
    node, left = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(left := left[feature[node[left]] >= 0]):
        at = node[left]
        node[left] = child[at] + (bins[left, feature[at]] > split[at])
    return share[node]


def _unpacked(key: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.zeros((len(key), len(sizes)), np.int16)
    for f in range(len(sizes))[::-1]:
        key, out[:, f] = np.divmod(key, sizes[f])
    return out


def _cuts(df: DataFrame, names: list[str], **more: Column) -> tuple[list[list[float]], Row]:
    """Inner cut points of each feature; the aggregates ``more``."""
    few = df.agg(*[e.alias(n) for n, e in more.items()], *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(names)]).first()
    small = [few[f"n{i}"] <= 2 * BINS for i in range(len(names))]
    many = [few[f"n{i}"] > BINS * 0.9 for i in range(len(names))]  # the numbers of values are estimates
    steps = [i / BINS for i in range(1, BINS)]
    got = df.agg(*[F.percentile_approx(c, steps).alias(f"q{i}") for i, c in enumerate(names) if many[i]], *[F.collect_set(c).alias(f"v{i}") for i, c in enumerate(names) if small[i]]).first()
    cuts = []
    for i in range(len(names)):
        values = sorted(set(got[f"v{i}"])) if small[i] else []
        middle = [(a + b) / 2 for a, b in zip(values, values[1:])]
        cuts.append(sorted(set(got[f"q{i}"])) if many[i] and not 0 < len(values) <= BINS else middle)
    return [c or [0.0] for c in cuts], few


def _cutter(names: list[str], cuts: list[list[float]]) -> Bucketizer:
    return Bucketizer(splitsArray=[[-math.inf, *c, math.inf] for c in cuts], inputCols=names, outputCols=[f"__bin{i}" for i in range(len(cuts))])


class CountedForest(Estimator):
    """The forest that RandomForestClassifier grows by entropy (bins, features a node, bootstrap and votes are alike), at a cost that
    hardly grows with the rows.  A tree sees rows by their bins and classes only, so the rows of one cell are counted, all of them,
    in one aggregation; the sum of their Poisson(1) weights is Poisson(count).  Each tree is grown in one task from the counts.
    Cut points of features of more than 32 values are approximate quantiles.  If there are more than ``most`` cells (at many
    features), counting saves little and RandomForestClassifier reads the rows of ``features``, the assembled column."""

    def __init__(self, names: list[str], label: str, trees: int, depth: int, seed: int, most: int = 1 << 20):
        super().__init__()
        self.names, self.label, self.trees, self.depth, self.seed, self.most = names, label, trees, depth, seed, most

    def _fit(self, df: DataFrame) -> Model:
        y = F.col(self.label)
        cuts, seen = _cuts(df, self.names, y=F.max(y), bad=F.count_if(y.isNull() | (y < 0) | (y != F.floor(y))))
        if seen.y is None or seen.bad:
            raise ValueError(f"{self.label}: {seen.bad} labels that aren't whole numbers from 0" if seen.bad else "no rows")
        kinds, cutter = int(seen.y) + 1, _cutter(self.names, cuts)
        sizes = [len(c) + 1 for c in cuts]
        held = None
        if math.prod(sizes) * kinds < 1 << 62:
            cells = cutter.transform(df.select(*self.names, self.label)).groupBy((_key(sizes) * kinds + F.col(self.label).cast("long")).alias("key")).count()
            held = cells.limit(self.most + 1).toArrow()
        if held is None or len(held) > self.most:
            return RandomForestClassifier(labelCol=self.label, numTrees=self.trees, maxDepth=self.depth, impurity="entropy", seed=self.seed).fit(df)
        key, count = (held.column(c).to_numpy() for c in ("key", "count"))
        places, cell = np.unique(key // kinds, return_inverse=True)
        counts = np.zeros((len(places), kinds), np.int64)
        counts[cell, key % kinds] = count
        bins, depth, seed, look = _unpacked(places, sizes), self.depth, self.seed, math.ceil(math.sqrt(len(sizes)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    rng = np.random.default_rng((seed, i))
                    tree = grow(bins, rng.poisson(counts).astype(float), sizes, depth, look, rng)
                    yield pa.RecordBatch.from_arrays([pa.array([i])] + [pa.array([x.ravel().tolist()]) for x in tree[:3]] + [pa.array([tree[3].ravel().tolist()])], ["id", "feature", "split", "child", "stats"])

        spark = df.sparkSession
        jobs = spark.range(0, self.trees, 1, min(self.trees, 2 * spark.sparkContext.defaultParallelism))
        grown = jobs.mapInArrow(run, "id long, feature array<long>, split array<long>, child array<long>, stats array<double>").toArrow().sort_by("id")
        trees = []
        for i in range(len(grown)):
            feature, split, child, stats = (grown.column(c)[i].values.to_numpy() for c in ("feature", "split", "child", "stats"))
            stats = stats.reshape(-1, kinds)
            total = stats.sum(1, keepdims=True)
            trees.append((feature.astype(np.int16), split.astype(np.int16), child.astype(np.int32), stats / np.where(total > 0, total, 1)))
        return CountedForestModel(cutter, sizes, trees, kinds)


def _key(sizes: list[int]) -> Column:
    """The cell of a row as one number."""
    key = F.lit(0).cast("long")
    for i, n in enumerate(sizes):
        key = key * n + F.col(f"__bin{i}").cast("long")
    return key


class CountedForestModel(Model):
    """Adds rawPrediction, probability and prediction.  A task runs the trees once for each cell that it meets."""

    def __init__(self, cutter: Bucketizer, sizes: list[int], trees: list[tuple[np.ndarray, ...]], kinds: int):
        super().__init__()
        self.cutter, self.sizes, self.trees, self.kinds = cutter, sizes, trees, kinds

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, sizes, kinds, held = df.sparkSession.sparkContext.broadcast(self.trees), self.sizes, self.kinds, 1 << 20

        def run(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known, value = np.zeros(0, np.int64), np.zeros((0, kinds))
            for batch in keys:
                key, row = np.unique(batch.to_numpy(zero_copy_only=False), return_inverse=True)
                new = np.setdiff1d(key, known, True)
                if len(new):
                    if len(known) > held:
                        known, value, new = known[:0], value[:0], key
                    bins = _unpacked(new, sizes)
                    both = np.r_[known, new]
                    order = np.argsort(both, kind="stable")
                    known, value = both[order], np.concatenate([value, sum(votes(t, bins) for t in trees.value)])[order]
                got = value[np.searchsorted(known, key)][row]
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * kinds), pa.array(got.ravel()))

        n = len(self.trees)
        voted = F.arrow_udf(run, "array<double>")(_key(sizes))
        out = self.cutter.transform(df).withColumn("__votes", voted)
        return out.select(
            *df.columns,
            array_to_vector("__votes").alias("rawPrediction"),
            array_to_vector(F.transform("__votes", lambda v: v / n)).alias("probability"),
            (F.array_position("__votes", F.array_max("__votes")) - 1).cast("double").alias("prediction"),
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, part, labels, counts) of each run of equal key and part."""
    tail = [np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64)]
    for batch in batches:
        x = [np.concatenate([held, batch.column(i).to_numpy(zero_copy_only=False)]) for i, held in enumerate(tail)]
        edge = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])) + 1
        at = 0
        for end in edge.tolist():
            yield int(x[0][at]), int(x[1][at]), x[2][at:end], x[3][at:end]
            at = end
        tail = [c[at:] for c in x]
    if len(tail[0]):
        yield int(tail[0][0]), int(tail[1][0]), *tail[2:]


class CountedRegressor(Estimator):
    """The forest that RandomForestRegressor grows (bins, features a node, bootstrap and means are alike), at the cost of a few passes.
    A tree sees the rows of a cell only by the sum of their weights and the weighted sum of their labels: every row is drawn for all
    trees in one pass, Poisson(1) for each, and each tree is grown in one task from the sums of the cells.  The model holds a
    prediction for each cell of the grid of bins.  Cut points of features of more than 32 values are approximate quantiles.  If
    the grid has more than ``most`` cells (at 5 or more such features), RandomForestRegressor reads the rows of ``features``,
    the assembled column."""

    def __init__(self, names: list[str], label: str, trees: int, depth: int, seed: int, most: int = 1 << 20):
        super().__init__()
        self.names, self.label, self.trees, self.depth, self.seed, self.most = names, label, trees, depth, seed, most

    def _fit(self, df: DataFrame) -> Model:
        y = F.col(self.label).cast("double")
        cuts, seen = _cuts(df, self.names, y=F.avg(y), bad=F.count_if(y.isNull() | F.isnan(y) | (F.abs(y) == math.inf)))
        if seen.y is None or seen.bad:
            raise ValueError(f"{self.label}: {seen.bad} labels that aren't finite numbers" if seen.bad else "no rows")
        sizes = [len(c) + 1 for c in cuts]
        grid = math.prod(sizes)
        if grid > self.most:
            return RandomForestRegressor(labelCol=self.label, numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(df)
        # about 0, variances lose no digits; sums that end differently from run to run give the same middle
        middle, cutter = float(f"{seen.y:.3g}"), _cutter(self.names, cuts)
        rows = cutter.transform(df.select(*self.names, y.alias("__y"))).select(_key(sizes).alias("key"), (F.col("__y") - middle).alias("y"))
        # equal rows are counted; the rows of a large cell are dealt to several tasks
        large = rows.groupBy("key").count().filter(F.col("count") > PART).select("key", F.ceil(F.col("count") / PART).alias("parts"))
        part = F.coalesce(F.pmod(F.xxhash64("y"), "parts"), F.lit(0)).cast("long")
        counted = rows.groupBy("key", "y").count().join(F.broadcast(large), "key", "left").select("key", part.alias("part"), "y", "count")
        dealt = counted.repartition("key", "part").sortWithinPartitions("key", "part", "y")
        trees, depth, seed = self.trees, self.depth, self.seed
        groups, look = -(-trees // TREES), len(sizes) if trees == 1 else math.ceil(len(sizes) / 3)

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, sums = [], []

            def sent() -> pa.RecordBatch:
                held = np.stack(sums)
                parts = [held[:, :, g * TREES : (g + 1) * TREES].ravel() for g in range(groups)]
                return pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int64()), pa.array([keys] * groups, pa.list_(pa.int64())), pa.array(parts)], ["trees", "keys", "sums"])

            for key, part, y, count in _cells(batches):
                rng, total = np.random.default_rng((seed, key, part)), np.zeros((2, trees))
                for at in range(0, len(y), ROWS):
                    n = count[at : at + ROWS]
                    weight = rng.poisson(1.0 if (n == 1).all() else n[:, None], (len(n), trees)).astype(float)
                    total += np.stack([np.ones(len(n)), y[at : at + ROWS]]) @ weight
                keys.append(key)
                sums.append(total)
                if len(keys) == CELLS:
                    yield sent()
                    keys, sums = [], []
            if keys:
                yield sent()

        def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [row for batch in batches for row in zip(batch.column("trees").to_pylist(), batch.column("keys"), batch.column("sums"))]
            for g in sorted({row[0] for row in held}):
                own = range(g * TREES, min(trees, (g + 1) * TREES))
                key = np.concatenate([k.values.to_numpy() for i, k, _ in held if i == g])
                sums = np.concatenate([x.values.to_numpy().reshape(-1, 2, len(own)) for i, _, x in held if i == g])
                order = np.lexsort((sums[:, 1, 0], key))
                bins, sums, every, says = _unpacked(key[order], sizes), sums[order], _unpacked(np.arange(grid), sizes), np.zeros(grid)
                for at, i in enumerate(own):
                    tree = grow(bins, sums[:, :, at], sizes, depth, look, np.random.default_rng((seed, i)), _square)
                    says += votes((*tree[:3], tree[3][:, 1] / np.maximum(tree[3][:, 0], 1)), every)
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([says])], ["trees", "says"])

        sums = dealt.mapInArrow(drawn, "trees long, keys array<long>, sums array<double>")
        got = sums.repartitionById(groups, F.col("trees").cast("int")).mapInArrow(grown, "trees long, says array<double>").toArrow().sort_by("trees")
        return CountedRegressorModel(cutter, sizes, middle + sum(x.values.to_numpy() for x in got.column("says")) / trees)


class CountedRegressorModel(Model):
    """Adds prediction."""

    def __init__(self, cutter: Bucketizer, sizes: list[int], says: np.ndarray):
        super().__init__()
        self.cutter, self.sizes, self.says = cutter, sizes, says

    def _transform(self, df: DataFrame) -> DataFrame:
        says = df.sparkSession.sparkContext.broadcast(self.says)

        def run(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for key in keys:
                yield pa.array(says.value[key.to_numpy(zero_copy_only=False)])

        return self.cutter.transform(df).withColumn("prediction", F.arrow_udf(run, "double")(_key(self.sizes))).select(*df.columns, "prediction")
