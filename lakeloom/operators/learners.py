"""Learners that Spark does not have: extremely randomised trees, and kernel machines by random Fourier features."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_D = Params._dummy


class ExtraTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Trees whose splits are drawn: each node tries the root of all columns, each at one random value of its path's range, and
    keeps the best. All rows go to every tree.

    A level of all trees is one pass: each task counts its rows by node, trial and side, and the counts (bounded by
    trees, nodes and trials, not by rows) are summed and come to the driver, which keeps the trees. ``classes`` 0 is regression.
    """

    numTrees = Param(_D(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(_D(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minInstancesPerNode = Param(_D(), "minInstancesPerNode", "rows of a node at least", TypeConverters.toInt)
    classes = Param(_D(), "classes", "classes, 0 for regression", TypeConverters.toInt)
    seed = Param(_D(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees: int = 50, maxDepth: int = 8, minInstancesPerNode: int = 1, classes: int = 0, seed: int = 42):
        super().__init__()
        self._setDefault(numTrees=50, maxDepth=8, minInstancesPerNode=1, classes=0, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        trees, depth, least, classes, seed = (self.getOrDefault(p) for p in (self.numTrees, self.maxDepth, self.minInstancesPerNode, self.classes, self.seed))
        rows = dataset.select(vector_to_array("features").alias("v"), F.col("label").cast("double").alias("y"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        m = len(first["v"])
        ends = rows.agg(*(x for i in range(m) for x in (F.min(F.col("v")[i]).alias(f"l{i}"), F.max(F.col("v")[i]).alias(f"h{i}")))).first()
        box = np.array([[ends[f"l{i}"], ends[f"h{i}"]] for i in range(m)], dtype=float)
        k, width = max(1, round(m**0.5)) if classes else m, classes or 3
        grown = [{"column": [-1], "at": [0.0], "left": [-1], "right": [-1], "value": [None]} for _ in range(trees)]
        open_ = [{0: box} for _ in range(trees)]  # nodes that may split, with their path's ranges
        for level in range(depth + 1):
            drawn: list[tuple[list[int], np.ndarray, np.ndarray]] = []
            for t in range(trees):
                nodes = sorted(open_[t])
                columns, values = np.zeros((len(nodes), k), dtype=np.int64), np.zeros((len(nodes), k))
                for n, node in enumerate(nodes):
                    rng = np.random.default_rng([seed, t, node])
                    columns[n] = rng.choice(m, k, replace=False)
                    low, high = open_[t][node][columns[n], 0], open_[t][node][columns[n], 1]
                    values[n] = low + rng.random(k) * (high - low)
                drawn.append((nodes, columns, values))
            sums = _level(rows, [_flat(g) for g in grown], drawn, classes, k, width)
            for t, (nodes, columns, values) in enumerate(drawn):
                for n, node in enumerate(nodes):
                    left, right = sums[t][n, :, 1], sums[t][n, :, 0]
                    whole = left[0] + right[0]
                    g = grown[t]
                    g["value"][node] = _says(whole, classes)
                    ranges = open_[t].pop(node)
                    gain = _impurity(whole, classes) - _impurity(left, classes) - _impurity(right, classes)
                    gain = np.where(np.minimum(_rows(left, classes), _rows(right, classes)) >= least, gain, -1.0)
                    best = int(np.argmax(gain))
                    if level == depth or gain[best] <= 1e-12 * max(1.0, abs(float(_impurity(whole, classes)))):
                        continue
                    c, at = int(columns[n, best]), float(values[n, best])
                    g["column"][node], g["at"][node] = c, at
                    for side in ("left", "right"):
                        g[side][node] = len(g["column"])
                        for name, empty in (("column", -1), ("at", 0.0), ("left", -1), ("right", -1), ("value", None)):
                            g[name].append(empty)
                        part = ranges.copy()
                        part[c, 1 if side == "left" else 0] = at
                        open_[t][g[side][node]] = part
            if not any(open_):
                break
        return ExtraTreesModel(state=json.dumps({"classes": classes, "trees": grown}))


def _flat(tree: dict) -> tuple[np.ndarray, ...]:
    return np.array(tree["column"]), np.array(tree["at"]), np.array(tree["left"]), np.array(tree["right"])


def _walk(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node at which each row ends."""
    column, at, left, right = tree
    node = np.zeros(len(x), dtype=np.int64)
    while (inner := np.flatnonzero(column[node] >= 0)).size:
        here = node[inner]
        node[inner] = np.where(x[inner, column[here]] <= at[here], left[here], right[here])
    return node


def _rows(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def _impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini impurity, or the sum of squared differences from the mean."""
    n = np.maximum(_rows(stats, classes), 1e-300)
    return n - np.square(stats).sum(axis=-1) / n if classes else stats[..., 2] - np.square(stats[..., 1]) / n


def _says(stats: np.ndarray, classes: int) -> list[float]:
    n = max(float(_rows(stats, classes)), 1e-300)
    return (stats / n).tolist() if classes else [float(stats[1] / n)]


def _level(rows: DataFrame, grown: list[tuple], drawn: list[tuple], classes: int, k: int, width: int) -> list[np.ndarray]:
    """For each tree: sums by open node, trial and side (0 right, 1 left) of class counts, or of 1, y and y squared."""
    shapes = [len(nodes) * k * 2 for nodes, _, _ in drawn]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros((s, width)) for s in shapes]
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.array(batch["v"].tolist(), dtype=float).reshape(len(batch), -1), batch["y"].to_numpy(dtype=float)
            weights = [(y == c).astype(float) for c in range(classes)] if classes else [np.ones(len(y)), y, y * y]
            for t, (nodes, columns, values) in enumerate(drawn):
                if not nodes:
                    continue
                place = np.full(len(grown[t][0]), -1)
                place[nodes] = np.arange(len(nodes))
                node = place[_walk(x, grown[t])]
                some = np.flatnonzero(node >= 0)
                for j in range(k):
                    left = x[some, columns[node[some], j]] <= values[node[some], j]
                    slot = (node[some] * k + j) * 2 + left
                    for w, weight in enumerate(weights):
                        held[t][:, w] += np.bincount(slot, weight[some], minlength=shapes[t])
        for t, sums in enumerate(held):
            if len(sums):
                yield pd.DataFrame({"tree": t, "slot": np.arange(len(sums)), "sums": list(sums)})

    parts = rows.mapInPandas(run, "tree int, slot int, sums array<double>")
    total = parts.groupBy("tree", "slot").agg(*(F.sum(F.col("sums")[w]).alias(f"s{w}") for w in range(width)))
    out = [np.zeros((s, width)) for s in shapes]
    for r in total.toLocalIterator():
        out[r["tree"]][r["slot"]] = [r[f"s{w}"] for w in range(width)]
    return [o.reshape(-1, k, 2, width) for o in out]


class ExtraTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``, and for classes ``probability``: the mean over the trees."""

    state = Param(_D(), "state", "the trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        trees = [(_flat(t), np.array([v if v is not None else [0.0] * max(1, state["classes"]) for v in t["value"]])) for t in state["trees"]]

        @F.pandas_udf("array<double>")
        def mean(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
            return pd.Series(list(sum(values[_walk(x, tree)] for tree, values in trees) / len(trees)))

        value = mean(vector_to_array("features"))
        if not state["classes"]:
            return dataset.withColumn("prediction", value[0])
        made = dataset.withColumn("probability", array_to_vector(value))
        likely = vector_to_array("probability")
        return made.withColumn("prediction", (F.array_position(likely, F.array_max(likely)) - 1).cast("double"))


class RandomFourier(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``waves`` random cosines of a vector, whose products are near those of a Gaussian kernel exp(-gamma d^2); a linear machine on
    them is a kernel machine whose cost grows with the rows, not their square. ``gamma`` 0 is one over the columns."""

    inputCol = Param(_D(), "inputCol", "vector", TypeConverters.toString)
    outputCol = Param(_D(), "outputCol", "waves", TypeConverters.toString)
    waves = Param(_D(), "waves", "cosines", TypeConverters.toInt)
    gamma = Param(_D(), "gamma", "kernel width, 0 for 1 / columns", TypeConverters.toFloat)
    seed = Param(_D(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "waves", waves: int = 200, gamma: float = 0.0, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="waves", waves=200, gamma=0.0, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, gamma, seed = self.getOrDefault(self.waves), self.getOrDefault(self.gamma), self.getOrDefault(self.seed)

        @F.pandas_udf("array<double>")
        def cosines(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.array(v.tolist(), dtype=float).reshape(len(v), -1)
            rng = np.random.default_rng(seed)  # the same waves in every task
            w = rng.normal(0.0, np.sqrt(2 * (gamma or 1 / x.shape[1])), (x.shape[1], n))
            return pd.Series(list(np.sqrt(2 / n) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, n))))

        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(cosines(vector_to_array(self.getOrDefault(self.inputCol)))))


def kernel_machine(task: str, classes: int = 2, waves: int = 200, gamma: float = 0.0, seed: int = 42) -> Pipeline:
    """Standard scores, random Fourier features, then a linear machine: support vectors for classes, ridge for numbers."""
    if task == "classification":
        linear = LinearSVC(featuresCol="__waves", maxIter=50, regParam=1e-3)
        last = linear if classes <= 2 else OneVsRest(featuresCol="__waves", classifier=linear)
    else:
        last = LinearRegression(featuresCol="__waves", regParam=1e-3)
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="__scaled", withMean=True), RandomFourier(inputCol="__scaled", outputCol="__waves", waves=waves, gamma=gamma, seed=seed), last])
