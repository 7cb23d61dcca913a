"""Shapley values of fitted models: path-dependent ones of Spark's trees, and model-agnostic ones by weighted coalitions."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import shared_folder

# ---- trees


@dataclass
class Leaf:
    """A leaf's value, and for each column on its path: the share of training rows that went the path's way, and the values that do."""

    value: float
    columns: np.ndarray
    shares: np.ndarray
    low: np.ndarray
    high: np.ndarray
    among: dict[int, np.ndarray]


def _nodes(spark: SparkSession, model) -> list[tuple[float, dict]]:
    """Weight and nodes (by id) of each tree of a fitted tree, forest or boosted model, from its saved form."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    many = "nodeData" in rows.columns
    rows = rows.select(F.col("treeID").alias("tree"), "nodeData.*") if many else rows.withColumn("tree", F.lit(0))
    trees: dict[int, dict] = {}
    for r in rows.toLocalIterator():  # as many rows as the model has nodes
        trees.setdefault(r["tree"], {})[r["id"]] = r
    if not many:
        return [(1.0, trees[0])]
    weights = list(model.treeWeights)
    mean = "RandomForest" in type(model).__name__
    return [(weights[t] / (sum(weights) if mean else 1), nodes) for t, nodes in sorted(trees.items())]


def _value(node, positive: int | None) -> float:
    """What a leaf says: its prediction, or the share of class ``positive`` among its training rows."""
    if positive is None:
        return float(node["prediction"])
    stats = node["impurityStats"]
    return float(stats[positive] / sum(stats)) if sum(stats) else 0.0


def _cover(node, positive: int | None) -> float:
    """The weight of the training rows of a node: class counts add up; those of a regression begin with the count."""
    return float(sum(node["impurityStats"])) if positive is not None else float(node["impurityStats"][0])


def leaves(spark: SparkSession, model, positive: int | None = None) -> list[Leaf]:
    """The leaves of all trees, their values scaled by their trees' weights."""
    out: list[Leaf] = []
    for weight, nodes in _nodes(spark, model):
        todo: list[tuple[int, dict[int, tuple]]] = [(0, {})]
        while todo:
            at, path = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                cols = sorted(path)
                out.append(Leaf(weight * _value(node, positive), np.array(cols, dtype=np.int64), np.array([path[c][0] for c in cols]), np.array([path[c][1] for c in cols]), np.array([path[c][2] for c in cols]), {n: path[c][3] for n, c in enumerate(cols) if path[c][3] is not None}))
                continue
            split, column = node["split"], node["split"]["featureIndex"]
            total = _cover(node, positive)
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share, low, high, among = path.get(column, (1.0, -math.inf, math.inf, None))
                share *= _cover(nodes[child], positive) / total if total else 0.5
                values = split["leftCategoriesOrThreshold"]
                if split["numCategories"] < 0:
                    low, high = (low, min(high, values[0])) if left else (max(low, values[0]), high)
                else:
                    own = set(values) if left else set(range(split["numCategories"])) - set(values)
                    among = np.array(sorted(own if among is None else own & set(among.tolist())), dtype=float)
                todo.append((child, path | {column: (share, low, high, among)}))
    return out


def base_value(found: list[Leaf]) -> float:
    """The trees' mean over their training rows: what the values of a row add to."""
    return float(sum(leaf.value * leaf.shares.prod() for leaf in found))


def _shapley(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """Shapley values of the rows of ``x``.

    With a set of columns known, a leaf counts by the shares of those of its path that are not known, if the known ones
    lead to it. Its part in a column's value sums over the sets of its other columns, by the coefficients of the product
    of (share + fits * t), so a leaf costs the square of its path's columns, not their power set.
    """
    out = np.zeros_like(x)
    for leaf in found:
        k = len(leaf.columns)
        if not k:
            continue
        own = x[:, leaf.columns]
        fits = (own > leaf.low) & (own <= leaf.high)
        for n, values in leaf.among.items():
            fits[:, n] = np.isin(own[:, n], values)
        weights = [math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)]
        patterns, which = np.unique(fits, axis=0, return_inverse=True)
        parts = np.zeros(patterns.shape)
        for j in range(k):
            poly = np.zeros((len(patterns), k))
            poly[:, 0] = 1
            for i in (i for i in range(k) if i != j):
                poly[:, 1:] = poly[:, 1:] * leaf.shares[i] + poly[:, :-1] * patterns[:, i, None]
                poly[:, 0] *= leaf.shares[i]
            parts[:, j] = leaf.value * (patterns[:, j] - leaf.shares[j]) * (poly @ weights)
        out[:, leaf.columns] += parts[which.ravel()]
    return out


def tree_shap(rows: DataFrame, model, columns: list[str], positive: int | None = None) -> tuple[DataFrame, float]:
    """``row_id, name, shap`` for every row and column, and the base value that each row's values add to.

    ``model`` is a fitted decision tree, random forest or boosted model of Spark; for a classifying tree or forest
    ``positive`` is the class whose probability is explained, and a boosted classifier is explained by its margin. The
    model's leaves (bounded by its size) are sent to the tasks; rows never move. Base and values add up to the prediction.
    """
    found = leaves(rows.sparkSession, model, positive)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = _shapley(np.array(batch["v"].tolist(), dtype=float), found)
                yield pd.DataFrame({"row_id": batch["row_id"], "shap": list(made)})

    kind = dict(rows.dtypes)["row_id"]
    made = rows.select("row_id", vector_to_array("features").alias("v")).mapInPandas(run, f"row_id {kind}, shap array<double>")
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col("shap")[i].alias("shap")) for i, c in enumerate(columns)))
    return made.select("row_id", F.inline(cells)), base_value(found)


# ---- any model

#: Columns up to which all coalitions are taken, and coalitions that are drawn beyond.
ALL_COLUMNS, DRAWN = 8, 2048


def coalitions(m: int, drawn: int = DRAWN, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Bit masks of sets of ``m`` columns, neither empty nor whole, and their kernel weights.

    All sets up to ``ALL_COLUMNS`` columns; beyond, ``drawn`` of them by the kernel's weight of their size, each with its complement.
    """
    if m <= ALL_COLUMNS:
        masks = np.arange(1, (1 << m) - 1)
        sizes = np.array([int(s).bit_count() for s in masks], dtype=np.int64)
        return masks, np.array([(m - 1) / (math.comb(m, int(s)) * s * (m - s)) for s in sizes], dtype=float)
    rng = np.random.default_rng(seed)
    size = np.arange(1, m)
    chance = (m - 1) / (size * (m - size))
    counts: dict[int, int] = {}
    for s in rng.choice(size, drawn // 2, p=chance / chance.sum()):
        mask = sum(1 << int(i) for i in rng.choice(m, s, replace=False))
        for one in (mask, (1 << m) - 1 - mask):
            counts[one] = counts.get(one, 0) + 1
    masks = np.array(sorted(counts))
    return masks, np.array([counts[int(s)] for s in masks], dtype=float)


def _solver(m: int, masks: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All masks with the empty and the whole set, and for each what its value adds to each column's Shapley value.

    The weighted least squares problem, under the condition that the values add up to whole less empty, is linear in the
    values of the sets, and its matrix is the same for every row: so it is solved once.
    """
    z = (masks[:, None] >> np.arange(m)) & 1
    if m == 1:
        return np.array([0, 1]), np.array([[-1.0, 1.0]])
    inverse = np.linalg.pinv(z.T @ (weights[:, None] * z))
    plain = inverse @ (z.T * weights)  # times (value - empty)
    ones = inverse.sum(axis=1) / inverse.sum()
    inner = plain - np.outer(ones, plain.sum(axis=0))
    whole = ones
    return np.r_[0, masks, (1 << m) - 1], np.c_[-inner.sum(axis=1) - whole, inner, whole]


def background(rows: DataFrame, k: int = 30, seed: int = 42) -> list[tuple[float, list[float]]]:
    """The centres of ``k`` clusters of the rows (one: their mean), each with its share of them."""
    if k == 1:
        return [(1.0, rows.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist())]
    model = KMeans(k=k, seed=seed, maxIter=50).fit(rows)
    sizes = model.summary.clusterSizes
    return [(n / sum(sizes), c.tolist()) for n, c in zip(sizes, model.clusterCenters(), strict=True) if n]


def kernel_shap(rows: DataFrame, model, columns: list[str], against: list[tuple[float, list[float]]], drawn: int = DRAWN, seed: int = 42, value: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """``row_id, name, shap`` of the given rows for any model with ``transform``, against weighted background rows.

    A set's value is the model's mean over the background where the columns outside the set come from there. Each row
    becomes one for each set and background row, and one aggregate of as many sums as columns gives the values, so a third
    of the rows with one id (``row_id`` must be unique) is nothing special, and only the partial sums are shuffled.
    ``value`` tells what of the model's output is explained: by default the probability of class 1, else the prediction.
    """
    m = len(columns)
    if m > 62:
        raise ValueError("62 columns at most")
    masks, coefficients = _solver(m, *coalitions(m, drawn, seed))
    sets = F.array(*(F.struct(F.lit(int(s)).alias("mask"), F.array(*(F.lit(float(c)) for c in coefficients[:, n])).alias("c")) for n, s in enumerate(masks))) if len(masks) <= 300 else None
    spread = rows.select("row_id", vector_to_array("features").alias("v"))
    if sets is not None:
        spread = spread.select("row_id", "v", F.inline(sets))
    else:  # too many for an expression: a small table, met through its place
        table = F.broadcast(rows.sparkSession.createDataFrame([(n, int(s), coefficients[:, n].tolist()) for n, s in enumerate(masks)], "n int, mask long, c array<double>"))
        spread = spread.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1)))).join(table, "n").drop("n")
    far = F.array(*(F.struct(F.lit(float(w)).alias("w"), F.array(*(F.lit(float(x)) for x in b)).alias("b")) for w, b in against))
    spread = spread.select("row_id", "v", "mask", "c", F.inline(far))
    mixed = F.array(*(F.when(F.shiftright(F.col("mask").cast("long"), i).bitwiseAND(1) == 1, F.col("v")[i]).otherwise(F.col("b")[i]) for i in range(m)))
    made = model.transform(spread.select("row_id", "c", "w", array_to_vector(mixed).alias("features")))
    got = value(made) if value else vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
    sums = made.withColumn("got", got * F.col("w")).groupBy("row_id").agg(*(F.sum(F.col("got") * F.col("c")[i]).alias(f"s{i}") for i in range(m)))
    return sums.select("row_id", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"s{i}").alias("shap")) for i, c in enumerate(columns)))))


def importance(values: DataFrame) -> DataFrame:
    """``name, importance``: the mean of the absolute values of each column."""
    return values.groupBy("name").agg(F.avg(F.abs("shap")).alias("importance"))
