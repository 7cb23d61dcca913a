"""Forty numbers, each from 0 to 1, that describe a data set to a model selector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import features, models, profile


def clip01(x: float | None) -> float:
    return float(min(1.0, max(0.0, x))) if x is not None and np.isfinite(x) else 0.0


def extract(df: DataFrame, target: str, task: str, row_id: str | None = None, most_columns: int = 50, landmarks: bool = True) -> list[float]:
    """The vector of a data set; null feature values count as 0 in all statistics but those of missing values.

    A constant number of passes over the data, whatever its columns; landmarks are cross-validated on a bounded sample.
    """
    known = profile.kinds(df)
    columns = [c for c in df.columns if c not in (target, row_id)]
    numeric = [c for c in columns if known[c] in ("numeric", "boolean")][:most_columns]
    others = [c for c in columns if known[c] == "string"]
    p = max(len([c for c in columns if known[c] in ("numeric", "boolean")]), 1)
    y_text = known[target] == "string"
    classes = features.distinct_values(df, target, 10_000) if y_text else []
    y = (F.array_position(F.array(*(F.lit(v) for v in classes)), F.col(target)) - 1).cast("double") if y_text else F.col(target).cast("double")
    gaps = df.agg(F.count("*").alias("n"), F.count_distinct(F.col(target)).alias("k"), *(F.count(F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)), *(F.count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(others))).first()
    n = max(gaps["n"], 1)
    missing = [1 - gaps[f"m{i}"] / n for i in range(len(columns))] or [0.0]
    x = df.select(y.alias("__y"), *(F.coalesce(E.finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numeric))
    each = [v for i, c in enumerate(numeric) for v in (F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"s{i}"), F.skewness(c).alias(f"k{i}"), F.kurtosis(c).alias(f"t{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"), F.count_if(F.col(c) == 0).alias(f"z{i}"), E.corr(F.col(c), F.col("__y")).alias(f"r{i}"))]
    row = x.agg(F.avg("__y").alias("ya"), F.stddev_pop("__y").alias("ys"), F.skewness("__y").alias("yk"), F.kurtosis("__y").alias("yt"), *each).first()
    get = lambda k: np.array([row[f"{k}{i}"] if row[f"{k}{i}"] is not None else 0.0 for i in range(len(numeric))] or [0.0])
    mean, std, skew, kurt, low, high, zeros, r = (get(k) for k in "asktlhzr")
    spread = high - low
    beyond = F.greatest(*(F.abs((F.col(c) - F.lit(mean[i])) / F.lit(std[i] or 1.0)) for i, c in enumerate(numeric)), F.lit(0.0)) > 3
    sparse = sum((F.abs(c) < F.lit(0.05 * spread[i])).cast("int") for i, c in enumerate(numeric)) if numeric else F.lit(0)
    rows = x.agg(F.avg(beyond.cast("double")).alias("out"), F.avg(F.lit(sparse) / max(len(numeric), 1) if isinstance(sparse, int) else sparse / max(len(numeric), 1)).alias("sparse")).first()
    matrix = np.nan_to_num(features.correlation_matrix(x, numeric)) if len(numeric) > 1 else np.eye(1)
    upper = np.abs(matrix[np.triu_indices(len(matrix), 1)]) if len(matrix) > 1 else np.zeros(1)
    shape = features.entropy(df, target).first() if task == "classification" else None
    y_cv = abs((row["ys"] or 0) / ((row["ya"] or 0) + 1e-10)) / 10
    values = np.sort(np.linalg.eigvalsh(matrix))[::-1].clip(0)
    total = np.cumsum(values) / max(values.sum(), 1e-10)
    unique = [gaps[f"u{i}"] / n for i in range(len(others))] or [0.0]
    k = gaps["k"]
    marks = models.landmarks(df, numeric, target, task) if landmarks and numeric else [0.5] * 4
    cv = np.abs(std / (mean + 1e-10))
    out = [
        n / 1e5, p / 100, len([c for c in columns if known[c] in ("numeric", "boolean")]) / p, len(others) / p, k / n, p / n,
        float(np.mean(missing)), float(np.mean(np.array(missing) > 0)), max(missing), np.abs(skew).mean() / 10, np.abs(kurt).mean() / 50, rows["out"],
        upper.mean(), cv.mean(), skew.std() / 10, kurt.std() / 50, (spread / (std + 1e-10)).mean() / 20, zeros.sum() / (n * max(len(numeric), 1)),
        shape["balance"] if shape else y_cv, float(np.mean(unique)), max(unique), float(np.mean(np.array(unique) > 0.05)), abs(row["yk"] or 0) / 10, abs(row["yt"] or 0) / 50, shape["entropy"] if shape else y_cv,
        (int(np.argmax(total >= 0.95)) + 1) / len(total), total[len(total) // 2], (int(np.argmax(total >= 0.5)) + 1) / len(total), *marks,
        rows["sparse"], np.abs(r).mean(), np.abs(r).max(), 5 * np.abs(r).std(), (marks[0] - marks[2] + 1) / 2, (k if task == "classification" else 1) / 20, (marks[3] - marks[2] + 1) / 2, float(np.mean(std > 0.1 * std.max())),
    ]
    return [clip01(v) for v in out]
