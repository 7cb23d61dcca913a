"""Made-up data sets for tests of models: rows from ``spark.range`` and seeded random expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession, n: int, columns: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", *(F.randn(seed + i).alias(f"x{i}") for i in range(columns)))


def classification(spark: SparkSession, n: int = 500, columns: int = 5, classes: int = 2, noise: float = 0.3, seed: int = 1) -> DataFrame:
    """Classes by bands of a noisy linear score."""
    score = sum((F.col(f"x{i}") / (i + 1) for i in range(columns)), F.lit(0.0)) + noise * F.randn(seed + 99)
    band = F.floor((F.tanh(score) + 1) / 2 * classes)
    return _base(spark, n, columns, seed).withColumn("target", F.least(band, F.lit(classes - 1)).cast("int"))


def moons(spark: SparkSession, n: int = 500, noise: float = 0.1, seed: int = 1) -> DataFrame:
    """Two half circles, one in the other's bend."""
    t, c = F.rand(seed) * 3.141592653589793, F.pmod("id", F.lit(2))
    return spark.range(n).select("id", (F.when(c == 0, F.cos(t)).otherwise(1 - F.cos(t)) + noise * F.randn(seed + 1)).alias("x0"), (F.when(c == 0, F.sin(t)).otherwise(0.5 - F.sin(t)) + noise * F.randn(seed + 2)).alias("x1"), c.cast("int").alias("target"))


def circles(spark: SparkSession, n: int = 500, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """A circle in another."""
    t, c = F.rand(seed) * 6.283185307179586, F.pmod("id", F.lit(2))
    r = F.when(c == 0, 1.0).otherwise(0.5)
    return spark.range(n).select("id", (r * F.cos(t) + noise * F.randn(seed + 1)).alias("x0"), (r * F.sin(t) + noise * F.randn(seed + 2)).alias("x1"), c.cast("int").alias("target"))


def xor(spark: SparkSession, n: int = 500, seed: int = 1) -> DataFrame:
    """Opposite quadrants alike."""
    return _base(spark, n, 2, seed).withColumn("target", ((F.col("x0") > 0) != (F.col("x1") > 0)).cast("int"))


def regression(spark: SparkSession, n: int = 500, columns: int = 5, noise: float = 0.1, seed: int = 1, kind: str = "linear") -> DataFrame:
    """A number from a linear, step, sine or sparse function of the columns."""
    x = [F.col(f"x{i}") for i in range(columns)]
    value = {
        "linear": sum(((i + 1) * c for i, c in enumerate(x)), F.lit(0.0)), "step": F.floor(x[0] * 2).cast("double"), "sine": F.sin(3 * x[0]), "sparse": 5 * x[0],
    }[kind]
    return _base(spark, n, columns, seed).withColumn("target", value + noise * F.randn(seed + 99))
