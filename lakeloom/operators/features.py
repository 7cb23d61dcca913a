"""Feature engineering: encoders, scalers, selection by correlation, mutual information and variance inflation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ordered import kept, running_sums, with_position
from .quantiles import of_columns


def distinct_values(df: DataFrame, column: str, most: int) -> list[str]:
    """A column's values as strings in order; fails beyond ``most``, which keeps what comes to the driver small."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column!r} has more than {most} values")
    return sorted(r["v"] for r in rows)


def label_encode(df: DataFrame, column: str, values: list[str] | None = None, most: int = 1000) -> DataFrame:
    """A column as the place of its value in string order; null and unknown values are null."""
    values = values if values is not None else distinct_values(df, column, most)
    place = F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column).cast("string")) - 1
    return df.withColumn(column, F.when(place >= 0, place).cast("int"))


def one_hot(df: DataFrame, column: str, most: int = 10) -> DataFrame:
    """``{column}_{value}`` for each value but the first in order; all zero for null."""
    values = distinct_values(df, column, most)
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("int"), F.lit(0)) for v in values[1:]})


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 1.0, least_samples: int = 1) -> DataFrame:
    """``{column}_target``: the mean target of the value, drawn to the overall mean where the value is rare; that for unseen ones.

    The weight of the value's own mean is ``1 / (1 + exp(-(n - least_samples) / smoothing))``, 0 for a single row.
    """
    known = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    prior = known.agg(F.avg(F.col(target).cast("double")).alias("__prior"))  # one row
    means = known.groupBy(F.col(column).alias("__key")).agg(F.avg(F.col(target).cast("double")).alias("__mean"), F.count("*").alias("__n"))
    weight = F.when(F.col("__n") > 1, 1 / (1 + F.exp(-(F.col("__n") - least_samples) / smoothing))).otherwise(0.0)
    joined = df.join(means, F.col(column) == F.col("__key"), "left").crossJoin(F.broadcast(prior))
    value = F.coalesce(weight * F.col("__mean") + (1 - weight) * F.col("__prior"), F.col("__prior"))
    return joined.withColumn(f"{column}_target", value).drop("__key", "__mean", "__n", "__prior")


def scalers(df: DataFrame, columns: list[str], method: str | None = None) -> tuple[dict[str, tuple[float, float]], str]:
    """Middle and width of each column that has a value: median and IQR where mean abs(skewness) is over 1, else mean and deviation (population)."""
    d = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*(x for i, c in enumerate(columns) for x in (E.skew(d[c]).alias(f"s{i}"), F.avg(d[c]).alias(f"m{i}"), F.stddev_pop(d[c]).alias(f"d{i}")))).first()
    if method is None:
        skews = [abs(row[f"s{i}"]) for i in range(len(columns)) if row[f"s{i}"] is not None]
        method = "robust" if skews and sum(skews) / len(skews) > 1 else "standard"
    quartiles = of_columns(df, d, (0.25, 0.5, 0.75)) if method == "robust" else {}
    found: dict[str, tuple[float, float]] = {}
    for i, c in enumerate(columns):
        q = quartiles.get(c)
        if row[f"m{i}"] is not None:
            middle, width = (q[1], q[2] - q[0]) if method == "robust" and q else (row[f"m{i}"], row[f"d{i}"])
            found[c] = (middle, width or 1.0)
    return found, method


def scale(df: DataFrame, columns: list[str], method: str | None = None) -> tuple[DataFrame, str]:
    """Columns as robust scores (median and IQR) where mean abs(skewness) is over 1, else standard scores (population)."""
    found, method = scalers(df, columns, method)
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(middle)) / F.lit(width) for c, (middle, width) in found.items()}), method


def align(row: DataFrame, columns: list[str]) -> DataFrame:
    """A table with exactly the given feature columns, as doubles: missing ones are 0, others go."""
    have = set(row.columns)
    return row.select(*((F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns))


def cumulative_share(values: np.ndarray, shares: tuple[float, ...] = (0.5, 0.95)) -> list[int]:
    """How many of the largest values make up each share of their sum."""
    total = np.cumsum(np.sort(values)[::-1]) / max(values.sum(), 1e-10)
    return [int(np.argmax(total >= s - 1e-12)) + 1 for s in shares]


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pairwise correlations, one pass over the data; NaN where undefined."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    out = np.eye(len(columns))
    if pairs:
        row = df.agg(*(E.corr(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"r{i}_{j}") for i, j in pairs)).first()
        for i, j in pairs:
            out[i, j] = out[j, i] = np.nan if row[f"r{i}_{j}"] is None else row[f"r{i}_{j}"]
    return out


def drop_correlated(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """The columns less the later one of each pair with abs(r) over ``most``."""
    r = np.abs(correlation_matrix(df, columns))
    return [c for j, c in enumerate(columns) if not any(r[i, j] > most for i in range(j))]


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R²) of each column on the others: the diagonal of the inverse correlation matrix."""
    return _vif(np.nan_to_num(correlation_matrix(df, columns)), columns)


def _vif(r: np.ndarray, columns: list[str]) -> dict[str, float]:
    try:
        diagonal = np.diag(np.linalg.inv(r))
    except np.linalg.LinAlgError:
        diagonal = np.full(len(columns), np.inf)
    return {c: float("inf") if not np.isfinite(v) or v < 1 - 1e-6 else round(float(v), 2) for c, v in zip(columns, diagonal, strict=True)}


def eliminate_vif(df: DataFrame, columns: list[str], target: str, most: float = 10.0, least_columns: int = 10, rounds: int = 20) -> tuple[list[str], list[str]]:
    """Columns kept and dropped: while some VIF is over the threshold, that column goes which correlates least with the target.

    One matrix over columns and target serves all rounds.
    """
    if len(columns) < least_columns:
        return columns, []
    r = np.nan_to_num(correlation_matrix(df, [*columns, target]))
    left, gone = list(range(len(columns))), []
    for _ in range(min(len(columns), rounds)):
        found = _vif(r[np.ix_(left, left)], [columns[i] for i in left])
        over = [i for i in left if found[columns[i]] > most]
        if not over or len(left) < 2:
            break
        worst = min(over, key=lambda i: (abs(r[i, -1]), i))
        left.remove(worst)
        gone.append(columns[worst])
    return [columns[i] for i in left], gone


def binned(df: DataFrame, c: str, bins: int) -> Column:
    """A column's bin from its own minimum and maximum, as a window-free expression; needs ``lo_{c}`` and ``hi_{c}`` beside it."""
    part = F.floor(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")) * bins)
    return F.least(F.coalesce(part, F.lit(0)), F.lit(bins - 1)).cast("int")


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """``name, mi`` in nats of binned columns with a discrete target, from contingency counts; a ranking, not an estimate."""
    rows = df.select(F.col(target).cast("string").alias("t"), *(F.col(c).cast("double").alias(c) for c in columns)).where("t is not null")
    ends = F.broadcast(rows.agg(*(x for c in columns for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")))))  # one row
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.when(F.col(c).isNotNull(), binned(rows, c, bins)).alias("b")) for c in columns))
    counts = rows.crossJoin(ends).select("t", F.inline(cells)).where("b is not null").groupBy("name", "b", "t").agg(F.count("*").alias("n"))
    by_bin, by_class = counts.groupBy("name", "b").agg(F.sum("n").alias("nb")), counts.groupBy("name", "t").agg(F.sum("n").alias("nt"))
    total = counts.groupBy("name").agg(F.sum("n").alias("total"))
    joined = counts.join(by_bin, ["name", "b"]).join(by_class, ["name", "t"]).join(total, "name")
    return joined.groupBy("name").agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nb") * F.col("nt")))).alias("mi"))


def digamma(n: Column) -> Column:
    """The digamma function of a positive number, by its series beyond 10."""
    x = n.cast("double") + 10
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4))) - 1 / (252 * F.pow(x, F.lit(6)))
    return series - sum((1 / (n.cast("double") + i) for i in range(10)), F.lit(0.0))


#: Rows of a stretch of the sorted order that one task looks through; the ``k`` rows at each end go to the next one too.
STRETCH = 50_000


def neighbour_information(df: DataFrame, columns: list[str], target: str, k: int = 3) -> DataFrame:
    """``name, mi`` in nats of numeric columns with a discrete target, by distances to neighbours (Ross, 2014).

    For each value: the distance to its ``k``-th neighbour in its class (fewer in a class of fewer), and the number of values
    of any class that are nearer (as near, where the distance is 0). Classes with one value say nothing. The estimate is
    psi(N) + mean psi(k) - mean psi(class) - mean psi(nearer), and 0 at least; nothing is drawn at random, so ties count as
    they are. Missing values and targets are left out of their column; a column without values has no row.

    All columns are done together. Values are numbered in the order of column, class and value, and looked through in
    stretches with ``k`` rows of the neighbouring stretches, so neither a class nor a column is one task's; how many are
    nearer comes from running counts over one sort of values and interval ends.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("name"), E.finite(F.col(c).cast("double")).alias("x")) for c in columns))
    points = df.where(F.col(target).isNotNull()).select(F.col(target).cast("string").alias("t"), F.inline(cells)).where("x is not null")
    sizes = F.broadcast(kept(points.groupBy("name", "t").agg(F.count("*").alias("n"))))  # a row for each column and class
    points = points.join(sizes.where("n > 1"), ["name", "t"])
    placed = with_position(points, "name", "t", "x", name="p")
    near = placed.withColumn("stretch", F.explode(F.array_distinct(F.array(*(F.floor((F.col("p") + d) / STRETCH) for d in (-k, 0, k))))))
    order = Window.partitionBy("stretch").orderBy("p")
    same = lambda move, i: (F.col("name") == move("name", i).over(order)) & (F.col("t") == move("t", i).over(order))
    for i in range(1, k + 1):
        near = near.withColumns({f"b{i}": F.when(same(F.lag, i), F.lag("x", i).over(order)), f"a{i}": F.when(same(F.lead, i), F.lead("x", i).over(order))})
    near = near.where(F.floor(F.col("p") / STRETCH) == F.col("stretch"))
    own = F.least(F.lit(k), F.col("n") - 1)
    gaps = F.array_sort(F.filter(F.array(*(F.abs(F.col(f"{s}{i}") - F.col("x")) for s in "ab" for i in range(1, k + 1))), lambda g: g.isNotNull()))
    found = near.withColumn("k", own).withColumn("far", F.element_at(gaps, F.col("k").cast("int")))
    ends = lambda side, sign: F.coalesce(*(F.when(F.abs(F.col(f"{side}{i}") - F.col("x")) == F.col("far"), F.col(f"{side}{i}")) for i in range(1, k + 1)), F.col("x") + sign * F.col("far"))
    found = kept(found.select("name", "p", "x", "n", "k", "far", ends("b", -1).alias("low"), ends("a", 1).alias("high")))
    # at one value: interval begins that are open, values, ends that are closed; open ends come before, closed begins too
    zero = F.col("far") == 0
    marks = found.select("name", F.inline(F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("p"), F.lit(0).alias("sign")),
        F.struct(F.col("low").alias("v"), F.when(zero, 0).otherwise(2).alias("kind"), F.lit(0).alias("one"), F.col("p").alias("p"), F.lit(-1).alias("sign")),
        F.struct(F.col("high").alias("v"), F.when(zero, 2).otherwise(0).alias("kind"), F.lit(0).alias("one"), F.col("p").alias("p"), F.lit(1).alias("sign")),
    )))
    counted = running_sums(marks, ["name", "v", "kind", "p", "sign"], before=F.col("one")).where("p is not null")
    nearer = counted.groupBy("p").agg(F.sum(F.col("before") * F.col("sign")).alias("m"))
    terms = found.join(nearer, "p").groupBy("name").agg(F.count("*").alias("rows"), F.avg(digamma(F.col("k"))).alias("k"), F.avg(digamma(F.col("n"))).alias("n"), F.avg(digamma(F.greatest("m", F.lit(1)))).alias("m"))
    return terms.select("name", F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("k") - F.col("n") - F.col("m")).alias("mi"))


def select_top(df: DataFrame, columns: list[str], target: str, most: int = 50) -> list[str]:
    """The columns with the highest mutual information (by neighbours) where there are more than ``most``; equals by name."""
    if len(columns) <= most:
        return columns
    best = {r["name"] for r in neighbour_information(df, columns, target).orderBy(F.desc("mi"), "name").limit(most).collect()}
    return [c for c in columns if c in best]


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Normalised entropy and balance (rarest over most frequent class) of a column."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").cast("double").alias("n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))))  # one row
    p = F.col("n") / F.col("total")
    return both.agg((-F.sum(p * F.log(p + 1e-10)) / F.log(F.greatest(F.max("k"), F.lit(2)).cast("double"))).alias("entropy"), (F.min("n") / F.max("n")).alias("balance"))
