"""Chart data: a declarative request becomes one lazy DataFrame.

The order is fixed: filter, guard, bucket, aggregate, sort, limit. Ties are broken by key, so results are deterministic.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import names
from .quantiles import of_columns, quantiles

AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "median": lambda c: E.quantile(c, 0.5),
}


@dataclasses.dataclass(frozen=True)
class ChartSpec:
    """What to show. ``y`` None counts rows."""

    chart_type: str
    x: str | None = None
    y: str | None = None
    color: str | None = None
    agg: str = "sum"
    top_n: int | None = None
    granularity: str | None = None
    sort_by: str | None = None
    filter_col: str | None = None
    filter_val: str | None = None
    filter_values: tuple[str, ...] = ()
    title: str = ""


def fuzzy_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of the best tier that any row reaches: equal, equal but for case, the cell has the value, the value has the cell."""
    cell, low = F.col(column).cast("string"), value.lower()
    tier = F.when(cell == value, 1).when(F.lower(cell) == low, 2).when(F.lower(cell).contains(low), 3).when((cell != "") & F.lit(low).contains(F.lower(cell)), 4)
    marked = df.withColumn("__tier", tier)
    best = marked.agg(F.min("__tier").alias("__best"))  # one row
    return marked.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")


def any_value_filter(df: DataFrame, column: str, values: list[str] | tuple[str, ...]) -> DataFrame:
    """Rows whose cell is one of the values but for case; where none is, those that contain one or are contained in one."""
    cell, low = F.lower(F.col(column).cast("string")), [v.lower() for v in values]
    near = E.any_of(cell, low)
    for v in low:
        near = near | ((cell != "") & F.lit(v).contains(cell))
    marked = df.withColumn("__tier", F.when(cell.isin(low), 1).when(near, 2))
    best = marked.agg(F.min("__tier").alias("__best"))  # one row
    return marked.join(F.broadcast(best), F.col("__tier") == F.col("__best")).drop("__tier", "__best")


def equal_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose cell, as a string, is the value."""
    return df.where(F.col(column).cast("string") == value)


def filtered(df: DataFrame, spec: ChartSpec) -> DataFrame:
    if spec.filter_col and spec.filter_values:
        return any_value_filter(df, spec.filter_col, spec.filter_values)
    if spec.filter_col and spec.filter_val is not None:
        return fuzzy_filter(df, spec.filter_col, spec.filter_val)
    return df


def number(df: DataFrame, column: str) -> Column:
    """A column as numbers: strings are parsed, numeric columns are left alone."""
    return E.to_number(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def aggregate(df: DataFrame, keys: list[str | Column], y: Column | None, agg: str, name: str) -> DataFrame:
    """One aggregate by keys; rows with a null key, or a null ``y``, do not count."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    for k in columns:
        df = df.where(k.isNotNull())
    if y is None:
        return df.groupBy(*columns).agg(F.count("*").alias(name))
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    return df.where(y.isNotNull()).groupBy(*columns).agg(AGGREGATES[agg](y).alias(name))


def group_aggregate(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """``x [, color], value``: sorted by value where asked for, else by key; the first ``top_n``."""
    keys = [spec.x, *([spec.color] if spec.color else [])]
    out = aggregate(filtered(df, spec), keys, number(df, spec.y) if spec.y else None, spec.agg, "value")
    order = [*({"y_desc": [F.desc("value")], "y_asc": [F.asc("value")]}.get(spec.sort_by or "", [])), *keys]
    out = out.orderBy(*order)
    return out.limit(spec.top_n) if spec.top_n else out


def time_series(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """``period [, color], value`` by calendar label, in label order; a filter counts here too."""
    stamp = E.to_time(F.col(spec.x)) if dict(df.dtypes)[spec.x] == "string" else F.col(spec.x)
    label = E.period(stamp, spec.granularity or "monthly").alias("period")
    keys: list[str | Column] = [label, *([spec.color] if spec.color else [])]
    out = aggregate(filtered(df, spec), keys, number(df, spec.y) if spec.y else None, spec.agg, "value")
    return out.orderBy("period", *([spec.color] if spec.color else []))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``bin, low, high, n``: equal widths, the last bin closed on the right; empty bins have no row."""
    x = number(df, column).cast("double")
    rows = df.select(E.finite(x).alias("x")).where("x is not null")
    ends = F.broadcast(rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))  # one row
    place = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
    width = (F.col("hi") - F.col("lo")) / bins
    counted = rows.crossJoin(ends).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n").orderBy("bin")


def adaptive_bins(n: int, distinct: int, spread: float) -> int:
    """How many bins suit a column of ``n`` values over a range."""
    if spread <= 5:
        return min(15, max(8, distinct // 2))
    return 20 if spread <= 20 else min(35, max(15, int(n**0.5)))


def box(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 IQR) and the number of outliers, by group."""
    key = F.col(by).cast("string") if by else F.lit("all")
    rows = df.select(key.alias("grp"), number(df, y).cast("double").alias("v")).where("grp is not null and v is not null")
    quartiles = quantiles(rows, ["grp"], "v", (0.25, 0.5, 0.75)).drop("n")
    marked = rows.join(F.broadcast(quartiles) if by is None else quartiles, "grp")  # without a group: one row
    iqr = F.col("q")[2] - F.col("q")[0]
    inside = F.col("v").between(F.col("q")[0] - 1.5 * iqr, F.col("q")[2] + 1.5 * iqr)
    return marked.groupBy("grp").agg(
        F.first("q")[0].alias("q1"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q3"), F.min(F.when(inside, F.col("v"))).alias("low"),
        F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("outliers"), F.count("*").alias("n"),
    )


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b, r`` for each pair of columns, in one pass; null where a column is constant."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    row = df.agg(*(E.corr(number(df, a), number(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def contingency(df: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """Counts with a column for each value; without ``values`` they are looked up first."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, values).count().fillna(0)


def trend_line(df: DataFrame, x: str, y: str, points: int = 80) -> DataFrame:
    """``x, y, slope, intercept, r, strength``: the least-squares line at evenly spaced places."""
    a, b = number(df, x).cast("double"), number(df, y).cast("double")
    rows = df.select(E.finite(a).alias("x"), E.finite(b).alias("y")).dropna()
    fit = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), E.corr(F.col("x"), F.col("y")).alias("r"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    strength = F.when(F.abs("r") >= 0.6, "strong").when(F.abs("r") >= 0.3, "moderate").otherwise("weak")
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    return fit.withColumn("strength", strength).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(at.alias("x"), (F.col("slope") * at + F.col("intercept")).alias("y"), "slope", "intercept", "r", "strength")


def hash_sample(df: DataFrame, n: int = 5000) -> DataFrame:
    """``n`` rows chosen by the hash of their content: the same rows whatever their order and partitions."""
    names = [c for c, kind in df.dtypes if not kind.startswith("map")]
    return df.orderBy(F.xxhash64(*names), *[c for c in names]).limit(n)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``value, n, share`` of a column's values, most frequent first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    out = counts.crossJoin(total).select("value", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """``name, value, n, rank``: each column's most frequent values, all columns in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.inline(cells)).where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # top-k within each task first


def extremes(df: DataFrame, by: str, y: str, agg: str = "mean") -> DataFrame:
    """``side, key, value, n``: the groups with the highest and lowest aggregate; ties go to the smaller key."""
    y_ = number(df, y)
    groups = df.where(F.col(by).isNotNull() & y_.isNotNull()).groupBy(F.col(by).alias("key")).agg(AGGREGATES[agg](y_).alias("value"), F.count("*").alias("n"))
    best = groups.orderBy(F.desc("value"), "key").limit(1).select(F.lit("best").alias("side"), "*")
    return best.union(groups.orderBy("value", "key").limit(1).select(F.lit("worst").alias("side"), "*"))


def shares(df: DataFrame, by: str, y: str | None = None) -> DataFrame:
    """``key, value, share, top3_share`` of each group in the total."""
    groups = aggregate(df, [F.col(by).alias("key")], number(df, y) if y else None, "sum", "value")
    top3 = F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, 3)
    largest = groups.orderBy(F.desc("value"), "key").limit(3).agg(F.aggregate(top3, F.lit(0.0), lambda a, v: a + v).alias("top3"))
    total = groups.agg(F.sum("value").alias("total")).crossJoin(largest)  # one row
    return groups.crossJoin(F.broadcast(total)).select("key", "value", E.ratio(F.col("value"), F.col("total")).alias("share"), E.ratio(F.col("top3"), F.col("total")).alias("top3_share"))


def spread_ratio(df: DataFrame, by: str, y: str) -> DataFrame:
    """The largest group's standard deviation over the smallest one's, zero ones left out."""
    sd = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.stddev_samp(number(df, y)).alias("sd")).where("sd > 0")
    return sd.agg(E.ratio(F.max("sd"), F.min("sd")).alias("spread_ratio"), F.count("*").alias("n_groups"))


def trend(df: DataFrame, at: str, y: str, tie: str, by: str | None = None) -> DataFrame:
    """First, last, peak and low value in time order, and the change from first to last in percent."""
    y_ = number(df, y).cast("double")
    order = F.struct(at, tie)
    rows = df.where(F.col(at).isNotNull() & y_.isNotNull())
    out = rows.groupBy(*([by] if by else [])).agg(F.min_by(y_, order).alias("first"), F.max_by(y_, order).alias("last"), F.max(y_).alias("peak"), F.min(y_).alias("low"))
    return out.withColumn("change_pct", 100 * E.ratio(F.col("last") - F.col("first"), F.abs("first")))


def scalars(df: DataFrame, column: str) -> DataFrame:
    """sum (0 for no values), mean, median, min, max and count of a column."""
    c = number(df, column).cast("double")
    median = F.lit(of_columns(df, {"y": c}, (0.5,)).get("y", [None])[0]).cast("double")
    return df.agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("sum"), F.avg(c).alias("mean"), median.alias("median"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("count"))


def legal_types(x_kind: str, y_kind: str | None) -> tuple[str, ...]:
    """The chart types that suit the kinds (numeric, datetime, categorical) of x and y."""
    if y_kind is None:
        return {"numeric": ("histogram", "box"), "datetime": ("time_series",)}.get(x_kind, ("bar", "pie"))
    if x_kind == "datetime" and y_kind == "numeric":
        return ("time_series", "area")
    if x_kind == "numeric" and y_kind == "numeric":
        return ("scatter", "histogram", "box")
    return ("bar", "pie", "box", "treemap", "funnel") if y_kind == "numeric" else ("bar", "heatmap")


def build(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The data of a chart; columns may be misspelt a little (see ``names.best_name``)."""
    meant = {field: names.best_name(c, df.columns) for field in ("x", "y", "color", "filter_col") if (c := getattr(spec, field))}
    missing = [field for field, c in meant.items() if c is None]
    if missing:
        raise ValueError(f"no column {getattr(spec, missing[0])!r}")
    spec = dataclasses.replace(spec, **meant)
    kind = spec.chart_type
    if kind in ("time_series", "line", "area"):
        return time_series(df, spec)
    if kind in ("bar", "pie", "treemap", "funnel"):
        return group_aggregate(df, spec)
    if kind == "histogram":
        return histogram(filtered(df, spec), spec.x)
    if kind == "box":
        return box(filtered(df, spec), spec.y or spec.x, spec.x if spec.y else None)
    if kind in ("scatter", "violin", "strip"):
        return hash_sample(filtered(df, spec).select(spec.x, *([spec.y] if spec.y else []), *([spec.color] if spec.color else [])).dropna())
    if kind == "heatmap":
        if spec.x and spec.y:
            return contingency(filtered(df, spec), spec.y, spec.x)
        return correlation_pairs(filtered(df, spec), [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint") or t.startswith("decimal")])
    raise ValueError(f"unknown chart type {kind!r}")
