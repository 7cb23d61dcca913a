"""How useful and how sound columns are, and the key figures of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import words
from . import profile
from .ordered import with_previous


def business_scores(df: DataFrame) -> DataFrame:
    """``name, kind, score``: variation, range and name of numeric columns; number, name and spread of categories."""
    stats = profile.column_stats(df, wanted=("mean", "std", "min", "max", "distinct")).where(F.col("kind").isin("numeric", "string", "boolean"))
    stats = stats.join(profile.top_share(df, [c for c, k in profile.kinds(df).items() if k != "complex"]), "name", "left")
    low, n, d = F.lower("name"), F.col("rows"), F.col("distinct")
    id_name = E.any_of(low, words.ID_PARTS)
    cv = F.col("std") / (F.abs("mean") + 1e-9)
    spread = F.col("max") - F.col("min")
    numeric = (
        F.when(cv > 1, 3.0).when(cv > 0.5, 2.0).when(cv > 0.1, 1.0).otherwise(0.2) + F.when(spread > 100, 1.5).when(spread > 10, 1.0).when(spread > 1, 0.5).otherwise(0.1)
        + F.when(E.any_of(low, words.HIGH_VALUE), 3.0).when(E.any_of(low, words.MEDIUM_VALUE), 1.5).otherwise(0.0)
    ) * F.when(d <= 7, 0.5).otherwise(1.0)
    numeric = F.when(id_name | low.isin(list(words.ID_NAMES)) | ((d > 0.9 * n) & (n > 50)), 0.0).otherwise(numeric)
    even = (d > 1) & (100 * (F.col("known_share") - F.col("least_share")) < 5)
    text = (F.when(d.between(3, 15), 2.5).when(d.between(2, 30), 1.5).when(d <= 50, 0.5).otherwise(0.1) + F.when(E.any_of(low, words.MEDIUM_VALUE), 2.0).otherwise(0.0)) * F.when(even, 0.3).otherwise(1.0)
    text = F.when(id_name | (d > 0.9 * n), 0.0).otherwise(text)
    return stats.select("name", "kind", F.round(F.when(F.col("kind") == "numeric", numeric).otherwise(text), 2).alias("score"))


def semantic(name: Column) -> Column:
    """``meaning, importance`` that a column's name suggests."""
    out = F.struct(F.lit("unknown").alias("meaning"), F.lit(0.4).alias("importance"))
    for parts, meaning, importance in reversed(words.SEMANTIC):
        out = F.when(E.any_of(F.lower(name), parts), F.struct(F.lit(meaning).alias("meaning"), F.lit(importance).alias("importance"))).otherwise(out)
    return out


def stat_scores(df: DataFrame) -> DataFrame:
    """``name, stat_score, meaning, semantic_score, score`` of numeric columns; -999 where no value is valid."""
    numeric = [c for c, k in profile.kinds(df).items() if k == "numeric"]
    stats = profile.column_stats(df.select(*numeric), wanted=("std", "zeros", "distinct")).join(profile.top_share(df, numeric).select("name", "known_share"), "name", "left")
    n = F.col("rows") - F.col("missing")
    spread = F.when(F.col("std") > 0, F.least(F.log1p("std"), F.lit(10.0))).otherwise(0.0)
    stat = 20 * n / F.col("rows") + 15 * (1 - F.col("zeros") / n) + spread - F.when(F.col("distinct") / n > 0.98, 20.0).otherwise(0.0) - F.when(F.col("known_share") > 0.9, 12.0).otherwise(0.0)
    out = stats.withColumn("stat_score", F.when(n == 0, -999.0).otherwise(stat)).withColumn("s", semantic(F.col("name")))
    named = 40 * F.col("s.importance") - F.when(F.col("s.meaning") == "identifier", 20.0).otherwise(0.0)
    return out.select("name", "stat_score", "s.meaning", F.when(n == 0, 0.0).otherwise(named).alias("semantic_score"), F.when(n == 0, -999.0).otherwise(0.5 * F.col("stat_score") + 0.5 * named).alias("score"))


def best_datetime(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, score`` of datetime columns: valid share and distinct values, best first."""
    row = df.agg(F.count("*").alias("rows"), *(x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"))))
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), (20 * F.col(f"n{i}") / F.col("rows") + F.least(F.col(f"d{i}") / 10, F.lit(10.0))).alias("score")) for i, c in enumerate(columns)))
    return row.select(F.inline(cells)).orderBy(F.desc("score"), "i").select("name", "score")


def granularity(df: DataFrame, column: str) -> DataFrame:
    """``gap_days, granularity`` from the median gap between neighbouring times; monthly for fewer than three.

    Times are counted first, so the ordered pass runs over distinct times; equal times count as gaps of zero.
    """
    times = df.where(F.col(column).isNotNull()).groupBy(F.unix_micros(F.col(column).cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))
    gaps = with_previous(times, ["t"], "t", "before").withColumn("gap", F.col("t") - F.col("before"))
    each = gaps.select("gap", F.lit(1).cast("long").alias("w"), "n").where("gap is not null").select("gap", "w").union(times.where("n > 1").select(F.lit(0).cast("long"), F.col("n") - 1))
    weighted = each.groupBy("gap").agg(F.sum("w").alias("w"))
    row = weighted.agg(F.expr("percentile(gap, 0.5, w)").alias("gap"), F.sum("w").alias("n"))
    days = F.col("gap") / 86_400e6
    label = F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, "monthly").when(days <= 1, "daily").when(days <= 7, "weekly").when(days <= 31, "monthly").when(days <= 92, "quarterly").otherwise("yearly")
    return row.select(days.alias("gap_days"), label.alias("granularity"))


def quality_warnings(df: DataFrame, few_rows: int = 50) -> DataFrame:
    """``score`` (100 less deductions) and the signs of made-up or poor data that led to it."""
    stats = profile.column_stats(df)
    names = [c for c, k in profile.kinds(df).items() if k == "string"]
    overall = stats.agg(F.max("rows").alias("rows"), E.ratio(F.sum("missing"), F.sum("rows")).alias("missing"))
    if names:
        even = profile.top_share(df, names).join(stats.select("name", "distinct"), "name").where(F.col("distinct").between(2, 50))
        even = even.agg(F.count_if(100 * (F.col("known_share") - F.col("least_share")) < 3).alias("even"), F.count("*").alias("categories"))
    else:
        even = df.sparkSession.range(1).select(F.lit(0).alias("even"), F.lit(0).alias("categories"))
    both = overall.crossJoin(even)  # one row each
    lost = F.when((F.col("categories") > 0) & (F.col("even") > 0.5 * F.col("categories")), 20).otherwise(0) + F.when(F.col("missing") > 0.2, 15).otherwise(0) + F.when(F.col("rows") < few_rows, 10).otherwise(0)
    return both.select((100 - lost).alias("score"), "even", "categories", F.col("missing").alias("missing_share"), "rows")


def kpis(df: DataFrame, most: int = 6) -> DataFrame:
    """``place, label, value``: the number of records, then columns by kind of name and score, then completeness; the first six."""
    found = business_scores(df).where("kind = 'numeric'").orderBy(F.desc("score"), "name").collect()  # a row for each column
    chosen: list[tuple[str, str, str]] = []
    for parts, agg, prefix in words.KPI:
        for r in found:
            if any(p in r["name"].lower() for p in parts) and all(r["name"] != c for c, _, _ in chosen):
                chosen.append((r["name"], agg, prefix))
                break
    stats = {r["name"]: r for r in profile.column_stats(df, wanted=("mean",)).collect()}
    for r in found:
        if len(chosen) >= 4:
            break
        s = stats[r["name"]]
        if all(r["name"] != c for c, _, _ in chosen) and s["mean"] is not None:
            many = abs(s["mean"] * (s["rows"] - s["missing"])) > 100 * abs(s["mean"])
            chosen.append((r["name"], "sum" if many else "mean", "Total" if many else "Average"))
    cells = [F.struct(F.lit("Records").alias("label"), F.count("*").cast("double").alias("value"))]
    cells += [F.struct(F.lit(f"{p} {c}").alias("label"), (F.sum(c) if a == "sum" else F.avg(c)).cast("double").alias("value")) for c, a, p in chosen]
    present = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    cells.append(F.struct(F.lit("Completeness").alias("label"), (100 * E.ratio(present, F.count("*") * len(df.columns))).alias("value")))
    return df.agg(F.array(*cells[:most]).alias("c")).select(F.posexplode("c").alias("place", "k")).select("place", "k.label", "k.value")


def significant(df: DataFrame, kind: str, x: str, y: str | None = None) -> DataFrame:
    """``significant`` and the measures behind it: correlation for scatter, spread for groups, variation for distributions."""
    if kind == "scatter":
        return df.agg(F.abs(E.corr(F.col(x).cast("double"), F.col(y).cast("double"))).alias("measure")).select(F.coalesce(F.col("measure") >= 0.15, F.lit(False)).alias("significant"), "measure")
    if kind == "distribution":
        row = df.agg(F.abs(F.try_divide(F.stddev_samp(x), F.avg(x))).alias("measure"), F.count_distinct(x).alias("d"))
        return row.select(F.coalesce((F.col("measure") >= 0.01) & (F.col("d") > 2), F.lit(False)).alias("significant"), "measure")
    groups = df.where(F.col(x).isNotNull()).groupBy(x).agg((F.sum(y) if y else F.count("*")).cast("double").alias("v"))
    row = groups.agg(F.try_divide(F.max("v") - F.min("v"), F.avg("v")).alias("measure"), (100 * F.try_divide(F.max("v") - F.min("v"), F.sum("v"))).alias("points"))
    return row.select(F.coalesce((F.col("measure") >= 0.05) & (F.col("points") >= 3), F.lit(False)).alias("significant"), "measure")


def two_sigma(df: DataFrame, column: str, by: float = 2.0) -> DataFrame:
    """``mean, std, outliers, share``: values further from the mean than ``by`` sample standard deviations."""
    c = F.col(column).cast("double")
    ends = F.broadcast(df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")))  # one row
    return df.crossJoin(ends).groupBy("mean", "std").agg(F.count_if(F.abs(c - F.col("mean")) > by * F.col("std")).alias("outliers"), F.count(c).alias("n")).withColumn("share", E.ratio(F.col("outliers"), F.col("n"))).drop("n")
