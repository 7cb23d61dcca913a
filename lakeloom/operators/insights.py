"""Findings about a table, as rows of numbers and short texts made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import words
from . import charts, profile, scoring
from .charts import ChartSpec
from .quantiles import of_columns

FINDINGS = "kind string, subject string, detail string, value double"


def domain(columns: list[str]) -> str:
    """The domain whose words the column names have most of; general for none."""
    text = " ".join(columns).lower()
    counts = {d: sum(w in text for w in parts) for d, parts in words.DOMAINS.items()}
    best = max(counts, key=lambda d: counts[d])
    return best if counts[best] else "general"


def findings(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """Dominant categories (30 %), best and worst group means, the strongest correlation (0.4), 2-sigma outliers: as rows."""
    parts = []
    if categories:
        top = profile.top_share(df, categories).where("known_share >= 0.3")
        parts.append(top.select(F.lit("dominant").alias("kind"), F.col("name").alias("subject"), F.col("value").alias("detail"), F.col("known_share").alias("value")))
    if categories and numeric:
        sides = charts.extremes(df, categories[0], numeric[0])
        parts.append(sides.select("side", F.lit(f"{numeric[0]} by {categories[0]}"), F.col("key").cast("string"), F.col("value").cast("double")))
    if len(numeric) > 1:
        pair = charts.correlation_pairs(df, numeric).where("abs(r) > 0.4").orderBy(F.desc(F.abs("r")), "a", "b").limit(1)
        parts.append(pair.select(F.when(F.abs("r") > 0.7, "strong_correlation").otherwise("correlation"), F.concat_ws(" and ", "a", "b"), F.lit(None).cast("string"), "r"))
    for c in numeric:
        parts.append(scoring.two_sigma(df, c).where("outliers > 0").select(F.lit("outliers"), F.lit(c), F.col("outliers").cast("string"), "share"))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], FINDINGS)
    for p in parts[1:]:
        out = out.union(p)
    return out


def takeaways(df: DataFrame) -> DataFrame:
    """``place, kind, subject, value``: size, missing share, most varied column, dominant category, strongest correlation, outliers."""
    stats = profile.column_stats(df)
    known = profile.kinds(df)
    numeric = [c for c, k in known.items() if k == "numeric" and not any(p in c.lower() for p in words.ID_PARTS)]
    categories = [c for c, k in known.items() if k == "string"]
    rows = [
        stats.agg(F.lit(1).alias("place"), F.lit("rows").alias("kind"), F.lit("all").alias("subject"), F.max("rows").cast("double").alias("value")),
        stats.agg(F.lit(2), F.when(E.ratio(F.sum("missing"), F.sum("rows")) > 0.05, "missing_many").when(E.ratio(F.sum("missing"), F.sum("rows")) > 0.01, "missing_some").otherwise("complete"), F.lit("all"), E.ratio(F.sum("missing"), F.sum("rows"))),
    ]
    cv = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    rows.append(stats.where(F.col("name").isin(numeric)).withColumn("cv", cv).where("cv is not null").orderBy(F.desc("cv"), "name").limit(1).select(F.lit(3), F.lit("varied"), "name", "cv"))
    if categories:
        top = profile.top_share(df, categories).where("known_share > 0.3 and 100 * (known_share - least_share) >= 5").orderBy(F.desc("known_share"), "name").limit(1)
        rows.append(top.select(F.lit(4), F.lit("dominant"), F.concat_ws("=", "name", "value"), "known_share"))
    if len(numeric) > 1:
        rows.append(charts.correlation_pairs(df, numeric).where("abs(r) > 0.2").orderBy(F.desc(F.abs("r")), "a", "b").limit(1).select(F.lit(5), F.lit("correlation"), F.concat_ws(" and ", "a", "b"), "r"))
    fences = stats.where(F.col("name").isin(numeric[:5])).where("q3 > q1").select("name", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))
    if numeric:
        cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in numeric[:5]))
        outside = df.select(F.inline(cells)).join(F.broadcast(fences), "name").groupBy("name").agg(F.avg((~F.col("v").between(F.col("lo"), F.col("hi"))).cast("double")).alias("share"))
        rows.append(outside.where("share > 0.05").orderBy(F.desc("share"), "name").limit(1).select(F.lit(6), F.lit("outliers"), "name", "share"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def comparison(df: DataFrame, by: str, y: str, agg: str = "sum") -> DataFrame:
    """Leader, last, their ratio, and shares of the first and the first three groups."""
    groups = charts.aggregate(df, [F.col(by).cast("string").alias("key")], charts.number(df, y), agg, "value")
    ends = groups.agg(F.max(F.struct("value", "key")).alias("top"), F.min(F.struct("value", "key")).alias("low"), F.sum("value").alias("total"), F.count("*").alias("groups"))
    top3 = groups.orderBy(F.desc("value"), "key").limit(3).agg(F.sum("value").alias("top3"))
    return ends.crossJoin(top3).select(
        F.col("top.key").alias("leader"), F.col("top.value").cast("double").alias("leader_value"), F.col("low.key").alias("last"), E.ratio(F.col("top.value"), F.col("low.value")).alias("ratio"),
        E.ratio(F.col("top.value"), F.col("total")).alias("share"), E.ratio(F.col("top3"), F.col("total")).alias("top3_share"), "groups",
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, spread, bias-corrected skewness and its class, and 2-sigma outliers of a column."""
    c = F.col(column).cast("double")
    median = F.lit(of_columns(df, {"c": c}, (0.5,)).get("c", [None])[0]).cast("double")
    row = df.agg(F.avg(c).alias("mean"), median.alias("median"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), E.skew(c).alias("skew"), F.count(c).alias("n"))
    shape = F.when(F.col("skew") > 1, "right").when(F.col("skew") > 0.5, "slightly right").when(F.col("skew") < -1, "left").when(F.col("skew") < -0.5, "slightly left").otherwise("symmetric")
    return row.crossJoin(scoring.two_sigma(df, column).select("outliers")).withColumn("shape", shape)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """``r, strength, direction`` of two columns."""
    row = df.agg(E.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").when(F.abs("r") >= 0.3, "weak").otherwise("none")
    return row.select("r", strength.alias("strength"), F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none").alias("direction"))


def superlative(df: DataFrame, by: str, y: str, lowest: bool = False) -> DataFrame:
    """``place, key, value, n``: the three groups with the highest (lowest) mean."""
    y_ = charts.number(df, y)
    groups = df.where(F.col(by).isNotNull() & y_.isNotNull()).groupBy(F.col(by).cast("string").alias("key")).agg(F.avg(y_).alias("value"), F.count("*").alias("n"))
    best = groups.orderBy(F.asc("value") if lowest else F.desc("value"), "key").limit(3)
    return best.agg(F.array_sort(F.collect_list(F.struct((F.col("value") if lowest else -F.col("value")).alias("o"), "key", "value", "n"))).alias("g")).select(F.posexplode("g").alias("p", "s")).select((F.col("p") + 1).alias("place"), "s.key", "s.value", "s.n")


def suggestions(df: DataFrame) -> list[ChartSpec]:
    """Charts worth a look, from column scores: ranking, share, distribution, box, scatter, trend, heatmap."""
    scores = {r["name"]: (r["kind"], r["score"]) for r in scoring.business_scores(df).collect()}  # a row for each column
    by = lambda kind: sorted((c for c, (k, s) in scores.items() if k == kind and s > 0), key=lambda c: (-scores[c][1], c))
    numeric, categories = by("numeric"), by("string")
    times = [c for c, k in profile.kinds(df).items() if k == "datetime"]
    out: list[ChartSpec] = []
    if numeric and categories:
        out += [ChartSpec("bar", categories[0], numeric[0], agg="mean", sort_by="y_desc", top_n=15, title="ranking"), ChartSpec("pie", categories[0], numeric[0], top_n=10, title="composition")]
        out.append(ChartSpec("box", categories[0], numeric[0], title="spread"))
    if numeric:
        out.append(ChartSpec("histogram", numeric[0], title="distribution"))
    if len(numeric) > 1:
        out.append(ChartSpec("scatter", numeric[0], numeric[1], title="relation"))
    if times and numeric:
        out.append(ChartSpec("time_series", times[0], numeric[0], granularity=scoring.granularity(df, times[0]).first()["granularity"], title="trend"))
    if len(numeric) > 2:
        out.append(ChartSpec("heatmap", title="correlations"))
    return out


def story(df: DataFrame, categories: list[str], metric: str | None, time: str | None, granularity: str = "monthly") -> list[ChartSpec]:
    """Charts in the order of a story: overview by category, trend split by it, a look into its top value, volume, spread."""
    out: list[ChartSpec] = []
    for c in categories[:1]:
        out.append(ChartSpec("bar", c, metric, agg="sum" if metric else "count", sort_by="y_desc", top_n=12, title="overview"))
        if time:
            out.append(ChartSpec("time_series", time, metric, color=c, agg="sum" if metric else "count", granularity=granularity, title="trend"))
        top = charts.value_counts(df, c, 1).first()
        if top and len(categories) > 1:
            out.append(ChartSpec("bar", categories[1], metric, agg="sum" if metric else "count", sort_by="y_desc", top_n=10, filter_col=c, filter_val=str(top["value"]), title="inside the top"))
        out.append(ChartSpec("bar", c, agg="count", sort_by="y_desc", top_n=20, title="volume"))
    if metric:
        out.append(ChartSpec("histogram", metric, title="spread"))
    return out


def headline(row, by: str, y: str) -> str:
    """One sentence about a ``comparison`` row."""
    if row["ratio"] is not None and row["ratio"] > 1.3:
        return f"{row['leader']} has {row['ratio']:.1f} times the {y} of {row['last']}"
    return f"{row['leader']} leads {y} by {by} with {100 * (row['share'] or 0):.0f} %"
