"""Answers to a table of questions about one table, all from one scan.

Questions are compiled to requests (``questions.compile_requests``). Requests with the same keys and measure are one cell;
each row of the table gives one small row for each cell, and one aggregate by cell and key holds every sum, mean, count and
extreme that any question needs. So a thousand questions read the table once, and shuffle partial sums only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import charts
from .charts import ChartSpec

BINS = 30
_CELL = ("chart_type", "x", "y", "color", "granularity")


def spec(row) -> ChartSpec:
    """The chart request of one compiled question, for ``charts.build``."""
    return ChartSpec(row["chart_type"], row["x"], row["y"], row["color"], row["agg"] or "sum", row["top_n"], row["granularity"], row["sort_by"])


def _keys(df: DataFrame, r, ends: dict[str, tuple[float, float]]) -> tuple[Column, Column, Column]:
    """Both keys of a cell, and what it measures (a constant where rows are counted)."""
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    if r["request"] in ("rows", "stat", "distinct"):
        if r["request"] == "distinct":
            return F.col(r["x"]).cast("string"), none, one
        return F.lit(""), none, one if r["request"] == "rows" else charts.number(df, r["x"]).cast("double")
    y = charts.number(df, r["y"]).cast("double") if r["y"] else one
    if r["chart_type"] == "time_series":
        stamp = E.to_time(F.col(r["x"])) if dict(df.dtypes)[r["x"]] == "string" else F.col(r["x"])
        return E.period(stamp, r["granularity"]), F.col(r["color"]).cast("string") if r["color"] else none, y
    if r["chart_type"] == "histogram":
        low, high = ends[r["x"]]
        value = E.finite(charts.number(df, r["x"]).cast("double"))
        place = F.floor((value - low) / (high - low) * BINS) if high > low else F.when(value.isNotNull(), 0)
        return F.lpad(F.least(place, F.lit(BINS - 1)).cast("string"), 2, "0"), none, one
    return F.col(r["x"]).cast("string"), F.col(r["color"]).cast("string") if r["color"] else none, y


def answer(df: DataFrame, asked: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, place, key, color, value`` for every compiled question that counts or adds up: its rows in their order.

    Bars are the ``top_n`` largest (equals by key), pies and trends stand by key, histograms by bin number (of 30, ``00``
    on), scalars and numbers of rows or distinct values have one row with an empty key. Rows with a null key or measure do not count, and
    NaN neither. Questions with a reply, and scatters and heatmaps (see ``spec``), have no rows here; repeated questions are answered
    each. The different requests, not the questions, come to the driver.
    """
    spark = df.sparkSession
    usable = F.col("request").isin("rows", "stat", "distinct") | F.col("chart_type").isin("bar", "pie", "time_series", "histogram")
    asked = asked.where(usable)
    wanted = [c for c in ("request", *_CELL, "agg", "top_n", "sort_by")]
    found = asked.select(*wanted).distinct().collect()
    schema = "id long, place int, key string, color string, value double"
    if not found:
        return spark.createDataFrame([], schema.replace("id long", f"id {dict(asked.dtypes)[id_col]}"))
    binned = sorted({r["x"] for r in found if r["chart_type"] == "histogram"})
    ends: dict[str, tuple[float, float]] = {}
    if binned:
        value = {c: E.finite(charts.number(df, c).cast("double")) for c in binned}
        row = df.agg(*(x for i, c in enumerate(binned) for x in (F.min(value[c]).alias(f"l{i}"), F.max(value[c]).alias(f"h{i}")))).first()
        ends = {c: (row[f"l{i}"] or 0.0, row[f"h{i}"] or 0.0) for i, c in enumerate(binned)}
    cells: dict[tuple, int] = {}
    rows = []
    for n, r in enumerate(found):
        same = (r["request"] if r["request"] != "chart" else r["chart_type"] if r["chart_type"] in ("time_series", "histogram") else "group", *(r[c] for c in _CELL[1:]))
        rows.append((n, cells.setdefault(same, len(cells))))
    parts = {cells[k]: next(r for (n, c), r in zip(rows, found, strict=True) if c == cells[k]) for k in cells}
    structs = []
    for c in range(len(cells)):
        key, color, y = _keys(df, parts[c], ends)
        kept_color = F.lit(True) if not parts[c]["color"] else color.isNotNull()
        structs.append(F.struct(F.lit(c).alias("cell"), key.alias("key"), color.alias("color"), F.when(kept_color, F.nanvl(y, F.lit(None).cast("double"))).alias("y")))
    flat = df.select(F.inline(F.array(*structs))).where("key is not null and y is not null")
    median = [E.quantile(F.col("y"), 0.5).alias("median")] if any(r["agg"] == "median" for r in found) else [F.lit(None).cast("double").alias("median")]
    sums = flat.groupBy("cell", "key", "color").agg(F.count("*").cast("double").alias("count"), F.sum("y").alias("sum"), F.avg("y").alias("mean"), F.min("y").alias("min"), F.max("y").alias("max"), *median)
    request = F.broadcast(spark.createDataFrame([(n, c, r["request"], r["chart_type"], r["agg"] or "count", r["top_n"], r["sort_by"]) for (n, c), r in zip(rows, found, strict=True)], "n int, cell int, request string, chart_type string, agg string, top_n int, sort_by string"))
    value = F.lit(None).cast("double")
    for agg in ("sum", "mean", "count", "min", "max", "median"):
        value = F.when(F.col("agg") == agg, F.col(agg)).otherwise(value)
    valued = sums.join(request, "cell").withColumn("value", value)
    plain = valued.where("request <> 'distinct'")
    distinct = valued.where("request = 'distinct'").groupBy("n").agg(F.count("*").cast("double").alias("value")).select("n", F.lit("").alias("key"), F.lit(None).cast("string").alias("color"), "value", F.lit(1).alias("place"))
    order = Window.partitionBy("n").orderBy(F.when(F.col("sort_by") == "y_desc", -F.col("value")), "key", "color")
    placed = plain.withColumn("place", F.row_number().over(order)).where(F.col("top_n").isNull() | (F.col("place") <= F.col("top_n"))).select("n", "key", "color", "value", "place").union(distinct)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in wanted]
    numbered = spark.createDataFrame([(n, *(r[c] for c in wanted)) for n, r in enumerate(found)], "n int, " + ", ".join(f"{c} {'int' if c == 'top_n' else 'string'}" for c in wanted))
    joined = asked.alias("a").join(F.broadcast(numbered).alias("b"), on=[x for x in same]).select(F.col(f"a.{id_col}").alias("id"), F.col("b.n").alias("n"))
    return joined.join(placed, "n").select("id", "place", "key", "color", "value")
