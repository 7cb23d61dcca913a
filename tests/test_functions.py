"""Column expressions against literals."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import exprs as E
from lakeloom.functions import questions
from lakeloom.operators import charts


def values(spark, kind, items, column):
    df = spark.createDataFrame([(x,) for x in items], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_clean_number(spark):
    given_ = ["($1,234.50)", "10 kg", "USD100", "€ 10.00", "50%", "abc", None, "", "1d", "-3.5"]
    assert values(spark, "string", given_, E.clean_number) == [-1234.5, 10.0, 100.0, 10.0, 50.0, None, None, None, 1.0, -3.5]


def test_to_number_takes_whole_numbers_only(spark):
    assert values(spark, "string", ["1.5", " 2 ", "1d", "", None, "1e3", "nan"], E.to_number) == [1.5, 2.0, None, None, None, 1000.0, None]


def test_to_time(spark):
    got = values(spark, "string", ["2024-01-05", "01/05/2024", "2024/01/05", "no", None], lambda c: F.date_format(E.to_time(c), "yyyy-MM-dd"))
    assert got == ["2024-01-05"] * 3 + [None, None]


@pytest.mark.parametrize(("every", "label"), [("daily", "2024-01-07"), ("weekly", "2024-01-01/2024-01-07"), ("monthly", "2024-01"), ("quarterly", "2024Q1"), ("yearly", "2024")])
def test_period(spark, every, label):
    assert values(spark, "timestamp", [dt.datetime(2024, 1, 7, 23)], lambda c: E.period(c, every)) == [label]


def test_moments_match_the_bias_corrected_ones(spark):
    x = [1.0, 2.0, 2.5, 9.0, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    row = df.agg(E.skew(F.col("v")).alias("s"), E.kurtosis(F.col("v")).alias("k")).first()
    n, m = len(x), sum(x) / len(x)
    m2, m3, m4 = (sum((v - m) ** p for v in x) / n for p in (2, 3, 4))
    assert row["s"] == pytest.approx(m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["k"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6))


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, None), (3.0, 4.0)], "a double, b double")
    row = df.agg(E.skew(F.col("a")).alias("s"), E.kurtosis(F.col("a")).alias("k"), E.corr(F.col("a"), F.col("b")).alias("r"), E.skew(F.when(F.col("b") < 3, F.col("b"))).alias("few")).first()
    assert (row["s"], row["k"], row["r"], row["few"]) == (0.0, 0.0, None, None)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=30))
def test_clip_keeps_bounds(spark, items):
    got = values(spark, "int", items, lambda c: E.clip(c, -10, 10))
    assert got == [max(-10, min(10, x)) for x in items]


def test_format_number():
    assert [E.format_number(x) for x in (None, 3, 1234, 2.5, 12345678.9)] == ["-", "3", "1,234", "2.50", "12,345,678.90"]


PROMPTS = [
    ("show monthly sales trend", {"intent": "time_series", "x": "order_date", "y": "sales"}), ("compare category by sales", {"intent": "bar", "x": "category", "y": "sales"}),
    ("distribution of profit", {"intent": "histogram", "x": "profit"}), ("relationship between sales and profit", {"intent": "scatter"}), ("pie chart of category", {"intent": "pie", "x": "category", "y": None}),
    ("show correlation heatmap", {"intent": "heatmap"}), ("how many records per region", {"intent": "count", "x": "region", "agg": "count"}), ("average sales by category", {"agg": "mean"}),
    ("total profit by region", {"agg": "sum", "x": "region", "y": "profit"}), ("top 5 category by sales", {"top_n": 5, "intent": "bar"}),
]


def test_questions(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(PROMPTS)], "id int, q string")
    got = {r["id"]: r for r in questions.annotate(df, "q", ["sales", "profit"], ["category", "region"], ["order_date"]).collect()}
    for i, (q, wanted) in enumerate(PROMPTS):
        assert {k: got[i][k] for k in wanted} == wanted, q


def test_charts_of_a_small_table(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), ("Electronics", "Clothing", "Books")[i % 3], (100, 200, 50)[i % 3], (20, 40, 10)[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "order_date timestamp, category string, sales long, profit long")
    bars = charts.build(df, charts.ChartSpec("bar", "category", "sales", sort_by="y_desc")).collect()
    assert [(r["category"], r["value"]) for r in bars] == [("Clothing", 2000), ("Electronics", 1000), ("Books", 500)]
    assert [tuple(r) for r in charts.build(df, charts.ChartSpec("time_series", "order_date", "sales", granularity="monthly")).collect()] == [("2024-01", 3500)]
    assert charts.correlation_pairs(df, ["sales", "profit"]).first()["r"] == pytest.approx(1.0)
    for kind in ("bar", "pie", "histogram", "box", "scatter", "heatmap", "treemap"):
        spec = charts.ChartSpec(kind, None if kind == "heatmap" else "sales" if kind in ("histogram", "scatter") else "category", "profit" if kind in ("scatter", "bar", "pie", "box", "treemap") else None)
        assert charts.build(df, spec).count() > 0
    with pytest.raises(ValueError):
        charts.build(df, charts.ChartSpec("bar", "nothing"))
    with pytest.raises(ValueError):
        charts.build(df, charts.ChartSpec("bar", "category", "sales", agg="mode"))
