"""Questions compiled to requests, and answered together from one scan."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.functions import questions
from lakeloom.operators import answers, charts

NUMERIC, CATEGORIES, TIMES = ["sales", "profit"], ["category", "region"], ["order_date"]


@pytest.fixture(scope="module")
def table(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(days=i), ("Electronics", "Clothing", "Books")[i % 3], ("North", "South", "East")[i % 3], (100, 200, 50)[i % 3], (20, 40, 10)[i % 3]) for i in range(30)]
    return spark.createDataFrame(rows, "order_date timestamp, category string, region string, sales int, profit int")


def ask(spark, question, numeric=NUMERIC, categories=CATEGORIES, times=TIMES, direct=False):
    df = spark.createDataFrame([(1, question)], "id int, question string")
    return questions.compile_requests(df, "question", numeric, categories, times, direct).first()


CASES = [
    ("show monthly sales trend", {"chart_type": "time_series", "x": "order_date", "y": "sales", "granularity": "monthly"}),
    ("compare category by sales", {"chart_type": "bar", "x": "category", "y": "sales"}),
    ("distribution of profit", {"chart_type": "histogram", "x": "profit"}),
    ("relationship between sales and profit", {"chart_type": "scatter"}),
    ("pie chart of category", {"chart_type": "pie", "x": "category"}),
    ("show correlation heatmap", {"chart_type": "heatmap"}),
    ("how many records per region", {"chart_type": "bar", "agg": "count", "x": "region"}),
    ("average sales by category", {"agg": "mean"}),
    ("total profit by region", {"agg": "sum"}),
    ("top 5 category by sales", {"top_n": 5}),
    ("summary", {"request": "text", "reply": "summary", "chart_type": None}),
    ("what columns are there", {"reply": "columns"}),
    ("what can I do with this data", {"reply": "help"}),
    ("what we can do with data", {"reply": "help"}),
    ("Hello!", {"reply": "help"}),
    ("give me insights", {"reply": "insights"}),
    ("", {"request": "text", "reply": questions.REPLIES["empty"]}),
    (None, {"request": "text", "reply": questions.REPLIES["empty"]}),
    ("count by order_date weekly", {"chart_type": "time_series", "agg": "count", "granularity": "weekly"}),

]


def test_requests(spark):
    """All questions are compiled together."""
    df = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(CASES)], "id int, question string")
    got = {r["id"]: r for r in questions.compile_requests(df, "question", NUMERIC, CATEGORIES, TIMES).collect()}
    for n, (question, want) in enumerate(CASES):
        assert (question, {k: got[n][k] for k in want}) == (question, want)


def test_requests_without_some_columns(spark):
    assert ask(spark, "show me something", numeric=[])["chart_type"] == "bar"
    assert ask(spark, "compare something", categories=[])["reply"] == questions.REPLIES["bar"]
    assert "No datetime" in ask(spark, "show trend", times=[])["reply"]
    assert "Need at least 2" in ask(spark, "scatter plot", numeric=["sales"])["reply"]
    assert ask(spark, "heatmap", numeric=[])["reply"] == questions.REPLIES["heatmap"]
    assert ask(spark, "anything", numeric=[], categories=[], times=[])["request"] == "text"


def test_direct_answers(spark, table):
    asked = ["what is the total sales", "what is the average profit", "how many rows", "how many category", "top 1 region by sales", "pie chart of region"]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, question string")
    made = questions.compile_requests(df, "question", NUMERIC, CATEGORIES, TIMES, direct=True)
    got = {(r["id"], r["place"]): (r["key"], r["value"]) for r in answers.answer(table, made).collect()}
    assert got == {(0, 1): ("", 3500.0), (1, 1): ("", pytest.approx(700 / 30)), (2, 1): ("", 30.0), (3, 1): ("", 3.0), (4, 1): ("South", 2000.0), (5, 1): ("East", 10.0), (5, 2): ("North", 10.0), (5, 3): ("South", 10.0)}


def test_answers_equal_single_charts(spark, table):
    """Every chart request gives the same rows from the shared scan as by itself, and the other kinds build."""
    asked = ["show monthly sales trend", "compare category by sales", "distribution of profit", "relationship between sales and profit", "pie chart of region", "how many records per category", "correlation heatmap", "top 3 category by sales", "average profit by region", "weekly profit trend by region", "median sales by region"]
    df = spark.createDataFrame([*enumerate(asked), (99, asked[1])], "id int, question string")
    made = questions.compile_requests(df, "question", NUMERIC, CATEGORIES, TIMES)
    got: dict = {}
    for r in answers.answer(table, made).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["key"], r["color"], r["value"]))
    for r in made.collect():
        alone = charts.build(table, answers.spec(r))
        if r["chart_type"] in ("bar", "time_series"):
            key = "period" if r["chart_type"] == "time_series" else r["x"]
            want = [(x[key], x[r["color"]] if r["color"] else None, pytest.approx(float(x["value"]))) for x in alone.collect()]
            assert got[r["id"]] == want
        elif r["chart_type"] == "histogram":
            assert [(int(k), v) for k, _, v in got[r["id"]]] == [(x["bin"], x["n"]) for x in alone.collect()]
        else:
            assert alone.count() > 0
    assert got[99] == got[1]


def test_answers_of_odd_tables(spark, table):
    asked = spark.createDataFrame([(1, "average sales by category"), (2, "distribution of sales"), (3, "how many rows"), (4, "summary")], "id int, question string")
    made = questions.compile_requests(asked, "question", NUMERIC, CATEGORIES, TIMES, direct=True)
    gaps = table.withColumns({"category": F.when(F.col("category") != "Books", F.col("category")), "sales": F.when(F.col("region") != "South", F.col("sales"))})
    got = [(r["id"], r["key"], r["value"]) for r in answers.answer(gaps, made).orderBy("id", "place").collect()]
    assert (1, "Electronics", 100.0) in got and not [g for g in got if g[0] == 1 and g[1] != "Electronics"] and (3, "", 30.0) in got
    assert [r["id"] for r in answers.answer(table.limit(0), made).collect()] == []
    assert answers.answer(table, made.where("id = 4")).collect() == []
