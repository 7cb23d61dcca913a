"""Operators on small literal tables: the fixture with injected faults, edge cases, and models that must learn."""

import itertools
import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lakeloom.functions import names
from lakeloom.operators import charts, cleaning, encoders, explain, features, insights, learners, meta_features, metrics, models, neighbours, ordered, profile, quantiles, scoring, tuning
from lakeloom.plans import stages
from lakeloom.sources import cache, files, synthetic
from lakeloom.streaming import windows


@pytest.fixture(scope="module")
def faults(spark):
    random.seed(42)
    rows = []
    for i in range(100):
        age = None if i in (3, 13, 23, 33, 43) else 9999.0 if i == 50 else float(random.randint(18, 64))
        rows.append((i, age, random.expovariate(1 / 50000), ("Male", "male", "MALE", "Female", "female")[i % 5], ("NYC", "LA", "Chicago")[i % 3], None if i % 4 == 1 else random.uniform(0, 100), ("yes", "no")[i % 2]))
    rows += rows[10:15]
    return spark.createDataFrame(rows, "id_col long, age double, income double, gender string, city string, score double, survived string")


def test_profile_of_faults(faults):
    got = {r["name"]: r for r in profile.roles(faults).collect()}
    assert got["age"]["role"] == "numeric" and 0.03 < got["age"]["missing_share"] < 0.07
    assert got["city"]["role"] == "categorical" and got["id_col"]["role"] in ("id", "numeric")
    assert profile.target([(r["name"], r["role"], r["distinct"]) for r in sorted(got.values(), key=lambda r: r["position"])]) == "survived"
    assert profile.task(got["survived"]["role"], got["survived"]["distinct"]) == "classification"
    assert 0.2 < got["score"]["missing_share"] < 0.3
    found = {(r["name"], r["anomaly"]) for r in profile.anomalies(faults).collect()}
    assert ("age", "extreme_high_outlier") in found
    variants = {r["canon"]: r["variants"] for r in profile.uniformity(faults, "gender").collect()}
    assert variants["male"] == ["MALE", "Male", "male"]
    assert 50 < profile.quality_score(faults).first()["score"] < 100
    assert profile.duplicates(faults).first()["duplicates"] == 5


def test_clean_faults(faults):
    out, report = cleaning.clean(faults)
    assert (report.rows_before, report.rows_after) == (105, 100)
    row = out.agg(F.max("age").alias("age"), F.count("score").alias("n"), F.count_distinct("gender").alias("g")).first()
    assert row["age"] < 9999 and row["n"] == 100 and row["g"] == 2
    lo, hi, _ = report.bounds["age"]
    assert out.where(~F.col("age").between(lo - 1e-3, hi + 1e-3)).isEmpty()
    assert report.strategies["score"] == "knn"


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, None, True, [1.0], "a b c d e f g"), (float("nan"), None, False, None, None)], "x double, e string, b boolean, a array<double>, t string")
    got = {r["name"]: r for r in profile.roles(df).collect()}
    assert got["x"]["missing"] == 1 and got["e"]["role"] == "empty" and got["b"]["role"] == "binary" and got["a"]["role"] == "complex"
    empty = df.limit(0)
    assert {r["rows"] for r in profile.column_stats(empty).collect()} == {0}
    assert profile.quality_score(empty).first()["score"] <= 100


def test_fuzzy_filter_tiers(spark):
    df = spark.createDataFrame([("Apple",), ("apple",), ("pineapple",), (None,), ("app",)], "v string")
    tier = lambda v: sorted(r["v"] for r in charts.fuzzy_filter(df, "v", v).collect())
    assert tier("Apple") == ["Apple"] and tier("APPLE") == ["Apple", "apple"] and tier("pine") == ["pineapple"] and tier("apps") == ["app"] and tier("zzz") == []


def test_null_keys_and_ties(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 5), ("c", None)], "k string, v int")
    out = charts.build(df, charts.ChartSpec("bar", "k", "v", sort_by="y_desc", top_n=1)).collect()
    assert [(r["k"], r["value"]) for r in out] == [("a", 1)]
    assert charts.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()[0]["n"] == 2


def test_impute_tiers(spark):
    df = spark.range(100).select(F.when(F.col("id") % 25 != 0, F.col("id").cast("double")).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id").cast("double")).alias("c"), F.when(F.col("id") % 2 == 0, "x").alias("s"))
    out, how = cleaning.impute(df)
    assert how == {"a": "mean", "c": "median_indicator", "s": "constant"}
    assert out.where("a is null or c is null or s is null").isEmpty() and out.agg(F.sum("c_missing")).first()[0] == 34


def test_impute_knn(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 1.1, 11.0), (3, 5.0, 50.0), (4, 5.1, 51.0), (5, 1.05, None)], "id int, a double, b double")
    got = cleaning.impute_knn(df, ["a", "b"], "id", k=2).where("id = 5").first()["b"]
    assert got == pytest.approx(10.5)


def test_numbers_in_strings(spark):
    df = spark.createDataFrame([("$1",), ("2 kg",), ("(3)",), ("4",), ("x",)], "v string")
    out, chosen = cleaning.coerce_numbers(df)
    assert chosen == ["v"] and [r["v"] for r in out.collect()] == [1.0, 2.0, -3.0, 4.0, None]


def test_durations_and_categories(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' as start_date, timestamp'2024-01-01 05:00:00' as end_date, 'USB-C charger' as item union all select timestamp'2024-01-01', timestamp'2023-12-31', 'Canon lens'")
    assert cleaning.duration_pair(["start_date", "end_date"]) == ("start_date", "end_date")
    out, name = cleaning.add_duration(df, "start_date", "end_date")
    assert name == "duration_hours" and sorted((r[name] for r in out.collect()), key=str) == [5.0, None]
    out, share = cleaning.add_category(df, "item")
    assert share == 1.0 and {r["item_category"] for r in out.collect()} == {"Charger", "Camera"}


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("b", 5.0), (None, 9.0)], "k string, y double")
    hot = features.one_hot(df, "k")
    assert hot.columns == ["k", "y", "k_b"] and sum(r["k_b"] for r in hot.collect()) == 2
    coded = {r["k"]: r["k_target"] for r in features.target_encode(df, "k", "y").collect()}
    assert coded["a"] == pytest.approx(3.0) and coded[None] == pytest.approx(3.0) and 3 < coded["b"] < 4
    with pytest.raises(ValueError):
        features.one_hot(spark.range(50).select(F.col("id").cast("string").alias("k")), "k")


def test_vif(spark):
    df = spark.range(200).select(*(F.randn(i).alias(f"x{i}") for i in range(9)), F.col("id").cast("double").alias("y")).withColumn("x9", F.col("x0") + 0.05 * F.randn(77))
    columns = [f"x{i}" for i in range(10)]
    assert all(v >= 1 for v in features.vif(df, columns).values())
    kept, gone = features.eliminate_vif(df, columns, "y")
    assert len(gone) == 1 and gone[0] in ("x0", "x9") and len(kept) == 9
    assert features.drop_correlated(df, columns) == [c for c in columns if c != "x9"]


def test_auc_and_wilcoxon(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(0.875)
    pairs = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0), (3.0, 0.0), (1.0, 1.0)], "a double, b double")
    assert metrics.wilcoxon(pairs, "a", "b").first()["w_plus"] == 4.0
    assert metrics.classification(df.withColumn("p", (F.col("s") > 0.3).cast("int")), "y", "p").first()["accuracy"] == 0.75
    assert metrics.overfitting(1.0, 0.8, 0.2) == ["perfect_score", "gap", "unsteady"]


def test_models_learn(spark):
    df = synthetic.classification(spark, 300, 3, noise=0.1)
    rows, _ = models.prepare(df, ["x0", "x1", "x2"], "target", "id")
    train, test = models.split(rows)
    found, failed = models.train(train, "classification", ("logistic", "decision_tree"), folds=3)
    assert not failed and found[0].cv > 0.75
    voted = models.vote(test, [t.model for t in found], "classification", 2)
    assert models.score(voted, "classification") > 0.7
    logistic = next(t for t in found if t.name == "logistic").model
    best = models.permutation_importance(test, logistic, ["x0", "x1", "x2"], "classification").first()
    assert best["name"] == "x0"
    shap = models.linear_shap(test, logistic.coefficients.toArray().tolist(), ["x0", "x1", "x2"])
    assert shap.groupBy("name").agg(F.abs(F.avg("shap")).alias("m")).agg(F.max("m")).first()[0] < 1e-6
    local = models.local_explanation(test, logistic, test.first()["row_id"], ["x0", "x1", "x2"], samples=300)
    assert local.orderBy(F.desc(F.abs("weight"))).first()["name"] == "x0"
    near = models.nearest_neighbours(train, test, "classification")
    assert models.score(near, "classification") > 0.7
    assert models.recommend({"a": 1.0, "b": 3.0, "c": 2.0, "d": 0.0})[0][0] == "b"


def test_saved_models(spark, tmp_path):
    df = synthetic.regression(spark, 200, 2)
    rows, _ = models.prepare(df, ["x0", "x1"], "target", "id")
    fitted = models.estimators("regression")["linear"].fit(rows)
    models.save(fitted, str(tmp_path / "m"))
    assert models.score(models.load(str(tmp_path / "m")).transform(rows), "regression") > 0.9


def test_meta_features(spark):
    vector = meta_features.extract(synthetic.moons(spark, 150), "target", "classification", "id", landmarks=False)
    assert len(vector) == 40 and all(0 <= v <= 1 for v in vector)
    marks = models.landmarks(synthetic.xor(spark, 150), ["x0", "x1"], "target", "classification")
    assert len(marks) == 4


def test_stages_skip_what_needs_a_failed_one(spark, faults):
    def fail(_):
        raise RuntimeError("no")

    context = stages.run(stages.Context(faults), [stages.PROFILE, stages.Stage("clean", fail, ("profile",)), stages.FEATURES, stages.ANALYZE])
    assert "clean" in context.errors and context.skipped == ["features"] and "analyze" in context.results


def test_analysis_path(faults):
    context = stages.run(stages.Context(faults), stages.ANALYSIS)
    assert not context.errors and context.task == "classification"
    assert all(d.count() > 0 for d in context.results["dashboard"].values())
    assert insights.domain(["employee_id", "department"]) == "hr"
    page = files.dashboard_html("t", scoring.kpis(context.df), {"a": context.df.limit(2)})
    assert "<table>" in page


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "`Order ID` int, `Name!` string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    back = files.read(spark, str(tmp_path / "t.csv"))
    assert back.columns == ["order_id", "name"] and back.count() == 2
    files.append_jsonl(back, str(tmp_path / "log"))
    files.append_jsonl(back, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    with pytest.raises(ValueError):
        files.read(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.validate(df.limit(0))
    assert files.normalize(spark.createDataFrame([(1, 2)], "`A b` int, a_b int")).columns == ["a_b", "a_b_2"]


def test_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.0D as value, 7L as user_id union all select timestamp'2024-01-01 00:20:00', 'a', 2.0D, 7L union all select timestamp'2024-01-01 05:00:00', 'a', 4.0D, 7L")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.source(spark, str(tmp_path / "in"), events.schema))
    run = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r["n"], r["total"]) for r in spark.table("hours").collect()) == [(1, 4.0), (2, 3.0)]
    assert windows.sessions(events).count() == 2


def test_nan_counts_as_missing_when_cleaning(spark):
    """A floating column with NaN and no null is imputed, marked, and dropped where it is sparse."""
    nan = float("nan")
    df = spark.createDataFrame([(1.0, nan), (2.0, nan), (nan, nan), (3.0, 5.0)], "a double, b double")
    assert cleaning.drop_sparse_columns(df).columns == ["a"]
    out, _ = cleaning.impute(df)
    rows = out.orderBy("a").collect()
    assert sorted(r["a"] for r in rows) == [1.0, 2.0, 2.0, 3.0] and {r["b"] for r in rows} == {5.0} and sum(r["b_missing"] for r in rows) == 3


def test_column_stats_of_wanted_measures(spark):
    """Measures that are not asked for are null, the others the same; whole numbers that a double rounds stay distinct."""
    df = spark.createDataFrame([(2**60, "a b", 1.5), (2**60 + 1, "c", float("nan")), (None, None, 2.5), (2**60, "a b", 1.5)], "k long, s string, v double")
    whole = {r["name"]: r.asDict() for r in profile.column_stats(df).collect()}
    some = {r["name"]: r.asDict() for r in profile.column_stats(df, wanted=("median", "tokens")).collect()}
    assert whole["k"]["distinct"] == 2 and whole["v"]["distinct"] == 2 and whole["v"]["missing"] == 1 and whole["s"]["tokens"] == pytest.approx(5 / 3)
    for name, row in some.items():
        assert {k for k, v in row.items() if v is not None} <= {"name", "kind", "whole", "position", "rows", "missing", "median", "q1", "q3", "tokens"}
        assert row["median"] == whole[name]["median"] and row["tokens"] == whole[name]["tokens"]


def plain_nearest(rows, k):
    """Imputation over all pairs; rows are (id, values...)."""
    columns, out = list(zip(*[r[1:] for r in rows])), []
    for r in rows:
        new = list(r)
        for c in [c for c in range(len(columns)) if r[1 + c] is None]:
            near = []
            for d in (d for d in rows if d[1 + c] is not None):
                both = [i for i in range(len(columns)) if r[1 + i] is not None and d[1 + i] is not None]
                if both:
                    near.append((math.sqrt(len(columns) / len(both)) * math.sqrt(sum((r[1 + i] - d[1 + i]) ** 2 for i in both)), d[0], d[1 + c]))
            near = [x[2] for x in sorted(near)[:k]]
            known = [x for x in columns[c] if x is not None]
            new[1 + c] = sum(near) / len(near) if near else sum(known) / len(known) if known else None
        out.append(tuple(new))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_rows_equal_all_pairs(spark, monkeypatch, block):
    """Gaps in any column, ties, rows without a value, and large groups of copies, in one block and in many."""
    rng = random.Random(1)
    rows = [(i, *(None if rng.random() < 0.15 else float(rng.choice([rng.gauss(0, 5), rng.randint(0, 3)])) for _ in range(3))) for i in range(150)]
    rows += [(1000 + i, 1.0, 2.0, None) for i in range(40)] + [(2000 + i, 1.0, 2.0, 3.0 + i) for i in range(40)] + [(3000, None, None, None)]
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, a double, b double, c double, pattern string")
    got = sorted(tuple(r)[:4] for r in neighbours.impute_nearest(df, ["a", "b", "c"], "id").collect())
    assert [x for r in got for x in r] == pytest.approx([x for r in plain_nearest(rows, 5) for x in r])


def test_nearest_rows_without_donors(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, float("nan"), None)], "id long, a double, b double")
    assert sorted(tuple(r) for r in neighbours.impute_nearest(df, ["a", "b"], "id").collect()) == [(1, 1.0, None), (2, 1.0, None), (3, 1.0, None)]
    assert neighbours.impute_nearest(df.limit(0), ["a", "b"]).collect() == []


def test_impute_takes_near_rows_in_its_tier(spark):
    df = spark.createDataFrame([(float(i), None if i % 10 == 0 else 10.0 * i) for i in range(100)], "a double, b double")
    out, how = cleaning.impute(df)
    assert how == {"b": "knn"}
    assert {r["a"]: r["b"] for r in out.collect()}[50.0] == pytest.approx(500, abs=20)


def test_positions_and_running_sums(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id long, v long, part string").repartition(7)
    want = sorted((v, i) for i, v in enumerate(values))
    got = sorted((r["position"], r["v"], r["id"]) for r in ordered.with_position(df, "v", "id").collect())
    assert got == [(n, v, i) for n, (v, i) in enumerate(want, 1)]
    sums = {r["id"]: r["total"] for r in ordered.running_sums(df, ["v", "id"], total=F.col("v")).collect()}
    before = {r["id"]: r["previous"] for r in ordered.with_previous(df, ["v", "id"], "v").collect()}
    run = 0
    for n, (v, i) in enumerate(want):
        run += v
        assert sums[i] == run and before[i] == (want[n - 1][0] if n else None)
    assert ordered.with_position(df.limit(0), "v").collect() == []


def subset_values(x, value, m):
    """Shapley values by all subsets; ``value`` gives a set's worth for row ``x``."""
    out = []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        out.append(sum(math.factorial(n) * math.factorial(m - 1 - n) / math.factorial(m) * (value(x, {*s, i}) - value(x, set(s))) for n in range(m) for s in itertools.combinations(rest, n)))
    return out


@pytest.fixture(scope="module")
def shaped(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(0, 4), rng.uniform(0, 4), float(rng.randint(0, 2)), rng.gauss(0, 1)]) for i in range(200)]
    df = spark.createDataFrame([(i, *v, (3.0 if v[0] > 2 and v[1] > 1 else 0.0) + v[2] * (v[0] > 1), float(v[0] + v[3] > 2)) for i, v in rows], "id long, a double, b double, c double, d double, y double, z double")
    return df, ["a", "b", "c", "d"]


@pytest.mark.parametrize("name", ["tree", "forest", "boosted", "classes", "categories"])
def test_tree_shap(spark, shaped, name):
    """Values equal the subset sums over the trees themselves, and with the base value add up to the prediction."""
    df, columns = shaped
    target, positive = ("z", 1) if name == "classes" else ("y", None)
    rows, _ = models.prepare(df, columns, target, "id")
    if name == "categories":
        rows = models.VectorAssembler(inputCols=columns, outputCol="raw").transform(df.select("id", *columns, F.col("y").alias("label")))
        rows = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=3).fit(rows).transform(rows).select(F.col("id").alias("row_id"), "label", "features")
    estimator = {
        "tree": models.DecisionTreeRegressor(maxDepth=4), "categories": models.DecisionTreeRegressor(maxDepth=4), "forest": models.RandomForestRegressor(numTrees=5, maxDepth=4, seed=1),
        "boosted": models.GBTRegressor(maxIter=4, maxDepth=3, seed=1), "classes": models.RandomForestClassifier(numTrees=5, maxDepth=4, seed=1),
    }[name]
    model = estimator.fit(rows)
    shap, base = explain.tree_shap(rows, model, columns, positive)
    made = model.transform(rows)
    want = made.select("row_id", "features", (vector_to_array("probability")[1] if positive else F.col("prediction")).alias("p")).collect()
    got = {(r["row_id"], r["name"]): r["shap"] for r in shap.collect()}
    assert all(base + sum(got[r["row_id"], c] for c in columns) == pytest.approx(r["p"], abs=1e-9) for r in want)
    found = explain.leaves(spark, model, positive)

    def value(x, known):
        total = 0.0
        for leaf in found:
            part = leaf.value
            for n, c in enumerate(leaf.columns.tolist()):
                fits = x[c] in leaf.among[n].tolist() if n in leaf.among else leaf.low[n] < x[c] <= leaf.high[n]
                part *= float(fits) if c in known else leaf.shares[n]
            total += part
        return total

    for r in want[:10]:
        assert [got[r["row_id"], c] for c in columns] == pytest.approx(subset_values(r["features"].toArray(), value, 4), abs=1e-9)


def test_kernel_shap_equals_subsets(shaped):
    df, columns = shaped
    rows, _ = models.prepare(df, columns, "z", "id")
    model = models.estimators("classification")["decision_tree"].fit(rows)
    against = explain.background(rows, 4)
    some = rows.where("row_id < 6")
    got = {(r["row_id"], r["name"]): r["shap"] for r in explain.kernel_shap(some, model, columns, against).collect()}
    xs = {r["row_id"]: r["features"].toArray() for r in some.collect()}
    sets = [set(s) for n in range(5) for s in itertools.combinations(range(4), n)]
    mixed = [(i * 100 + n, k, w, Vectors.dense([x[c] if c in s else b[c] for c in range(4)])) for i, x in xs.items() for n, s in enumerate(sets) for k, (w, b) in enumerate(against)]
    worth: dict = {}
    for r in model.transform(df.sparkSession.createDataFrame(mixed, ["key", "k", "w", "features"])).collect():
        worth[r["key"]] = worth.get(r["key"], 0.0) + r["w"] * float(r["probability"][1])
    for i, x in xs.items():
        want = subset_values(x, lambda x, s, i=i: worth[i * 100 + sets.index(s)], 4)
        assert [got[i, c] for c in columns] == pytest.approx(want, abs=1e-9)


def test_kernel_shap_draws_sets_of_many_columns(spark):
    """Beyond eight columns sets are drawn; a linear model's values are still exact."""
    columns = [f"x{i}" for i in range(11)]
    rng = random.Random(8)
    df = spark.createDataFrame([(i, *(rng.gauss(0, 1) for _ in columns)) for i in range(60)], "id long, " + ", ".join(f"{c} double" for c in columns))
    rows, _ = models.prepare(df.withColumn("y", sum(((i + 1.0) * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))), columns, "y", "id")
    against = explain.background(rows, 1)
    x = rows.where("row_id = 3").first()["features"].toArray()
    got = {r["name"]: r["shap"] for r in explain.kernel_shap(rows.where("row_id = 3"), models.LinearRegression().fit(rows), columns, against, drawn=400).collect()}
    assert [got[c] for c in columns] == pytest.approx([(i + 1) * (x[i] - against[0][1][i]) for i in range(11)], abs=1e-6)


def plain_information(rows, k=3):
    """(value, class) pairs by all pairs."""
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    size = Counter(c for _, c in rows)
    rows = [(i, x, c) for i, (x, c) in enumerate(rows) if size[c] > 1]
    total = 0.0
    for i, x, c in rows:
        own = min(k, size[c] - 1)
        far = sorted(abs(x - y) for j, y, d in rows if d == c and j != i)[own - 1]
        nearer = sum(abs(x - y) < far or x == y for _, y, _ in rows)
        total += psi(own) - psi(size[c]) - psi(nearer)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("stretch", [50_000, 7])
def test_neighbour_information(spark, monkeypatch, stretch):
    """Ties, a class of one, a class of two, gaps, and classes that run over many stretches."""
    rng = random.Random(9)
    rows = [(rng.gauss(2.0 * (i % 3 == 0), 1), float(rng.randint(0, 4)), "a" if i % 3 == 0 else "b") for i in range(90)] + [(0.5, 1.0, "c"), (0.1, 2.0, "d"), (9.0, 2.0, "d"), (None, 3.0, "a"), (float("nan"), 3.0, None)]
    monkeypatch.setattr(features, "STRETCH", stretch)
    df = spark.createDataFrame(rows, "x double, p double, t string").repartition(5)
    got = {r["name"]: r["mi"] for r in features.neighbour_information(df, ["x", "p"], "t").collect()}
    assert got["x"] == pytest.approx(plain_information([(x, t) for x, _, t in rows if t and x is not None]), abs=1e-9)
    assert got["p"] == pytest.approx(plain_information([(p, t) for _, p, t in rows if t]), abs=1e-9)
    assert features.select_top(df, ["x", "p"], "t", 1) == ["x"]


def test_stratified_split(spark):
    """Exact quotas, also of small classes and of rows that share an id; no row is lost or in both sets."""
    rows = [(i, ("a", "b", "c")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2], i) for i in range(500)] + [(7000, "d", 10_000 + i) for i in range(30)] + [(9000, "e", 20_000), (9001, None, 20_001)]
    df = spark.createDataFrame(rows, "row_id long, label string, v long")
    train, test = models.stratified_split(df, share=(1, 4))
    got = {r["label"]: r["n"] for r in test.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = Counter(c for _, c, _ in rows if c)
    assert got == {c: q for c, q in models.quotas(counts, (1, 4)).items() if q} and sum(got.values()) == -(-531 // 4)
    assert sorted(r["v"] for r in train.union(test).collect()) == sorted(v for _, _, v in rows) and test.columns == df.columns
    assert sorted(r["row_id"] for r in test.where("label <> 'd'").collect()) == sorted(r["row_id"] for r in models.stratified_split(df.repartition(5), share=(1, 4))[1].where("label <> 'd'").collect())
    assert models.stratified_split(df.limit(0))[1].count() == 0


def test_encoder_is_kept(spark, tmp_path):
    """A saved encoder gives the training encoding again; unknown, null and missing values are defined."""
    df = spark.createDataFrame([(1, "b", "x", "p", 1.0), (2, "a", "y", "p", 2.0), (3, "c", "z", "q", 6.0), (4, "a", "x", "q", 7.0), (5, None, None, None, 4.0)], "id int, l string, o string, t string, v double")
    made = encoders.RowEncoder(methods='{"l": "label", "o": "onehot", "t": "target"}', columns=["v"], scaled=["v", "l"], target="v", method="standard").fit(df)
    made.save(str(tmp_path / "e"))
    again = encoders.RowEncoderModel.load(str(tmp_path / "e"))
    assert again.feature_names == ["v", "l", "o_y", "o_z", "t_target"]
    assert sorted(map(tuple, again.transform(df).collect())) == sorted(map(tuple, made.transform(df).collect()))
    rows = {r["id"]: r for r in again.transform(df).collect()}
    want = {r["id"]: r for r in features.target_encode(df, "t", "v").collect()}
    assert all(rows[i]["t_target"] == pytest.approx(want[i]["t_target"]) for i in range(1, 6))
    assert [(rows[i]["o_y"], rows[i]["o_z"]) for i in range(1, 6)] == [(0, 0), (1, 0), (0, 1), (0, 0), (0, 0)]
    new = again.transform(spark.createDataFrame([("zzz", "zzz", "zzz")], "l string, o string, t string")).first()
    assert (new["l"], new["o_y"], new["t_target"]) == (rows[2]["l"], 0.0, pytest.approx(4.0)) and new["v"] == pytest.approx(-4 / 2.2803508501982757)


def test_names_are_resolved(spark):
    columns = ["Order Date", "sales_amount", "region", "profit"]
    written = ["Order Date", "order date", "ORDER-DATE", "sales amount", "sale_amount", "regoin", "profits", "zzz", "", None]
    want = ["Order Date", "Order Date", "Order Date", "sales_amount", "sales_amount", "region", "profit", None, None, None]
    assert [names.best_name(w, columns) for w in written] == want
    df = spark.createDataFrame([(i, w) for i, w in enumerate(written)], "id int, name string")
    assert [r["r"] for r in df.select("id", names.resolved(F.col("name"), columns).alias("r")).orderBy("id").collect()] == want
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "region string, profit double")
    assert charts.build(table, charts.ChartSpec("bar", "regoin", "Profits")).count() == 2
    with pytest.raises(ValueError, match="no column"):
        charts.build(table, charts.ChartSpec("bar", "nothing", "profit"))


def test_extra_trees(spark, tmp_path):
    """One drawn split by hand, a forest near the other forest's held-out score, seeded, and the same after a reload."""
    df = spark.createDataFrame([(i, float(i), 1.0 if i >= 50 else 0.0) for i in range(100)], "id long, x double, y double")
    rows, _ = models.prepare(df, ["x"], "y", "id")
    stump = learners.ExtraTrees(numTrees=1, maxDepth=1, seed=3).fit(rows)
    at = json.loads(stump.getOrDefault(stump.state))["trees"][0]["at"][0]
    left, right = [float(i >= 50) for i in range(100) if i <= at], [float(i >= 50) for i in range(100) if i > at]
    got = {r["row_id"]: r["prediction"] for r in stump.transform(rows).collect()}
    assert 0 < at < 99 and got[0] == pytest.approx(sum(left) / len(left)) and got[99] == pytest.approx(sum(right) / len(right))
    df = synthetic.xor(spark, 600, seed=4)
    rows, _ = models.prepare(df, ["x0", "x1"], "target", "id")
    train, test = models.stratified_split(rows)
    model = learners.ExtraTrees(numTrees=30, maxDepth=10, classes=2).fit(train)  # drawn splits need more levels
    forest = models.RandomForestClassifier(numTrees=15, maxDepth=6, seed=1).fit(train)
    own = models.score(model.transform(test), "classification")
    assert own > models.score(forest.transform(test), "classification") - 0.08 and own > 0.85
    assert learners.ExtraTrees(numTrees=30, maxDepth=10, classes=2).fit(train).getOrDefault("state") == model.getOrDefault("state")
    model.save(str(tmp_path / "m"))
    assert models.score(learners.ExtraTreesModel.load(str(tmp_path / "m")).transform(test), "classification") == own


@pytest.mark.parametrize("shape", ["circles", "xor"])
def test_kernel_machine_bends(spark, shape):
    """It separates what a linear machine cannot."""
    df = getattr(synthetic, shape)(spark, 400, seed=2)
    rows, _ = models.prepare(df, ["x0", "x1"], "target", "id")
    rows = rows.cache()
    train, test = models.stratified_split(rows)
    bent = models.score(learners.kernel_machine("classification", waves=100, gamma=1.0).fit(train).transform(test), "classification")
    straight = models.score(models.LinearSVC(maxIter=20).fit(train).transform(test), "classification")
    assert bent > 0.9 and straight < 0.75


def test_results_are_found_by_content(spark, tmp_path):
    rows = [(1, "a", 1.5), (2, None, 2.5), (2, None, 2.5), (3, "n", None)]
    df = spark.createDataFrame(rows, "i int, s string, v double")
    run = lambda d: d.groupBy("i").agg(F.sum("v").alias("v"))
    get = lambda d, request: cache.cached(d, request, str(tmp_path), run)
    made, hit = get(df, {"chart": "bar", "x": "i"})
    assert not hit and made.count() == 3
    turned = spark.createDataFrame(rows[::-1], "i int, s string, v double").repartition(3).select("v", "s", "i")
    again, hit = get(turned, {"x": "i", "chart": "bar"})
    assert hit and sorted(map(tuple, again.collect())) == sorted(map(tuple, made.collect()))
    assert not get(df, {"chart": "pie", "x": "i"})[1]
    for other in ([*rows[:3], (3, None, None)], [*rows[:3], (3, "n", 0.0)], rows[:3], [*rows, rows[0]], [rows[0], rows[1], rows[3], rows[3]]):
        assert cache.key(spark.createDataFrame(other, "i int, s string, v double"), {}) != cache.key(df, {})
    assert tuple(cache.fingerprint(df.limit(0)).first()) == (0, 0, 0)


def _labelled(spark, n=300):
    rows = spark.range(n).select(F.col("id").alias("row_id"), ((F.col("id") % 7) > 3).cast("double").alias("label"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double")).alias("x"))
    return rows.select("row_id", "label", array_to_vector("x").alias("features"))


def test_search_within_time_stops_its_jobs(spark, monkeypatch):
    def slowly(rows, k, plain=models.with_folds):
        def wait(batches):
            for batch in batches:
                time.sleep(60)
                yield batch

        return plain(rows, k).mapInArrow(wait, plain(rows, k).schema)

    rows = _labelled(spark)
    with monkeypatch.context() as patch:
        patch.setattr(models, "with_folds", slowly)
        began = time.monotonic()
        found = tuning.search_within(rows, "decision_tree", "classification", seconds=2)
        took = time.monotonic() - began
    assert found.stopped and found.score is None and found.setting == {} and not found.tried and not found.failed
    assert took < 40 and not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert models.score(found.model.transform(rows), "classification") > 0.9


def test_search_within_time_equals_plain_folds(spark):
    rows = _labelled(spark)
    found = tuning.search_within(rows, "decision_tree", "classification", seconds=600, most=3)
    assert not found.stopped and [s for s, _ in found.tried] == tuning.settings("decision_tree", 3)
    for setting, value in found.tried:
        made = models.estimators("classification")["decision_tree"]
        made = made.copy({made.getParam(k): v for k, v in setting.items()})
        plain = models.cross_validate(rows, made, "classification", 3)
        assert value == pytest.approx(sum(plain) / len(plain))
    assert found.score == max(v for _, v in found.tried)
    bad = tuning.search_within(rows.withColumn("label", F.col("label") - 5), "linear", "regression", seconds=600, most=2)
    assert bad.score is not None and bad.setting == {} and len(bad.tried) == 1  # a model without a grid is tried as it is


@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 100_000), (100, 50), (100, 10**9), (500, 20)])
def test_quantiles_by_selection(spark, accuracy, most):
    rng = random.Random(accuracy + most % 7)
    values = {"a": [rng.gauss(0, 1) for _ in range(9000)], "b": [7.0] * 4000 + [rng.expovariate(1) * 10 for _ in range(5000)], "c": [1.0, 2.0], "d": [5.0], "e": [float(i % 3) for i in range(3000)], "f": [-math.inf, 1.0, math.inf]}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("a", None), ("a", math.nan), (None, 3.0), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    at = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.quantiles(df, ["g"], "x", at, accuracy, most).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        xs = sorted(xs)
        assert got[g][0] == len(xs)
        for p, q in zip(at, got[g][1], strict=True):
            place = p * (len(xs) - 1)
            lo, hi = xs[math.floor(place)], xs[math.ceil(place)]
            assert q == (lo if lo == hi else pytest.approx((math.ceil(place) - place) * lo + (place - math.floor(place)) * hi)), (g, p)
    assert quantiles.quantiles(df.limit(0), ["g"], "x", at).count() == 0


def test_quantiles_show_a_bracket_that_misses(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    state = spark.createDataFrame([("g", [10.0, 20.0])], "g string, __ends array<double>")
    row = quantiles._selected(df, ["g"], "x", state, (0.5,)).first()
    assert row["n"] == 100 and row["q"] == [None]
    assert quantiles._selected(df, ["g"], "x", state, (15 / 99,)).first()["q"] == [15.0]
    assert quantiles.of_columns(df, {"x": F.col("x"), "none": F.lit(None), "half": F.col("x") / 2}, (0.25, 0.5)) == {"x": [24.75, 49.5], "half": [12.375, 24.75]}
    assert quantiles.of_columns(df, {}, (0.5,)) == {}


def test_error_statistics_gather_no_column_in_a_task(spark):
    """Medians of errors, ranks and distributions are those of numpy, and no plan counts a column value by value."""
    rng = np.random.default_rng(5)
    y, p = rng.normal(size=501).round(3), rng.normal(size=501).round(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "y double, p double")
    scores = spark.createDataFrame([(d, m, float((d * (m + 3)) % 7)) for d in range(9) for m in range(4)], "dataset int, model int, score double")
    chosen = spark.createDataFrame([(d, d % 4) for d in range(9)], "dataset int, model int")
    errors = metrics.regression(df, "y", "p")
    picked, spread = metrics.selection_summary(scores, chosen), insights.distribution(df.dropna(), "y")
    for out in (errors, picked, spread):
        assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert errors.first()["median_error"] == pytest.approx(np.median(np.abs(y - p)))
    hit = [r for r in metrics.ranks(scores).join(chosen, ["dataset", "model"]).collect()]
    row = picked.first()
    assert (row["median_regret"], row["median_rank"]) == (np.median([r["regret"] for r in hit]), np.median([r["rank"] for r in hit]))
    assert spread.first()["median"] == pytest.approx(np.median(y))
    assert metrics.regression(df.limit(0), "y", "p").first()["median_error"] is None


def test_errors_by_quartile_gather_no_column_in_a_task(spark):
    rng = np.random.default_rng(6)
    y, p = rng.normal(size=501).round(3), rng.normal(size=501).round(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "y double, p double")
    parts = metrics.errors_by_quartile(df, "y", "p")
    assert "percentile(" not in parts._jdf.queryExecution().optimizedPlan().toString()
    e, (low, high) = np.abs(y - p), np.quantile(y, (0.25, 0.75))
    got = {r["part"]: (r["n"], r["mae"]) for r in parts.collect()}
    assert got == {k: (m.sum(), pytest.approx(e[m].mean())) for k, m in (("low", y <= low), ("high", y >= high), ("middle", (y > low) & (y < high)))}
    assert metrics.errors_by_quartile(df.limit(0), "y", "p").count() == 0
