"""Training, choosing, combining and explaining models with Spark's own estimators.

Extremely randomised trees and kernel machines are in ``learners``; outside boosting libraries have gradient boosting as a stand-in.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .learners import ExtraTrees, kernel_machine
from .ordered import with_position

#: What is tried where no policy has an opinion.
DEFAULT = {"classification": ("random_forest", "gradient_boosting", "logistic"), "regression": ("random_forest", "gradient_boosting", "ridge")}


def estimators(task: str, classes: int = 2, seed: int = 42) -> dict[str, object]:
    """Estimators by name."""
    if task == "classification":
        boosted = GBTClassifier(maxIter=20, maxDepth=3, seed=seed)
        svc = LinearSVC(maxIter=50)
        return {
            "logistic": LogisticRegression(maxIter=100), "naive_bayes": NaiveBayes(modelType="gaussian"), "decision_tree": DecisionTreeClassifier(maxDepth=5, seed=seed),
            "random_forest": RandomForestClassifier(numTrees=50, maxDepth=8, seed=seed), "extra_trees": ExtraTrees(numTrees=50, maxDepth=8, classes=max(2, classes), seed=seed),
            "gradient_boosting": boosted if classes <= 2 else OneVsRest(classifier=boosted), "svc": svc if classes <= 2 else OneVsRest(classifier=svc), "kernel_svc": kernel_machine(task, classes, seed=seed),
        }
    return {
        "linear": LinearRegression(), "ridge": LinearRegression(regParam=1.0, elasticNetParam=0.0), "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0), "elastic_net": LinearRegression(regParam=0.1, elasticNetParam=0.5),
        "decision_tree": DecisionTreeRegressor(maxDepth=5, seed=seed), "random_forest": RandomForestRegressor(numTrees=50, maxDepth=8, seed=seed), "gradient_boosting": GBTRegressor(maxIter=20, maxDepth=3, seed=seed),
        "extra_trees": ExtraTrees(numTrees=50, maxDepth=8, seed=seed), "kernel_ridge": kernel_machine(task, seed=seed),
    }


def prepare(df: DataFrame, columns: list[str], target: str, row_id: str | None = None) -> tuple[DataFrame, list[str]]:
    """``row_id, label, fold key, features``; null and infinite features as 0, string targets as places in order."""
    from .features import distinct_values

    classes: list[str] = []
    label = F.col(target).cast("double")
    if dict(df.dtypes)[target] in ("string", "boolean"):
        classes = distinct_values(df, target, 1000)
        label = (F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(target).cast("string")) - 1).cast("double")
    key = F.col(row_id) if row_id else F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))])
    rows = df.where(F.col(target).isNotNull()).select(key.alias("row_id"), label.alias("label"), *(F.coalesce(E.finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in columns))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("row_id", "label", "features"), classes


def with_folds(rows: DataFrame, k: int) -> DataFrame:
    """Adds ``fold`` by the hash of the row id: the same folds in every run."""
    return rows.withColumn("fold", F.pmod(F.xxhash64("row_id", F.lit(42)), F.lit(k)).cast("int"))


#: Bits of a hash that one pass of ``stratified_split`` decides, and classes at most.
PASS_BITS, MOST_CLASSES = 12, 1000


def quotas(counts: dict, share: tuple[int, int]) -> dict:
    """How many rows of each class go to the test set: its share rounded down, and one more for the largest remainders until the whole is the share rounded up."""
    taken = {c: n * share[0] // share[1] for c, n in counts.items()}
    left = -(-sum(counts.values()) * share[0] // share[1]) - sum(taken.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * share[0] % share[1]), c))[:left]:
        taken[c] += 1
    return taken


def stratified_split(rows: DataFrame, label: str = "label", row_id: str = "row_id", share: tuple[int, int] = (1, 5), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; each class gives its exact quota (see ``quotas``) to the test set, those with the smallest hashes.

    The hash that ends a class's quota is found by counting: each pass counts the hashes under the prefix found so far by
    their next bits, so rows are neither sorted nor moved and no class is one task's. Rows that share the last hash (repeated ids)
    are numbered by a sort of them alone. Rows without a label stay in training; the same rows and seed give the same split.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("__h", F.shiftrightunsigned(F.xxhash64(row_id, F.lit(seed)), 3)).withColumn("__c", F.col(label).cast("string"))  # 61 bits
    counts = {r["__c"]: r["n"] for r in rows.where("__c is not null").groupBy("__c").agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()}
    if len(counts) > MOST_CLASSES:
        raise ValueError(f"{label!r} has more than {MOST_CLASSES} classes")
    open_, found, bits = {c: (0, q) for c, q in quotas(counts, share).items()}, {}, 61  # class: prefix, rows still to take under it
    for c in [c for c, (_, q) in open_.items() if not q]:
        found[c] = (0, 0)
        del open_[c]
    while open_ and bits:
        width = min(PASS_BITS, bits)
        state = F.broadcast(spark.createDataFrame([(c, p, q) for c, (p, q) in open_.items()], "__c string, p long, q long"))
        inside = rows.select("__c", "__h").join(state, "__c").where(F.shiftright("__h", bits) == F.col("p"))
        slots = inside.groupBy("__c", "p", "q", F.shiftright("__h", bits - width).alias("slot")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("__c").orderBy("slot"))  # 4096 rows a class at most
        bits -= width
        for r in slots.withColumn("upto", upto).where((F.col("upto") >= F.col("q")) & (F.col("upto") - F.col("n") < F.col("q"))).collect():  # a row a class
            if r["upto"] == r["q"]:
                found[r["__c"]] = ((r["slot"] + 1) << bits, 0)
                del open_[r["__c"]]
            else:
                open_[r["__c"]] = (r["slot"], r["q"] - (r["upto"] - r["n"]))
    found |= open_  # the whole hash, and how many of the rows that share it
    ends = F.broadcast(spark.createDataFrame([(c, h, n) for c, (h, n) in found.items()], "__c string, e long, more long"))
    marked = rows.join(ends, "__c", "left")
    clear, names = marked.where("__h <> e or more = 0 or e is null"), [c for c in rows.columns if not c.startswith("__")]
    out = clear.select(*names, F.coalesce(F.col("__h") < F.col("e"), F.lit(False)).alias("__t"))
    if any(n for _, n in found.values()):
        ties = with_position(marked.where("__h = e and more > 0"), "__c", name="__p")
        first = F.broadcast(ties.groupBy("__c").agg(F.min("__p").alias("__f")))
        out = out.union(ties.join(first, "__c").select(*names, (F.col("__p") - F.col("__f") < F.col("more")).alias("__t")))
    return out.where("not __t").drop("__t"), out.where("__t").drop("__t")


def split(rows: DataFrame, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, by the hash of the row id; every class keeps its share but for chance."""
    place = F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(10_000))
    return rows.where(place >= int(10_000 * share)), rows.where(place < int(10_000 * share))


def score(predicted: DataFrame, task: str) -> float:
    if task == "classification":
        return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(predicted)
    return RegressionEvaluator(metricName="r2").evaluate(predicted)


def cross_validate(rows: DataFrame, estimator, task: str, k: int = 5) -> list[float]:
    """The score on each fold by a model of the others."""
    folded = with_folds(rows, k).cache()
    out = []
    for i in range(k):
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        if not test.isEmpty() and not train.isEmpty():
            out.append(score(estimator.fit(train).transform(test), task))
    folded.unpersist()
    return out


@dataclasses.dataclass
class Trained:
    name: str
    model: object
    cv: float
    spread: float
    train: float


def train(rows: DataFrame, task: str, names: tuple[str, ...] | None = None, classes: int = 2, folds: int = 5) -> tuple[list[Trained], dict[str, str]]:
    """Models fitted on all rows with their cross-validated score, best first, and the errors of those that failed."""
    known, done, failed = estimators(task, classes), [], {}
    for name in names or DEFAULT[task]:
        try:
            cv = cross_validate(rows, known[name], task, folds)
            model = known[name].fit(rows)
            done.append(Trained(name, model, float(np.mean(cv)), float(np.ptp(cv)), score(model.transform(rows), task)))
        except Exception as e:  # one model's failure leaves the others
            failed[name] = str(e).splitlines()[0][:200]
    return sorted(done, key=lambda t: (-t.cv, t.name)), failed


#: What a search tries, by model: parameter name and values.
SPACES = {
    "logistic": {"regParam": (0.0, 0.01, 0.1, 1.0), "elasticNetParam": (0.0, 0.5, 1.0)}, "decision_tree": {"maxDepth": (3, 5, 8, 12), "minInstancesPerNode": (1, 5, 20)},
    "random_forest": {"numTrees": (20, 50, 100), "maxDepth": (5, 8, 12), "minInstancesPerNode": (1, 5)}, "gradient_boosting": {"maxIter": (10, 20, 40), "maxDepth": (3, 5), "stepSize": (0.05, 0.1, 0.2)},
    "ridge": {"regParam": (0.01, 0.1, 1.0, 10.0)}, "lasso": {"regParam": (0.001, 0.01, 0.1, 1.0)}, "elastic_net": {"regParam": (0.01, 0.1, 1.0), "elasticNetParam": (0.2, 0.5, 0.8)},
}


def trials(rows: int) -> int:
    """How many settings a search tries: fewer for larger tables."""
    return 25 if rows < 1000 else 15 if rows < 10_000 else 10


def search(rows: DataFrame, name: str, task: str, classes: int = 2, folds: int = 3, most: int | None = None, seed: int = 42, parallelism: int = 2):
    """The best setting of a model over a seeded random part of its grid, fitted on all rows, and its score."""
    import random

    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    estimator = estimators(task, classes)[name]
    grid = ParamGridBuilder()
    for param, values in SPACES.get(name, {}).items():
        grid = grid.addGrid(estimator.getParam(param), list(values))
    settings = grid.build()
    chosen = random.Random(seed).sample(settings, min(len(settings), most or trials(rows.count())))
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if task == "classification" else RegressionEvaluator(metricName="r2")
    folded = with_folds(rows, folds)
    fitted = CrossValidator(estimator=estimator, estimatorParamMaps=chosen, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(folded)
    return fitted.bestModel, float(max(fitted.avgMetrics))


def diverse(predicted: DataFrame, by: str = "prediction", order: str = "row_id", n: int = 5) -> DataFrame:
    """One row for each distinct prediction, the first by id, and ``n`` of them at most."""
    first = predicted.groupBy(by).agg(F.min(order).alias(order))
    return predicted.join(first, [by, order], "left_semi").dropDuplicates([by, order]).orderBy(order).limit(n)


def vote(rows: DataFrame, models: list, task: str, classes: int) -> DataFrame:
    """``row_id, label, prediction`` of all models together: mean probability where two have one, else the majority; means for regression."""
    out = rows
    soft, hard = [], []
    for i, m in enumerate(models):
        keep = out.columns
        made = m.transform(out)
        hard.append(f"p{i}")
        parts = {f"p{i}": F.col("prediction")}
        if "probability" in made.columns:
            parts[f"q{i}"] = vector_to_array("probability")
            soft.append(f"q{i}")
        out = made.select(*keep, *(v.alias(n) for n, v in parts.items()))
    if task == "regression":
        final = sum((F.col(h) for h in hard), F.lit(0.0)) / len(hard)
    elif len(soft) >= 2:
        means = F.array(*(sum((F.coalesce(F.get(F.col(s), F.lit(c)), F.lit(0.0)) for s in soft), F.lit(0.0)) for c in range(classes)))
        final = (F.array_position(means, F.array_max(means)) - 1).cast("double")
    else:
        votes = F.array(*(sum(((F.col(h) == c).cast("int") for h in hard), F.lit(0)) for c in range(classes)))
        final = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
    return out.select("row_id", "label", final.alias("prediction"))


def recommend(scores: dict[str, float], k: int = 3) -> list[tuple[str, float]]:
    """The ``k`` models that a policy's raw scores favour, with softmax probabilities."""
    names = sorted(scores)
    e = np.exp(np.array([scores[n] for n in names]) - max(scores.values()))
    p = e / e.sum()
    return sorted(((n, float(v)) for n, v in zip(names, p, strict=True)), key=lambda x: (-x[1], x[0]))[:k]


def permutation_importance(rows: DataFrame, model, columns: list[str], task: str, seed: int = 42) -> DataFrame:
    """``name, importance``: what the score loses when a column's values are dealt to other rows.

    Values are dealt by joining two orders of the row hash within buckets, so the shuffle is distributed.
    """
    base, spark, out = score(model.transform(rows), task), rows.sparkSession, []
    flat = rows.withColumn("v", vector_to_array("features"))
    for i, c in enumerate(columns):
        other = flat.select((F.col("v")[i]).alias("moved"), F.xxhash64("row_id", F.lit(seed + i)).alias("h"))
        n = 64
        own = flat.withColumn("b", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(n))).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("row_id", F.lit(1)))))
        dealt = other.withColumn("b", F.pmod("h", F.lit(n))).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h"))).select("b", "r", "moved")
        mixed = own.join(dealt, ["b", "r"], "left").withColumn("moved", F.coalesce("moved", F.col("v")[i]))
        changed = F.array(*(F.col("moved") if k == i else F.col("v")[k] for k in range(len(columns))))
        out.append((c, float(base - score(model.transform(mixed.select("row_id", "label", array_to_vector(changed).alias("features"))), task))))
    return spark.createDataFrame(out, "name string, importance double").orderBy(F.desc("importance"), "name")


def linear_shap(rows: DataFrame, coefficients: list[float], columns: list[str]) -> DataFrame:
    """``row_id, name, shap``: exact additive attributions of a linear model, coefficient times distance from the mean."""
    flat = rows.select("row_id", vector_to_array("features").alias("v"))
    means = F.broadcast(flat.agg(*(F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(columns)))))  # one row
    cells = F.array(*(F.struct(F.lit(c).alias("name"), (F.lit(float(coefficients[i])) * (F.col("v")[i] - F.col(f"m{i}"))).alias("shap")) for i, c in enumerate(columns)))
    return flat.crossJoin(means).select("row_id", F.inline(cells))


def local_explanation(rows: DataFrame, model, row_id, columns: list[str], samples: int = 1000, top: int = 10, seed: int = 42) -> DataFrame:
    """``name, weight`` of a weighted linear model around one row: how the prediction moves with each column nearby."""
    spark = rows.sparkSession
    point = list(rows.where(F.col("row_id") == row_id).select(vector_to_array("features").alias("v")).first()["v"])
    flat = rows.select(vector_to_array("features").alias("v"))
    sd = flat.agg(*(F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in range(len(columns)))).first()
    noise = F.array(*(F.randn(seed + i) for i in range(len(columns))))
    near = spark.range(samples).withColumn("z", noise)
    moved = F.array(*(F.lit(float(point[i])) + F.col("z")[i] * F.lit(float(sd[f"s{i}"] or 0.0)) for i in range(len(columns))))
    made = model.transform(near.withColumn("features", array_to_vector(moved)))
    value = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
    distance = F.aggregate(F.transform("z", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    local = made.select(value.alias("label"), array_to_vector("z").alias("features"), F.exp(-distance / (0.75 * 0.75 * len(columns))).alias("w"))
    fit = LinearRegression(weightCol="w", regParam=1e-3).fit(local)
    found = sorted(zip(columns, fit.coefficients.toArray().tolist(), strict=True), key=lambda x: -abs(x[1]))[:top]
    return spark.createDataFrame(found, "name string, weight double")


def nearest_neighbours(train_rows: DataFrame, test_rows: DataFrame, task: str, k: int = 3, bound: int = 2000) -> DataFrame:
    """``row_id, label, prediction`` by the ``k`` nearest of a bounded set of training rows (those with the smallest hashes)."""
    bank = train_rows.orderBy(F.xxhash64("row_id"), "row_id").limit(bound).select(F.struct(vector_to_array("features").alias("v"), "label").alias("s"))
    packed = F.broadcast(bank.agg(F.collect_list("s").alias("bank")))  # bound rows at most
    own = test_rows.withColumn("v", vector_to_array("features"))
    square = lambda b: F.aggregate(F.zip_with("v", b["v"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    near = F.slice(F.array_sort(F.transform("bank", lambda b: F.struct(square(b).alias("d"), b["label"].alias("label")))), 1, k)
    found = own.crossJoin(packed).select("row_id", "label", near.alias("near"))
    mean = F.aggregate("near", F.lit(0.0), lambda a, x: a + x["label"]) / F.size("near")
    if task == "regression":
        return found.select("row_id", "label", mean.alias("prediction"))
    labels = F.transform("near", lambda x: x["label"])
    counts = F.array_sort(F.transform(F.array_distinct(labels), lambda c: F.struct((-F.size(F.filter(labels, lambda y: y == c))).alias("n"), c.alias("c"))))
    return found.select("row_id", "label", counts[0]["c"].alias("prediction"))


def landmarks(df: DataFrame, columns: list[str], target: str, task: str, most_rows: int = 2000, folds: int = 3) -> list[float]:
    """Cross-validated scores of four quick models (a small tree, a simple one, a linear one, neighbours) on a bounded sample."""
    rows, classes = prepare(df, columns, target)
    rows = with_folds(rows.orderBy(F.xxhash64("row_id"), "row_id").limit(most_rows), folds).cache()
    if task == "classification":
        quick = [DecisionTreeClassifier(maxDepth=3), NaiveBayes(modelType="gaussian"), LogisticRegression(maxIter=50), None]
    else:
        quick = [DecisionTreeRegressor(maxDepth=3), LinearRegression(regParam=1.0), None, DecisionTreeRegressor(maxDepth=5)]
    out = []
    for estimator in quick:
        got = []
        for i in range(folds):
            train_rows, test_rows = rows.where(F.col("fold") != i), rows.where(F.col("fold") == i)
            made = nearest_neighbours(train_rows, test_rows, task) if estimator is None else estimator.fit(train_rows).transform(test_rows)
            got.append(score(made, task))
        out.append(float(np.mean(got)))
    rows.unpersist()
    return out


def save(model, path: str) -> None:
    """A fitted model written as a pipeline."""
    (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pipeline(columns: list[str], estimator) -> Pipeline:
    """Assembler and estimator as one, for rows that come later."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"), estimator])
