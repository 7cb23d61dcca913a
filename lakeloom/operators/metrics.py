"""Evaluation of predictions, and analytics of benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ordered import running_sums
from .quantiles import of_columns


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``label, predicted, n, share``: counts, and their share of the label's rows."""
    counts = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).cast("string").alias("label"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    return counts.join(totals, "label").select("label", "predicted", "n", (F.col("n") / F.col("total")).alias("share"))


def class_errors(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``label, total, errors, error_pct`` by class."""
    wrong = F.col(label) != F.col(predicted)
    out = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("total"), F.count_if(wrong).alias("errors"))
    return out.withColumn("error_pct", F.round(100 * F.col("errors") / F.col("total"), 2))


def classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and weighted precision, recall and F1, from the confusion counts."""
    counts = confusion(df, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    by_label = counts.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_guess = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("guessed"))
    per = by_label.join(by_guess, "label", "left")
    precision, recall = F.coalesce(E.ratio(F.col("tp"), F.col("guessed")), F.lit(0.0)), E.ratio(F.col("tp"), F.col("support"))
    f1 = F.coalesce(E.ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    w = F.sum("support")
    return per.agg((F.sum("tp") / w).alias("accuracy"), (F.sum(precision * F.col("support")) / w).alias("precision"), (F.sum(recall * F.col("support")) / w).alias("recall"), (F.sum(f1 * F.col("support")) / w).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve of a score for label 1, by counts at each distinct score; ties count half.

    Running counts are taken over the distinct scores, so the ordered pass sees values, not rows.
    """
    at = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    below = running_sums(at, ["s"], upto=F.col("q")).withColumn("below", F.col("upto") - F.col("q"))
    return below.agg(E.ratio(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def regression(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """R², MAE, MSE, RMSE and the median absolute error, which is found by selection: no task holds the errors."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(predicted).cast("double")
    rows = df.select(y.alias("y"), e.alias("e")).dropna()
    mse = F.avg(F.col("e") * F.col("e"))
    (median,) = of_columns(rows, {"e": F.abs("e")}, (0.5,)).get("e", [None])
    return rows.agg((1 - E.ratio(mse, F.var_pop("y"))).alias("r2"), F.avg(F.abs("e")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.lit(median).cast("double").alias("median_error"))


def errors_by_quartile(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``part, n, mae`` for the lowest quarter of the label, the middle, and the highest; quartiles are found by selection."""
    rows = df.select(F.col(label).cast("double").alias("y"), F.abs(F.col(label) - F.col(predicted)).cast("double").alias("e")).dropna()
    low, high = (F.lit(x).cast("double") for x in of_columns(rows, {"y": F.col("y")}, (0.25, 0.75)).get("y", [None, None]))
    part = F.when(F.col("y") <= low, "low").when(F.col("y") >= high, "high").otherwise("middle")
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("e").alias("mae"))


def worst_predictions(df: DataFrame, label: str, predicted: str, row_id: str, n: int = 10) -> DataFrame:
    """The rows with the largest absolute error, ties by id."""
    return df.withColumn("abs_error", F.abs(F.col(label) - F.col(predicted))).orderBy(F.desc_nulls_last("abs_error"), row_id).limit(n)


def overfitting(train: float, cv: float, spread: float, classification_: bool = True) -> list[str]:
    """Which of the signs of overfitting hold: a perfect score, a gap to cross-validation, unsteady folds."""
    signs = {"perfect_score": train > (0.98 if classification_ else 0.99), "gap": train - cv > 0.05, "unsteady": spread > 0.15}
    return [k for k, v in signs.items() if v]


def ranks(scores: DataFrame, by: str = "dataset", item: str = "model", score: str = "score") -> DataFrame:
    """Adds ``rank`` (1 is best, ties by name), ``reward`` (1 - best tied rank over n) and ``regret`` within each dataset."""
    group = Window.partitionBy(by)
    best = group.orderBy(F.desc(score))
    return scores.withColumns({
        "rank": F.row_number().over(group.orderBy(F.desc(score), item)), "reward": 1 - (F.rank().over(best) - 1) / F.count("*").over(group), "regret": F.max(score).over(group) - F.col(score),
    })


def selection_summary(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """How well one chosen model a dataset does: top-1 and top-3 share, mean and median regret and rank.

    ``scores``: dataset, model, score; ``chosen``: dataset, model.
    """
    hit = ranks(scores).join(chosen, ["dataset", "model"])
    half = of_columns(hit, {"regret": F.col("regret"), "rank": F.col("rank")}, (0.5,))
    median = lambda c: F.lit(half.get(c, [None])[0]).cast("double").alias(f"median_{c}")
    return hit.agg(
        F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 3).cast("double")).alias("top3"), F.avg("regret").alias("mean_regret"),
        median("regret"), F.avg("rank").alias("mean_rank"), median("rank"), F.count("*").alias("datasets"),
    )


def oracle_frequency(scores: DataFrame) -> DataFrame:
    """``model, best_on``: how many datasets each model is best on."""
    return ranks(scores).where("rank = 1").groupBy("model").agg(F.count("*").alias("best_on"))


def baselines(scores: DataFrame, always: list[str]) -> DataFrame:
    """``strategy, mean_score``: the oracle, a random model (its mean), and always the same one."""
    per = scores.groupBy("dataset").agg(F.max("score").alias("oracle"), F.avg("score").alias("random"), *(F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"always_{m}") for m in always))
    names = ["oracle", "random", *(f"always_{m}" for m in always)]
    return per.agg(*(F.avg(n).alias(n) for n in names)).select(F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col(n).alias("mean_score")) for n in names))))


def wins(pairs: DataFrame, a: str, b: str, margin: float = 0.01) -> DataFrame:
    """Wins, exact ties and losses of ``a`` over ``b``, and disjoint counts at a margin."""
    d = F.col(a) - F.col(b)
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.count_if(d > margin).alias("clear_wins"), F.count_if(F.abs(d) <= margin).alias("near"), F.count_if(d < -margin).alias("clear_losses"), F.avg(d).alias("mean_gap"),
    )


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sum of positive differences, number of differences, and z by the normal approximation; mid-ranks for ties."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d is not null and d <> 0")
    sizes = d.groupBy(F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("pos"))
    mid = running_sums(sizes, ["size"], upto=F.col("n")).withColumn("mid", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    n = F.sum("n").cast("double")
    out = mid.agg(F.coalesce(F.sum(F.col("mid") * F.col("pos")), F.lit(0.0)).alias("w_plus"), F.coalesce(n, F.lit(0.0)).alias("n"), (n * (n + 1) * (2 * n + 1) / 24 - F.sum(F.pow("n", F.lit(3)) - F.col("n")) / 48).alias("v"))
    return out.select("w_plus", "n", E.ratio(F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4, F.sqrt("v")).alias("z"))


def done_already(todo: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """What is left to do: rows whose key is not in the log."""
    return todo.join(log.select(key).distinct(), key, "left_anti")


def rolling_mean(df: DataFrame, by: str, order: str, value: str, window: int = 200) -> DataFrame:
    """Adds ``smooth``: the mean of the last rows of each run."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(-(window - 1), 0)))


def last_turns(df: DataFrame, conversation: str, turn: str, n: int = 8) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
