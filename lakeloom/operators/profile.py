"""Column statistics and what follows from them: roles, quality, warnings, anomalies.

Everything that a table's columns are judged by comes from one aggregate of its rows and one count of its values
(``column_stats``); the rules then run over one small row a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import words
from .quantiles import quantiles

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
WHOLE = ("tinyint", "smallint", "int", "bigint")


def kinds(df: DataFrame) -> dict[str, str]:
    """Each column's kind: numeric, boolean, datetime, string or complex."""

    def kind(t: str) -> str:
        if t in NUMERIC or t.startswith("decimal"):
            return "numeric"
        return {"boolean": "boolean", "string": "string"}.get(t, "datetime" if t in ("date", "timestamp", "timestamp_ntz") else "complex")

    return {c: kind(t) for c, t in df.dtypes}


#: What ``column_stats`` takes from the counts of values instead of from the rows.
FROM_COUNTS = ("distinct", "q1", "median", "q3", "tokens", "length", "numbers", "times", "cleaned", "digits")
_FROM_ROWS = ("mean", "std", "min", "max", "zeros")


def value_counts(df: DataFrame) -> DataFrame:
    """``position, s, d, n``: how often each column (by place) has each of its values; nulls and NaN are not counted.

    Numbers are in ``d``, as double; ``s`` has the text of all other values, and of numbers that a double may round.
    """
    cells = []
    for i, (name, kind) in enumerate(kinds(df).items()):
        c, dtype = F.col(f"`{name}`"), dict(df.dtypes)[name]
        d = E.finite(c.cast("double")) if kind == "numeric" else F.lit(None).cast("double")
        s = F.lit(None).cast("string") if kind == "numeric" and not (dtype == "bigint" or dtype.startswith("decimal")) else c.cast("string")
        if kind != "complex":
            cells.append(F.struct(F.lit(i).alias("position"), s.alias("s"), d.alias("d")))
    if not cells:
        return df.sparkSession.createDataFrame([], "position int, s string, d double, n long")
    return df.select(F.inline(F.array(*cells))).where("s is not null or d is not null").groupBy("position", "s", "d").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, exact: bool = True, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each column: name, kind, whole, rows, missing, distinct, and by kind mean ... outliers or text measures.

    Moments come from an aggregate of the rows; distinct values and text measures from counts of values, which one shuffle
    spreads over all tasks. ``exact``: quantiles as the values have them, by selection; else from bounded sketches of the
    counts' rows. ``wanted``: only these measures are computed, others are null.
    """
    known, dtypes = kinds(df), dict(df.dtypes)
    none = F.lit(None).cast("double")
    aggs, shapes = [F.count("*").alias("rows")], []
    for i, (name, kind) in enumerate(known.items()):
        c = F.col(f"`{name}`")
        if kind == "numeric":
            c = E.finite(c.cast("double")) if dtypes[name] in ("float", "double") else c
        parts: dict[str, Column] = {"n": F.count(c)}
        if kind == "numeric":
            d = c.cast("double")
            parts |= {"mean": F.avg(d), "std": F.stddev_samp(d), "min": F.min(d), "max": F.max(d), "zeros": F.count_if(d == 0)}
            parts = {k: v for k, v in parts.items() if wanted is None or k == "n" or k in wanted}
        aggs += [v.alias(f"{k}_{i}") for k, v in parts.items()]
        shapes.append(F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(dtypes[name] in WHOLE).alias("whole"), F.lit(i).alias("position"), F.col("rows"), (F.col("rows") - F.col(f"n_{i}")).alias("missing"),
            *((F.col(f"{k}_{i}").cast("double") if k in parts else none).alias(k) for k in _FROM_ROWS),
        ))
    moments = df.agg(*aggs).select(F.inline(F.array(*shapes)))
    higher = [k for k in ("skew", "kurtosis") if wanted is None or k in wanted]
    numbers = [F.struct(F.lit(i).alias("position"), E.finite(F.col(f"`{c}`").cast("double")).alias("d")) for i, (c, k) in enumerate(known.items()) if k == "numeric"]
    if higher and numbers:  # by column, so that the code for one column is small enough to be compiled
        shape = df.select(F.inline(F.array(*numbers))).groupBy("position").agg(*({"skew": E.skew, "kurtosis": E.kurtosis}[k](F.col("d")).alias(k) for k in higher))
        moments = moments.join(shape, "position", "left")
    moments = moments.withColumns({k: none for k in ("skew", "kurtosis") if k not in moments.columns})
    if wanted is not None and not set(wanted) & set(FROM_COUNTS):
        out = moments.withColumns({c: F.lit(None).cast("long") if c == "distinct" else none for c in FROM_COUNTS})
    else:
        n, text = F.col("n"), F.col("is_text")
        share = lambda v: E.ratio(F.sum(F.when(text, n * v)).cast("double"), F.sum(F.when(text & v.isNotNull(), n)))
        number = lambda test: F.sum(F.when(text, F.when(test, n).otherwise(0))).cast("double")
        value = F.col("s")
        measures = {"distinct": F.count("*"), "q": E.approx_quantile(F.col("d"), 0.25, 0.5, 0.75)}
        measures |= {"tokens": share(E.tokens(value)), "length": share(F.length(value)), "numbers": number(E.to_number(value).isNotNull()), "times": number(E.to_time(value).isNotNull())}
        measures |= {"cleaned": number(E.clean_number(value).isNotNull()), "digits": number(value.rlike(r"\d"))}
        keep = {"q"} if wanted is not None and {"q1", "median", "q3"} & set(wanted) else set()
        measures = {k: v for k, v in measures.items() if wanted is None or k in wanted or k in keep}
        selected = None
        if exact and measures.pop("q", None) is not None and numbers:
            selected = quantiles(df.select(F.inline(F.array(*numbers))), ["position"], "d", (0.25, 0.5, 0.75)).select("position", "q")
        strings = [i for i, k in enumerate(known.values()) if k == "string"]
        counts = value_counts(df).withColumn("is_text", F.col("position").isin(strings) if strings else F.lit(False))
        found = counts.groupBy("position").agg(*(v.alias(k) for k, v in measures.items())) if measures else selected
        if measures and selected is not None:
            found = found.join(selected, "position", "left")  # a row for each column on both sides
        if found is None:  # quantiles alone were asked for, and no column is numeric
            found = moments.select("position").limit(0)
        if "q" in found.columns:
            found = found.withColumns({k: F.col("q")[j].cast("double") for j, k in enumerate(("q1", "median", "q3"))})
        joined = moments.join(found, "position", "left")  # a row for each column on both sides
        simple = F.col("kind") != "complex"
        out = joined.withColumns({c: none for c in FROM_COUNTS if c not in joined.columns})
        out = out.withColumn("distinct", F.when(simple, F.coalesce(F.col("distinct"), F.lit(0))).cast("long") if "distinct" in measures else F.lit(None).cast("long"))
        out = out.withColumns({c: F.when(F.col("kind") == "string", F.coalesce(F.col(c), F.lit(0.0))) for c in ("numbers", "times", "cleaned", "digits") if c in measures})
    return out.select("name", "kind", "whole", "position", "rows", "missing", "distinct", "mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis", "zeros", "tokens", "length", "numbers", "times", "cleaned", "digits")


def role(name: str = "name", rows: str = "rows") -> Column:
    """The role that a column's statistics give: id, datetime, categorical, numeric, binary, text, empty or complex."""
    n = F.col(rows) - F.col("missing")
    share = F.coalesce(E.ratio(F.col("distinct"), n), F.lit(0.0))
    low = F.lower(F.trim(name))
    id_name = low.isin(list(words.ID_LIKE_NAMES)) | low.endswith("id") | low.startswith("id_")
    return (
        F.when(F.col("kind") == "complex", "complex").when(n == 0, "empty").when(F.col("kind") == "boolean", "binary").when(F.col("kind") == "datetime", "datetime")
        .when((F.col("kind") == "numeric") & id_name & (share > 0.9) & F.col("whole"), "id")
        .when((F.col("kind") == "numeric") & (F.col("distinct") <= 20) & (share < 0.05), "categorical").when(F.col("kind") == "numeric", "numeric")
        .when(F.col("times") == n, "datetime").when(share > 0.95, "id").when(F.col("tokens") > 5, "text").otherwise("categorical")
    )


def bi_role() -> Column:
    """The role by the dashboard's rules, in which rates count all rows."""
    date_name = E.any_of(F.lower("name"), list(words.DATE))
    times, numbers, unique = (E.ratio(F.col(c), F.col("rows")) for c in ("times", "numbers", "distinct"))
    return (
        F.when(F.col("kind") == "complex", "complex").when(F.col("kind") == "datetime", "datetime").when(F.col("kind") == "numeric", "numeric")
        .when((F.col("kind") == "string") & ((date_name & (times > 0.6)) | (times > 0.8)), "datetime").when((F.col("kind") == "string") & (numbers > 0.8), "numeric")
        .when((F.col("kind") == "string") & (unique > 0.95), "id").when((F.col("length") > 45) | ((F.col("length") > 25) & (unique > 0.5)), "text").otherwise("categorical")
    )


def roles(df: DataFrame) -> DataFrame:
    """``column_stats`` with both roles and shares."""
    stats = column_stats(df)
    return stats.withColumns({"role": role(), "bi_role": bi_role(), "missing_share": E.ratio(F.col("missing"), F.col("rows")), "distinct_share": E.ratio(F.col("distinct"), F.col("rows") - F.col("missing"))})


def target(found: list[tuple[str, str, int]]) -> str | None:
    """The column to predict, from (name, role, distinct) in column order."""
    names = [n for n, _, _ in found]
    for wanted in words.TARGET_NAMES:
        hit = next((n for n in names if n == wanted), None) or next((n for n in names if n.lower() == wanted), None)
        if hit:
            return hit
    if not found:
        return None
    if found[-1][1] in ("categorical", "binary", "numeric"):
        return found[-1][0]
    classes = [(d, i, n) for i, (n, r, d) in enumerate(found) if r in ("categorical", "binary")]
    if classes:
        return min(classes)[2]
    numeric = [n for n, r, _ in found if r == "numeric"]
    return numeric[-1] if numeric else names[-1]


def task(role_: str, distinct: int) -> str:
    """Classification for classes and for 20 values at most, else regression."""
    return "classification" if role_ in ("categorical", "binary") or distinct <= 20 else "regression"


def task_strict(kind: str, whole: bool, distinct: int) -> str:
    """The other rule: 20 values for whole numbers, 10 for others."""
    return "classification" if kind != "numeric" or distinct <= (20 if whole else 10) else "regression"


def duplicates(df: DataFrame) -> DataFrame:
    """``rows, distinct_rows, duplicates``."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def quality_score(df: DataFrame) -> DataFrame:
    """``score`` (0 to 100) from missing cells, duplicate rows, constant columns and near-unique strings; with its parts."""
    stats = column_stats(df, wanted=("distinct",)).agg(
        F.sum("missing").alias("m"), F.sum("rows").alias("cells"), F.count("*").alias("columns"), F.count_if(F.col("distinct") == 1).alias("constant"),
        F.count_if((F.col("kind") == "string") & (E.ratio(F.col("distinct"), F.col("rows")) > 0.9)).alias("near_unique"),
    )
    both = stats.crossJoin(duplicates(df))  # one row each
    missing, repeated = F.coalesce(E.ratio(F.col("m"), F.col("cells")), F.lit(0.0)), F.coalesce(E.ratio(F.col("duplicates"), F.col("rows")), F.lit(0.0))
    score = 100 - 30 * missing - 20 * repeated - 20 * F.col("constant") / F.col("columns") - 5 * F.col("near_unique")
    return both.select(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int").alias("score"), missing.alias("missing_share"), repeated.alias("duplicate_share"), "constant", "near_unique")


def warnings(df: DataFrame) -> DataFrame:
    """``name, warning`` for each column that has one."""
    share = 100 * F.col("missing_share")
    tests = {
        "missing_high": share > 50, "missing": (share > 20) & (share <= 50), "many_values": (F.col("role") == "categorical") & (F.col("distinct") > 100),
        "constant": F.col("distinct") == 1, "id": F.col("role") == "id",
    }
    found = F.filter(F.array(*(F.when(test, w) for w, test in tests.items())), lambda x: x.isNotNull())
    return roles(df).select("name", F.explode(found).alias("warning"))


def anomalies(df: DataFrame) -> DataFrame:
    """``name, anomaly, severity`` of numeric columns."""
    numeric = [c for c, k in kinds(df).items() if k == "numeric"]
    stats = column_stats(df.select(*numeric), wanted=("distinct", "mean", "std", "min", "q1", "median", "q3", "max"))
    mode = top_share(df, numeric).select("name", "share")
    iqr, std = F.col("q3") - F.col("q1"), F.col("std")
    tests = [
        ("extreme_high_outlier", "high", (iqr > 0) & (F.col("max") > F.col("q3") + 3 * iqr)), ("extreme_low_outlier", "high", (iqr > 0) & (F.col("min") < F.col("q1") - 3 * iqr)),
        ("heavy_skew", "medium", (std > 0) & (F.abs(F.col("mean") - F.col("median")) > 2 * std)), ("high_variability", "medium", F.abs(F.try_divide(std, F.col("mean"))) > 2),
        ("dominant_value", "low", (F.col("share") > 0.5) & (F.col("distinct") > 1)),
    ]
    found = F.filter(F.array(*(F.when(test, F.struct(F.lit(a).alias("anomaly"), F.lit(s).alias("severity"))) for a, s, test in tests)), lambda x: x.isNotNull())
    return stats.join(mode, "name", "left").select("name", F.inline(found))


def top_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """``name, value, n, share, low_share``: each column's most frequent value, its share of all rows, and the rarest one's."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = df.select(F.inline(cells)).groupBy("name", "value").agg(F.count("*").alias("n"))
    total = F.sum("n")
    known = F.col("value").isNotNull()
    best = counts.groupBy("name").agg(
        F.min_by(F.when(known, F.col("value")), F.when(known, F.struct(-F.col("n"), "value"))).alias("value"), F.max(F.when(known, F.col("n"))).alias("n"),
        F.min(F.when(known, F.col("n"))).alias("least"), total.alias("rows"), F.sum(F.when(known, F.col("n"))).alias("known"),
    )
    return best.select("name", "value", "n", E.ratio(F.col("n"), F.col("rows")).alias("share"), E.ratio(F.col("n"), F.col("known")).alias("known_share"), E.ratio(F.col("least"), F.col("known")).alias("least_share"))


def uniformity(df: DataFrame, column: str) -> DataFrame:
    """``canon, variants, n_variants, n`` where one value is written in several ways but for case and blanks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    groups = counts.groupBy(F.lower(F.trim("v")).alias("canon")).agg(F.array_sort(F.collect_set("v")).alias("variants"), F.sum("n").alias("n"))  # distinct spellings only
    return groups.where(F.size("variants") > 1).withColumn("n_variants", F.size("variants"))
