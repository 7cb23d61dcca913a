"""Cleaning: coercion, duplicates, missing values, outliers, spellings, and columns derived from others.

Each operator looks at small aggregates first and then rewrites rows with built-in expressions, in one plan each.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import words
from . import neighbours
from .profile import kinds
from .quantiles import of_columns


@dataclasses.dataclass
class CleaningReport:
    """What was done to each column."""

    rows_before: int = 0
    rows_after: int = 0
    strategies: dict[str, str] = dataclasses.field(default_factory=dict)
    bounds: dict[str, tuple[float, float, int]] = dataclasses.field(default_factory=dict)
    transformations: list[str] = dataclasses.field(default_factory=list)


def coerce_numbers(df: DataFrame, least: float = 0.8, least_digits: float = 0.5) -> tuple[DataFrame, list[str]]:
    """String columns that hold decorated numbers, as double: at least half of the values have a digit and four fifths parse."""
    strings = [c for c, k in kinds(df).items() if k == "string"]
    if not strings:
        return df, []
    row = df.agg(*(x for i, c in enumerate(strings) for x in (F.count(F.col(c)).alias(f"n{i}"), F.count_if(F.col(c).rlike(r"\d")).alias(f"d{i}"), F.count(E.clean_number(F.col(c))).alias(f"p{i}")))).first()
    chosen = [c for i, c in enumerate(strings) if row[f"n{i}"] and row[f"d{i}"] >= least_digits * row[f"n{i}"] and row[f"p{i}"] >= least * row[f"n{i}"]]
    return df.withColumns({c: E.clean_number(F.col(c)) for c in chosen}) if chosen else df, chosen


def coerce_plain(df: DataFrame, least: float = 0.85) -> tuple[DataFrame, list[str]]:
    """Strings trimmed; those of which 85 % of all rows (three at least) are numbers but for commas, dollar and percent signs, as double."""
    strings = [c for c, k in kinds(df).items() if k == "string"]
    if not strings:
        return df, []
    row = df.agg(F.count("*").alias("rows"), *(F.count(E.plain_number(F.col(c))).alias(f"p{i}") for i, c in enumerate(strings))).first()
    chosen = [c for i, c in enumerate(strings) if row[f"p{i}"] >= 3 and row[f"p{i}"] >= least * row["rows"]]
    return df.withColumns({c: E.plain_number(F.col(c)) if c in chosen else F.trim(F.col(c)) for c in strings}), chosen


def present(df: DataFrame, name: str) -> Column:
    """A column in which NaN and infinities of floating columns are null, as they count as missing."""
    c = F.col(f"`{name}`")
    return E.finite(c.cast("double")) if dict(df.dtypes)[name] in ("float", "double") else c


def drop_sparse_columns(df: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Without the columns that are missing in that share of rows or more."""
    row = df.agg(F.count("*"), *(F.count(present(df, c)) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c, n in zip(df.columns, row[1:], strict=True) if row[0] == 0 or 1 - n / row[0] < most_missing))


def fix_types(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Columns cast by role: numeric to double, categorical to string, datetime to timestamp; what does not parse is null."""
    text = {c for c, k in kinds(df).items() if k == "string"}
    casts = {"numeric": lambda c: E.to_number(F.col(c)) if c in text else F.col(c).cast("double"), "categorical": lambda c: F.col(c).cast("string"), "datetime": lambda c: E.to_time(F.col(c)) if c in text else F.col(c).cast("timestamp")}
    return df.withColumns({c: casts[r](c) for c, r in roles.items() if r in casts})


def missing_plan(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: rows, missing share, mean, median, skewness (numeric) or mode (others), the medians by selection."""
    known = kinds(df)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(present(df, c)).alias(f"n{i}"))
        if known[c] == "numeric":
            d = E.finite(F.col(c).cast("double"))
            aggs += [F.avg(d).alias(f"mean{i}"), E.skew(d).alias(f"skew{i}")]
        else:
            aggs.append(F.mode(F.col(c), True).alias(f"mode{i}"))
    row = df.agg(*aggs).first().asDict()
    medians = of_columns(df, {c: E.finite(F.col(c).cast("double")) for c in columns if known[c] == "numeric"}, (0.5,))
    row |= {f"median{i}": medians[c][0] for i, c in enumerate(columns) if c in medians}
    keys = ("mean", "median", "skew", "mode")
    return {c: {"missing": 1 - row[f"n{i}"] / row["rows"] if row["rows"] else 0.0} | {k: row.get(f"{k}{i}") for k in keys} for i, c in enumerate(columns)}


def impute(df: DataFrame, columns: list[str] | None = None, near: int | None = 5) -> tuple[DataFrame, dict[str, str]]:
    """Missing values filled, and how each column was.

    Numeric: under 5 % the median where abs(skewness) > 1, else the mean; under 30 % the mean of the ``near`` nearest rows over
    all numeric columns of ``columns`` as they came (the median where there is one such column, or ``near`` is None);
    from 30 % the median and a column ``{c}_missing``. Others: under 10 % the mode (smallest of ties), else ``Missing``.
    """
    known = kinds(df)
    columns = columns or [c for c, k in known.items() if k in ("numeric", "string")]
    plan = missing_plan(df, columns)
    new: dict[str, Column] = {}
    done: dict[str, str] = {}
    usable = [c for c in columns if known[c] == "numeric" and plan[c]["median"] is not None][: neighbours.MOST_COLUMNS]
    by_rows = [c for c in usable if 0.05 <= plan[c]["missing"] < 0.3] if near and len(usable) > 1 else []
    if by_rows:
        others = {c: df.schema[c].dataType for c in usable if c not in by_rows}
        df = neighbours.impute_nearest(df, usable, None, near, only=by_rows).withColumns({c: F.col(c).cast(t) for c, t in others.items()})
    for c in columns:
        p = plan[c]
        if not p["missing"]:
            continue
        if c in by_rows:
            done[c] = "knn"
        elif known[c] == "numeric":
            if p["median"] is None:
                continue
            mean = p["missing"] < 0.05 and abs(p["skew"] or 0) <= 1
            if p["missing"] >= 0.3:
                new[f"{c}_missing"] = present(df, c).isNull().cast("int")
            value = p["mean"] if mean else p["median"]
            new[c] = F.coalesce(E.finite(F.col(c).cast("double")), F.lit(float(value)))
            done[c] = "mean" if mean else "median_indicator" if p["missing"] >= 0.3 else "median"
        elif p["missing"] < 0.1 and p["mode"] is not None:
            new[c], done[c] = F.coalesce(F.col(c), F.lit(p["mode"])), "mode"
        else:
            new[c], done[c] = F.coalesce(F.col(c), F.lit("Missing")), "constant"
    return df.withColumns(new), done


def impute_knn(df: DataFrame, columns: list[str], row_id: str | None = None, k: int = 5) -> DataFrame:
    """Missing numeric values as the mean of the ``k`` nearest of all rows that have the column (see ``neighbours``); exact."""
    return neighbours.impute_nearest(df, columns, row_id, k)


def fill_in_order(df: DataFrame, column: str, order: list[str], by: list[str]) -> DataFrame:
    """Missing values from the row before, else the row after, within each ``by`` group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def outlier_bounds(df: DataFrame, columns: list[str], factor: float = 1.5, exact: bool = True) -> dict[str, tuple[float, float, int, int]]:
    """Per column: lower and upper fence, values outside, values; the same passes for all columns."""
    value = {c: E.finite(F.col(c).cast("double")) for c in columns}
    if exact:
        found = of_columns(df, value, (0.25, 0.75))
    else:
        row = df.agg(*(E.approx_quantile(value[c], 0.25, 0.75).alias(f"q{i}") for i, c in enumerate(columns))).first()
        found = {c: row[f"q{i}"] for i, c in enumerate(columns)}
    fences = {c: (q[0] - factor * (q[1] - q[0]), q[1] + factor * (q[1] - q[0])) for c in columns if (q := found.get(c)) and q[0] is not None}
    if not fences:
        return {}
    row = df.agg(*(x for c, (lo, hi) in fences.items() for x in (F.count_if(~value[c].between(lo, hi)).alias(f"o_{c}"), F.count(value[c]).alias(f"n_{c}")))).first()
    return {c: (lo, hi, row[f"o_{c}"], row[f"n_{c}"]) for c, (lo, hi) in fences.items()}


def winsorize(df: DataFrame, columns: list[str], most: float = 0.05, exact: bool = True) -> tuple[DataFrame, dict[str, tuple[float, float, int]]]:
    """Columns with some outliers, but under 5 % of them, clipped to the fences."""
    found = {c: b for c, b in outlier_bounds(df, columns, exact=exact).items() if 0 < b[2] < most * b[3]}
    return df.withColumns({c: E.clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi, _, _) in found.items()}) if found else df, {c: (round(lo, 4), round(hi, 4), n) for c, (lo, hi, n, _) in found.items()}


def standardize(df: DataFrame, column: str, most_values: int = 50) -> DataFrame:
    """Spellings that differ in case and blanks only, as the most frequent of them (smallest of ties).

    Columns with more than ``most_values`` values are left as they are; so the lookup is small.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    values = counts.limit(most_values + 1).collect()
    if len(values) > most_values:
        return df
    groups: dict[str, list[tuple[int, str]]] = {}
    for r in values:
        groups.setdefault(r["__v"].strip().lower(), []).append((-r["__n"], r["__v"]))
    lookup = {v: min(g)[1] for g in groups.values() if len(g) > 1 for _, v in g}
    if not lookup:
        return df
    table = F.create_map(*(F.lit(x) for pair in sorted(lookup.items()) for x in pair))
    return df.withColumn(column, F.coalesce(table[F.col(column)], F.col(column)))


def categorize(c: Column, library: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The first category of a library of which a value has a word as a part; null for none."""
    low, out = F.lower(F.trim(c.cast("string"))), F.lit(None).cast("string")
    for label, parts in reversed((library or words.CATEGORY_LIBRARY).items()):
        out = F.when(E.any_of(low, parts), label).otherwise(out)
    return out


def add_category(df: DataFrame, column: str, library: dict[str, tuple[str, ...]] | None = None, least: float = 0.5) -> tuple[DataFrame, float]:
    """``{column}_category`` where two categories and half of the rows at least are covered; and the coverage."""
    cat = categorize(F.col(column), library)
    row = df.agg(F.avg(cat.isNotNull().cast("double")).alias("share"), F.count_distinct(cat).alias("n")).first()
    share = row["share"] or 0.0
    return (df.withColumn(f"{column}_category", cat) if row["n"] >= 2 and share >= least else df), share


def checked_mapping(df: DataFrame, column: str, mapping: dict[str, str], confidence: float, least: float = 0.5) -> DataFrame:
    """``{column}_category`` from a suggested value-to-category mapping, if it is sure enough, has two categories and covers half of the rows; else the table as it is."""
    if confidence < 0.5 or len(set(mapping.values())) < 2:
        return df
    table = F.create_map(*(F.lit(x) for pair in sorted(mapping.items()) for x in pair))
    label = F.try_element_at(table, F.col(column).cast("string"))
    share = df.agg(F.avg(label.isNotNull().cast("double"))).first()[0] or 0.0
    return df.withColumn(f"{column}_category", label) if share >= least else df


def map_values(df: DataFrame, column: str, mapping: DataFrame, new: str) -> DataFrame:
    """A looked-up column from a table ``value, label`` of any size; misses are null."""
    lookup = mapping.select(F.col("value").alias("__value"), F.col("label").alias(new)).dropDuplicates(["__value"])
    return df.join(lookup, F.col(column) == F.col("__value"), "left").drop("__value")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end; null where negative."""
    hours = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9
    return F.when(hours >= 0, hours)


def duration_pair(columns: list[str]) -> tuple[str, str] | None:
    """Which datetime columns begin and end something: by name, else the first two."""
    start = next((c for c in columns if any(h in c.lower() for h in words.START_TIMES)), None)
    end = next((c for c in columns if c != start and any(h in c.lower() for h in words.END_TIMES)), None)
    return (start, end) if start and end else (columns[0], columns[1]) if len(columns) >= 2 and not start and not end else None


def add_duration(df: DataFrame, start: str, end: str, least: float = 0.3) -> tuple[DataFrame, str | None]:
    """``duration_hours``, or ``duration_days`` where the median is over two days; none where too few rows have one."""
    hours = hours_between(F.col(start), F.col(end))
    row = df.agg(F.avg((hours > 0).cast("double")).alias("all"), F.count("*").alias("rows"), F.count_if(hours > 0).alias("n")).first()
    if not row["rows"] or row["n"] < least * row["rows"]:
        return df, None
    (mid,) = of_columns(df, {"hours": F.when(hours > 0, hours)}, (0.5,)).get("hours", [0.0])
    unit = "days" if mid > 48 else "hours"
    name = f"duration_{unit}" if f"duration_{unit}" not in df.columns else f"{start}_to_{end}_{unit}"
    return df.withColumn(name, hours / 24 if unit == "days" else hours), name


def add_clock(df: DataFrame, columns: list[str]) -> DataFrame:
    """Hour and name of the day of the first three datetime columns."""
    return df.withColumns({k: v for c in columns[:3] for k, v in ((f"{c}_hour", F.hour(c)), (f"{c}_day_of_week", F.date_format(c, "EEEE")))})


def clean(df: DataFrame) -> tuple[DataFrame, CleaningReport]:
    """The whole path in its order: coerce, drop duplicates, impute, clip, standardize."""
    report = CleaningReport(rows_before=df.count())
    df, coerced = coerce_numbers(df)
    df = df.dropDuplicates()
    report.rows_after = df.count()
    df, report.strategies = impute(df)
    numeric = [c for c, k in kinds(df).items() if k == "numeric" and not c.endswith("_missing")]
    df, report.bounds = winsorize(df, numeric)
    for c in [c for c, k in kinds(df).items() if k == "string"]:
        df = standardize(df, c)
    report.transformations = [f"number: {c}" for c in coerced]
    return df, report
