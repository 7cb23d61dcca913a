"""Exact quantiles by selection: sketches bracket each quantile, and only the values inside the brackets are told apart.

No values are sorted or gathered: each pass is one aggregate of the rows by group, whose partial results are bounded. The
last pass counts the values inside a group's brackets one by one and all others by the gap between brackets that they are
in, so that the ranks are exact; a rank that falls into a gap shows that a sketch erred, and that group is counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import kept

#: Tables of so many groups at most are sent to all tasks; larger ones are kept in the shared folder and joined by key.
SENT_GROUPS = 10_000


def _settled(table: DataFrame) -> DataFrame:
    """A table of one row a group, computed once."""
    rows = table.limit(SENT_GROUPS + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= SENT_GROUPS else kept(table)


def _narrower(rows: DataFrame, by: list[str], value: str, state: DataFrame, at: tuple[float, ...], accuracy: int) -> DataFrame:
    """Brackets cut to the stretch of a sketch of what is inside them that holds the ranks."""
    v, steps = F.col(value), max(4, accuracy // 20)
    aggs = [F.first("__n").alias("__n"), F.first("__ends").alias("__ends")]
    for k in range(len(at)):
        inside = v.between(F.col("__ends")[2 * k], F.col("__ends")[2 * k + 1])
        aggs += [F.count_if(v < F.col("__ends")[2 * k]).alias(f"__b{k}"), F.count_if(inside).alias(f"__i{k}"), F.percentile_approx(F.when(inside, v), [i / steps for i in range(steps + 1)], accuracy).alias(f"__s{k}")]
    made = rows.join(state, by).groupBy(*by).agg(*aggs)
    ends, left = [], []
    for k, p in enumerate(at):
        low, high, n, sketch = F.col("__ends")[2 * k], F.col("__ends")[2 * k + 1], F.col(f"__i{k}"), F.col(f"__s{k}")
        place = F.lit(p) * (F.col("__n") - 1) - F.col(f"__b{k}")
        first, last = (F.floor(F.floor(place) / n * steps) - 1).cast("int"), (F.ceil((F.floor(place) + 2) / n * steps) + 1).cast("int")
        many = n > accuracy
        ends += [F.when(many & (first > 0), sketch[first]).otherwise(low), F.when(many & (last < steps), sketch[last]).otherwise(high)]
        left.append(F.when(many, n * 4 / steps).otherwise(n))
    return made.select(*by, "__n", F.array(*ends).alias("__ends"), F.greatest(*left, F.lit(0)).cast("long").alias("__inside"))


def _selected(rows: DataFrame, by: list[str], value: str, state: DataFrame, at: tuple[float, ...]) -> DataFrame:
    """``by..., n, q`` from counts of the values inside the brackets and of the gaps; null where a rank is in a gap."""
    v, ends, none = F.col(value), F.col("__ends"), F.lit(-math.inf)
    inside = F.lit(False)
    for k in range(len(at)):
        inside = inside | v.between(ends[2 * k], ends[2 * k + 1])
    gap = F.greatest(none, *(F.when(ends[2 * k + 1] < v, ends[2 * k + 1]) for k in range(len(at))))  # the bracket in front
    cell = F.struct(F.when(inside, v).otherwise(gap).alias("v"), (~inside).alias("gap"))
    counts = rows.join(state, by).groupBy(*by, cell.alias("__cell")).agg(F.count("*").alias("__c"))
    group = Window.partitionBy(*by)  # its rows are the values in brackets and the gaps
    ranked = counts.withColumns({"__upto": F.sum("__c").over(group.orderBy("__cell")), "__n": F.sum("__c").over(group)})
    places = [F.lit(p) * (F.col("__n") - 1) for p in at]
    holding = lambda rank: F.max(F.when(F.col("__upto") - F.col("__c") <= rank, F.col("__cell")))
    found = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *(holding(f(x)).alias(f"__{n}{k}") for k, x in enumerate(places) for n, f in (("lo", F.floor), ("hi", F.ceil))))

    def between(k: int, place: Column) -> Column:
        lo, hi = F.col(f"__lo{k}"), F.col(f"__hi{k}")
        mixed = F.when(lo["v"] == hi["v"], lo["v"]).otherwise((F.ceil(place) - place) * lo["v"] + (place - F.floor(place)) * hi["v"])
        return F.when(~lo["gap"] & ~hi["gap"], mixed)

    return found.select(*by, F.col("__n").alias("n"), F.array(*(between(k, x) for k, x in enumerate(places))).alias("q"))


def quantiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...], accuracy: int = 10_000, most: int = 100_000) -> DataFrame:
    """``by..., n, q``: the number of values of each group and its exact quantiles, interpolated in a line.

    Values that are null or NaN and rows with a null in ``by`` do not count; a group without values has no row, and neither
    has an empty table. Ties and repeated rows count each. Brackets hold about ``8 / accuracy`` of a group at first, and are
    narrowed until they hold about ``most`` rows; a group of ``accuracy`` rows or fewer is counted whole. A value that fills
    a third of all rows is one count in each task.
    """
    v = F.col(value).cast("double")
    known = v.isNotNull() & ~F.isnan(v)
    for c in by:
        known = known & F.col(c).isNotNull()
    rows = rows.where(known).select(*by, v.alias(value))
    around = 3 / accuracy
    points = [p + s for p in at for s in (-around, around)]
    sketch = F.percentile_approx(value, [min(1.0, max(0.0, p)) for p in points], accuracy)
    whole = F.array(*(F.lit(-math.inf if i % 2 == 0 else math.inf) for i in range(len(points))))
    first = F.array(*(F.lit(-math.inf) if p <= 0 else F.lit(math.inf) if p >= 1 else F.col("__s")[i] for i, p in enumerate(points)))
    small = F.col("__n") <= accuracy
    state = rows.groupBy(*by).agg(F.count("*").alias("__n"), sketch.alias("__s"))
    state = _settled(state.select(*by, "__n", F.when(small, whole).otherwise(first).alias("__ends"), F.when(small, F.col("__n")).otherwise(F.col("__n") * 8 / accuracy).cast("long").alias("__inside")))
    for _ in range(4):  # each pass leaves some hundredth of a bracket
        if (state.agg(F.max("__inside")).first()[0] or 0) <= most:
            break
        state = _settled(_narrower(rows, by, value, state, at, accuracy))
    out = _settled(_selected(rows, by, value, state, at))
    unsure = F.exists("q", lambda x: x.isNull())
    if out.where(unsure).isEmpty():
        return out
    again = _settled(out.where(unsure).select(*by, F.col("n").alias("__n"), whole.alias("__ends"), F.col("n").alias("__inside")))
    return out.where(~unsure).union(_selected(rows, by, value, again, at))


def of_columns(df: DataFrame, columns: dict[str, Column], at: tuple[float, ...]) -> dict[str, list[float]]:
    """Exact quantiles of expressions over a table by name, all in the same passes; columns without a value are absent."""
    if not columns:
        return {}
    names = list(columns)
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("position"), c.cast("double").alias("v")) for i, c in enumerate(columns.values())))))
    return {names[r["position"]]: list(r["q"]) for r in quantiles(cells, ["position"], "v", at).collect()}  # a row a column
