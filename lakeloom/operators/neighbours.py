"""Exact nearest neighbours as a join, and imputation by them.

Rows are compared in the columns that both have, as distances with gaps are: the root of the squared differences, scaled up
by all columns over shared ones. Every pair of patterns (what a receiver has, what a donor has) is a space of its own with
plain Euclidean distances, so that the triangle inequality prunes inside it:

1. donors that are equal in a space's columns are cut to the ``k`` with the smallest ids, receivers to distinct ones, so
   copies cost nothing, however many there are;
2. donors go to the nearest of a bounded number of pivots; each pivot's farthest donor is its radius;
3. each receiver searches the donors of its own pivot, which bounds the distance of its ``k``-th neighbour;
4. it then searches those pivots alone whose nearest possible donor (distance to the pivot less radius) is within that bound.

Pivots' donors and receivers are dealt into blocks of ``BLOCK`` rows, so no task gets more than one block of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ordered import free_name, kept

#: Pivots of a space at most (else the root of its donors), rows of a block, and columns at most (bits of a pattern).
PIVOTS, BLOCK, MOST_COLUMNS = 512, 4096, 62

_FOUND = "space int, v array<double>, distance double, id long, donor array<double>"


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of the rows of ``a`` to those of ``b``, some rows at a time, by differences (no cancellation)."""
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        total = np.zeros((len(a[i : i + step]), len(b)))
        for c in range(a.shape[1]):
            total += np.square(a[i : i + step, c, None] - b[None, :, c])
        yield i, np.sqrt(total)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _assign(pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds each row's nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pivot, distance = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            for space, at in batch.groupby("space").indices.items():
                for i, d in _distances(_matrix(batch["coords"].iloc[at]), pivots[space]):
                    some = at[i : i + len(d)]
                    pivot[some] = d.argmin(axis=1)
                    distance[some] = d.min(axis=1)
            yield batch.assign(pivot=pivot, apart=distance)

    return run


def _others(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The pivots, besides its own, that a receiver has to search: a row for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for space, at in batch.groupby("space").indices.items():
                rows = batch.iloc[at]
                bound = rows["bound"].to_numpy(dtype=float) * (1 + 1e-9) + 1e-12
                for i, d in _distances(_matrix(rows["coords"]), pivots[space]):
                    near = d - radius[space][None, :] <= bound[i : i + len(d), None]
                    near[np.arange(len(d)), rows["pivot"].to_numpy()[i : i + len(d)]] = False
                    who, where = np.nonzero(near)
                    yield rows.iloc[i + who][["space", "v", "coords"]].assign(pivot=where)

    return run


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The ``k`` nearest donors of each receiver in one block of each, equal distances by id."""

    def run(receivers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if not len(receivers) or not len(donors):
            return pd.DataFrame({"space": pd.Series(dtype="int32"), "v": [], "distance": pd.Series(dtype=float), "id": pd.Series(dtype="int64"), "donor": []})
        donors = donors.sort_values("id", kind="stable")
        who, what, how = [], [], []
        for i, d in _distances(_matrix(receivers["coords"]), _matrix(donors["coords"])):
            best = np.argsort(d, axis=1, kind="stable")[:, :k]  # donors stand by id
            who.append(np.repeat(np.arange(i, i + len(d)), best.shape[1]))
            what.append(best.ravel())
            how.append(np.take_along_axis(d, best, axis=1).ravel())
        who, what = np.concatenate(who), np.concatenate(what)
        left, right = receivers.iloc[who], donors.iloc[what]
        return pd.DataFrame({"space": left["space"].to_numpy(), "v": left["v"].to_numpy(), "distance": np.concatenate(how), "id": right["id"].to_numpy(), "donor": right["donor"].to_numpy()})

    return run


def _met(receivers: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of the donors at the pivots where receivers stand, from blocks of bounded size."""
    keys = ["space", "pivot"]
    sizes = receivers.groupBy(keys).agg(F.ceil(F.count("*") / BLOCK).alias("r")).join(donors.groupBy(keys).agg(F.ceil(F.count("*") / BLOCK).alias("d")), keys)
    sizes = F.broadcast(kept(sizes))  # a row for each space and pivot
    deal = lambda n: F.pmod(F.xxhash64("coords", "v"), F.col(n))
    left = receivers.select("space", "pivot", "v", "coords").join(sizes, keys).select(*keys, "v", "coords", deal("r").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("db"))
    right = donors.withColumn("v", F.array("id")).join(sizes, keys).select(*keys, "id", "coords", "donor", deal("d").alias("db"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("rb"))
    block = [*keys, "rb", "db"]
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(_search(k), _FOUND)


def nearest(rows: DataFrame, width: int, k: int) -> DataFrame:
    """For every distinct incomplete row of ``rows`` (``id long, pattern long, v array<double>`` with 0 for what is missing): its
    nearest complete-enough rows, as ``pattern, v, distance, id, donor, has``: ``k`` for each pattern ``has`` of donors."""
    spark = rows.sparkSession
    whole = (1 << width) - 1
    counts = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    spaces = [(n, p, d, p & d) for n, (p, d) in enumerate((p, d) for p in sorted(counts) for d in sorted(counts) if p != whole and p & d and d & ~p)]
    if not spaces:
        return spark.createDataFrame([], "pattern long, v array<double>, distance double, id long, donor array<double>, has long")
    table = F.broadcast(spark.createDataFrame(spaces, "space int, receiver long, has long, common long"))
    coords = F.array(*(F.when(F.shiftright("common", i).bitwiseAND(1) == 1, F.col("v")[i]).otherwise(0.0) for i in range(width)))
    first = F.row_number().over(Window.partitionBy("space", "coords").orderBy("id"))
    donors = rows.join(table, rows["pattern"] == table["has"]).select("space", "id", coords.alias("coords"), F.col("v").alias("donor")).withColumn("n", first).where(F.col("n") <= k).drop("n")
    donors = kept(donors)
    receivers = kept(rows.where(F.col("pattern") != whole).select("pattern", "v").distinct().join(table, F.col("pattern") == F.col("receiver")).select("space", "v", coords.alias("coords")))
    many = {n: max(1, min(PIVOTS, math.isqrt(counts[d]))) for n, _, d, _ in spaces}
    order = F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("coords"), "id"))
    chosen = donors.withColumn("n", order).where(F.col("n") <= max(many.values())).select("space", "n", "coords").collect()  # PIVOTS rows a space at most
    pivots = {n: np.array([r["coords"] for r in chosen if r["space"] == n and r["n"] <= many[n]], dtype=float) for n, *_ in spaces}
    donors = kept(donors.mapInPandas(_assign(pivots), "space int, id long, coords array<double>, donor array<double>, pivot long, apart double"))
    receivers = receivers.mapInPandas(_assign(pivots), "space int, v array<double>, coords array<double>, pivot long, apart double")
    receivers = kept(receivers)
    far = donors.groupBy("space", "pivot").agg(F.max("apart").alias("radius")).collect()  # a row for each pivot
    radius = {n: np.full(len(pivots[n]), -np.inf) for n, *_ in spaces}
    for r in far:
        radius[r["space"]][r["pivot"]] = r["radius"]
    ranked = F.row_number().over(Window.partitionBy("space", "v").orderBy("distance", "id"))
    best = lambda df: df.withColumn("n", ranked).where(F.col("n") <= k).drop("n")
    own = kept(best(_met(receivers, donors, k)))
    bound = own.groupBy("space", "v").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(math.inf)).alias("bound"))
    bounded = receivers.join(bound, ["space", "v"], "left").select("space", "v", "coords", "pivot", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    more = kept(bounded.mapInPandas(_others(pivots, radius), "space int, v array<double>, coords array<double>, pivot long"))
    found = best(own.union(_met(more, donors, k)))
    scale = F.sqrt(F.lit(float(width)) / F.bit_count("common"))
    return found.join(table, "space").select(F.col("receiver").alias("pattern"), "v", (F.col("distance") * scale).alias("distance"), "id", "donor", "has")


def impute_nearest(df: DataFrame, columns: list[str], row_id: str | None = None, k: int = 5, only: list[str] | None = None) -> DataFrame:
    """Missing values of numeric columns (all, or ``only`` some) as the mean of the ``k`` nearest rows that have the column.

    All rows are donors for the columns they have. Equal distances go to the smaller ``row_id`` (not a whole number, or not
    given: the hash of it, or of the row). Fewer than ``k`` donors are averaged as they are; a row that shares no column with any donor
    gets the column's mean, and a column without a value stays null. Null, NaN and infinite values are missing; repeated rows
    get the same values; an empty table stays empty; other columns stay as they are, and the columns become doubles.
    """
    if not 0 < len(columns) <= MOST_COLUMNS:
        raise ValueError(f"1 to {MOST_COLUMNS} columns")
    kinds = dict(df.dtypes)
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]
    key = F.xxhash64(*plain) if row_id is None else F.col(row_id).cast("long") if kinds[row_id] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(row_id)
    value = {c: E.finite(F.col(c).cast("double")) for c in columns}
    pattern = sum((F.when(value[c].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)), F.lit(0).cast("long")).cast("long")
    packed = F.array(*(F.coalesce(value[c] + F.lit(0.0), F.lit(0.0)) for c in columns))
    rows = kept(df.select(F.coalesce(key, F.lit(0)).cast("long").alias("id"), pattern.alias("pattern"), packed.alias("v")))
    found = nearest(rows, len(columns), k)
    near = found.groupBy("pattern", "v").agg(F.array_sort(F.collect_list(F.struct("distance", "id", "donor", "has"))).alias("near"))  # k rows for each pattern of donors

    def mean(i: int) -> Column:
        with_it = F.slice(F.filter("near", lambda x: F.shiftright(x["has"], i).bitwiseAND(1) == 1), 1, k)
        return F.try_divide(F.aggregate(with_it, F.lit(0.0), lambda s, x: s + x["donor"][i]), F.size(with_it))

    names = {c: free_name(df, f"near_{i}") for i, c in enumerate(columns)}
    p, v = free_name(df, "pattern"), free_name(df, "v")
    filled = near.select(F.col("pattern").alias(p), F.col("v").alias(v), *(mean(i).alias(names[c]) for i, c in enumerate(columns)))
    means = rows.agg(*(F.avg(F.when(F.shiftright("pattern", i).bitwiseAND(1) == 1, F.col("v")[i])).alias(str(i)) for i in range(len(columns)))).first()
    wanted = columns if only is None else only
    joined = df.withColumns({p: pattern, v: packed}).join(filled, [p, v], "left")
    gap = {c: F.coalesce(value[c], F.col(names[c]), F.lit(means[str(i)]).cast("double")) if c in wanted else value[c] for i, c in enumerate(columns)}
    return joined.withColumns(gap).select(*df.columns)
