"""Ordered passes over a whole table without a single task: range partitions, each numbered or summed by itself, and offsets.

A table is sorted once by range. What a partition adds (rows, sums) is one row for each partition, so the offsets in front
of the partitions are all that comes to the driver, and a row's place in the whole is its partition's offset and its place
inside it.
"""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` keeps the partition above this bit, and the row inside it below.
ROW_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is not set, a temporary folder on a local master and an error elsewhere."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def placed(df: DataFrame, *order: Column | str, place: str = "at") -> DataFrame:
    """``df`` sorted by range and kept, with each row's partition and place in it as one long column."""
    return kept(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))


def partition_of(place: str) -> Column:
    return F.shiftright(F.col(place), ROW_BITS)


def _offsets(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """``part`` and what all partitions before it add to, from (part, added...) of each partition."""
    parts = sorted(parts)
    width = len(parts[0]) - 1 if parts else 1
    before = [list(itertools.accumulate([0, *(p[i + 1] for p in parts)]))[:-1] for i in range(width)]
    kinds = ", ".join(f"o{i} {'double' if any(isinstance(x, float) for x in before[i]) else 'long'}" for i in range(width))
    rows = [(p[0], *((float(before[i][n]) if any(isinstance(x, float) for x in before[i]) else before[i][n]) for i in range(width))) for n, p in enumerate(parts)]
    return F.broadcast(spark.createDataFrame(rows, f"part long, {kinds}"))


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``order``; an empty table gives no rows.

    Rows that tie in all of ``order`` are numbered in any order, but each place comes once. Nulls stand where ``order``
    puts them. A third of all rows with one key are one partition of the sort unless ``order`` goes on to another key.
    """
    at, part = free_name(df, "at"), free_name(df, "part")
    made = placed(df, *order, place=at)
    ends = made.groupBy(partition_of(at).alias("part")).agg(F.count("*").alias("n")).collect()
    offsets = _offsets(df.sparkSession, [(r["part"], r["n"]) for r in ends]).withColumnsRenamed({"part": part, "o0": f"{part}_o"})
    row = F.col(at).bitwiseAND((1 << ROW_BITS) - 1)
    return made.withColumn(part, partition_of(at)).join(offsets, part).withColumn(name, F.col(f"{part}_o") + row + 1).select(*df.columns, name)


def running_sums(df: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """``df`` with running sums, this row included, of the given columns (name=column) in an order without ties.

    Each sum starts again in its range partition and gets the total of the partitions in front of it.
    """
    at, part = free_name(df, "at"), free_name(df, "part")
    made = placed(df.withColumns({f"{part}_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}), *order, place=at).withColumn(part, partition_of(at))
    totals = made.groupBy(part).agg(*(F.sum(f"{part}_{n}").alias(n) for n in sums)).collect()
    offsets = _offsets(df.sparkSession, [tuple(r) for r in totals]).withColumnsRenamed({"part": part} | {f"o{i}": f"{part}_o{i}" for i in range(len(sums))})
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumns({n: F.sum(f"{part}_{n}").over(inside) for n in sums}).join(offsets, part)
    return made.withColumns({n: F.col(n) + F.col(f"{part}_o{i}") for i, n in enumerate(sums)}).select(*df.columns, *sums)


def with_previous(df: DataFrame, order: list[Column | str], column: str, name: str = "previous") -> DataFrame:
    """``df`` with ``column`` of the row before in the order of ``order``; null in the first row."""
    at, part = free_name(df, "at"), free_name(df, "part")
    made = placed(df, *order, place=at).withColumn(part, partition_of(at))
    last = {r[part]: r["v"] for r in made.groupBy(part).agg(F.max_by(column, at).alias("v")).collect()}
    parts = sorted(last)
    rows = [(p, last[q]) for q, p in itertools.pairwise(parts)] or [(-1, None)]
    edge = F.broadcast(df.sparkSession.createDataFrame(rows, made.select(F.col(part), F.col(column).alias(f"{part}_v")).schema))
    inside = Window.partitionBy(part).orderBy(at)
    first = F.row_number().over(inside) == 1
    return made.withColumn(name, F.lag(column).over(inside)).withColumn(f"{part}_f", first).join(edge, part, "left").withColumn(name, F.when(F.col(f"{part}_f"), F.col(f"{part}_v")).otherwise(F.col(name))).select(*df.columns, name)
