"""Results kept by the content of their table: the same rows in any order find them again, one changed cell does not."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _cell(c: str) -> Column:
    """A cell as text that no other content gives: its length in front, and a mark for null."""
    text = F.col(f"`{c}`").cast("string")
    return F.when(text.isNull(), "n").otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def fingerprint(df: DataFrame) -> DataFrame:
    """``rows, low, high``: the number of rows, and two sums over the rows of parts of each row's SHA-256.

    Rows are hashed with their columns in the order of their names and sums do not depend on the order of rows, so the content
    counts, with repeats; types do not, other than by how values are written. One pass, and one row is shuffled for each task. Columns
    without a text (maps, structs, arrays) are hashed as JSON; an empty table has sums of 0.
    """
    plain = {c: t for c, t in df.dtypes}
    nested = [c for c, t in plain.items() if t.startswith(("map", "struct", "array"))]
    df = df.withColumns({c: F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) for c in nested}) if nested else df
    row = F.sha2(F.concat(F.lit(""), *(_cell(c) for c in sorted(plain))), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), part(1).alias("low"), part(16).alias("high"))


def key(df: DataFrame, request: dict) -> str:
    """The name of a result: a digest of the table's columns and content, and of the request with its keys in order."""
    made = fingerprint(df).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), str(made["rows"]), str(made["low"]), str(made["high"]), request], sort_keys=True, default=str).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place))


def cached(df: DataFrame, request: dict, folder: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The result of ``compute(df)`` from ``folder``, and whether it was there already.

    ``request`` has to name everything else that the result depends on. A result counts once its writer has marked it
    complete; one that was broken off is written anew.
    """
    spark, path = df.sparkSession, f"{folder}/{key(df, request)}"
    hit = _exists(spark, f"{path}/_SUCCESS")
    if not hit:
        compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit
