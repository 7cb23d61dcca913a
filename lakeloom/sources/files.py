"""Reading and writing tables, with the checks and names that the operators expect."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as E

FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc"}


def normalize(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores; names that fall together get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = E.normalize_name(c) or "column"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns as null, which is what missing means everywhere else."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c, t in df.dtypes if t in ("float", "double")})


def validate(df: DataFrame) -> DataFrame:
    """The table itself; fails when it has no column or no row."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def read(spark: SparkSession, path: str, schema: T.StructType | str | None = None, names: bool = True, check: bool = True) -> DataFrame:
    """A table by the ending of its path. CSV has a header; without a schema its types are inferred, which reads it twice."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("xlsx", "xls"):
        raise ValueError("spreadsheets are read as one table a sheet: see union_sheets")
    if ending not in FORMATS:
        raise ValueError(f"unknown format {ending!r}")
    reader = spark.read.format(FORMATS[ending])
    if FORMATS[ending] == "csv":
        reader = reader.option("header", True).option("sep", "\t" if ending == "tsv" else ",")
        reader = reader if schema else reader.option("inferSchema", True)
    if ending == "json":
        reader = reader.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).load(path)
    df = nan_to_null(normalize(df) if names else df)
    return validate(df) if check else df


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows that are all null and columns that are all null."""
    rows = df.dropna("all")
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return rows.select(*(F.col(f"`{c}`") for c in df.columns if counts[c]))


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets as one table: all rows with a column ``_sheet`` where two columns or more are common, else the longest sheet."""
    found = {k: d for k, v in sheets.items() if (d := drop_empty(normalize(v))).columns and not d.isEmpty()}
    if not found:
        raise ValueError("no sheet has rows")
    if len(found) == 1:
        return next(iter(found.values()))
    common = set.intersection(*(set(d.columns) for d in found.values()))
    if len(common) < 2:
        return max(found.items(), key=lambda kv: (kv[1].count(), kv[0]))[1]
    out = None
    for name, d in found.items():
        tagged = d.withColumn("_sheet", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def sheet_metadata(sheets: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows, columns and types of each sheet."""
    return {k: {"rows": d.count(), "columns": d.columns, "types": dict(d.dtypes)} for k, d in sheets.items()}


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """The first rows that are found."""
    return df.limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Records added to a folder of JSON lines."""
    df.write.mode("append").json(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """``dataset_id, meta_features, model_scores`` records from a JSON list."""
    return spark.read.schema("dataset_id string, meta_features array<double>, model_scores map<string, double>").option("multiLine", True).json(path)


def write_training(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def chart_json(spec, df: DataFrame, most: int = 10_000) -> str:
    """A chart's request and data (a bounded number of rows) as JSON."""
    rows = [r.asDict(True) for r in df.limit(most).collect()]
    return json.dumps({"spec": dataclasses.asdict(spec), "data": rows}, default=str, sort_keys=True)


def dashboard_html(title: str, kpis: DataFrame, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A page of key figures and small tables."""
    import html

    cards = "".join(f"<div class='card'><b>{html.escape(str(r['label']))}</b> {E.format_number(r['value'])}</div>" for r in kpis.limit(most).collect())
    parts = []
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(most).collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{cards}{''.join(parts)}</body></html>"


def candidates(catalogue: DataFrame, seen: DataFrame, task: str = "classification") -> DataFrame:
    """Data sets of a catalogue (dataset_id, rows, features, classes, missing) to try: of fair size, complete enough, not seen yet; smallest first."""
    fits = catalogue.where("rows between 100 and 50000 and features between 2 and 500 and missing < 0.3")
    fits = fits.where("classes >= 2") if task == "classification" else fits.where("classes <= 1 or classes is null")
    return fits.join(seen.select("dataset_id").distinct(), "dataset_id", "left_anti").orderBy("rows", "dataset_id")


def capped(df: DataFrame, most: int, key: str, by: str | None = None) -> DataFrame:
    """At most about ``most`` rows, chosen by the hash of a key; with ``by``, the same share of each class."""
    share = min(1.0, most / max(1, df.count()))
    salt = [F.col(key)] + ([F.col(by)] if by else [])
    return df.where(F.pmod(F.xxhash64(*salt), F.lit(1_000_000)) < int(share * 1_000_000))
