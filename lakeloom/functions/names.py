"""Column names as people write them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How alike a name has to be: twice the characters in matching blocks over all characters of both.
LEAST_ALIKE = 0.8


def _plain(name: str) -> str:
    return name.lower().replace(" ", "_").replace("-", "_")


def best_name(name: str | None, columns: list[str], least: float = LEAST_ALIKE) -> str | None:
    """The column that a name means: the same, the same but for case, then for blanks and hyphens, then the most alike (the first of equals)."""
    if not name or name in columns:
        return name or None
    for same in (str.lower, _plain):
        found = next((c for c in columns if same(c) == same(name)), None)
        if found is not None:
            return found
    ratios = [SequenceMatcher(None, _plain(name), c.lower().replace(" ", "_")).ratio() for c in columns]
    best = max(ratios, default=0.0)
    return columns[ratios.index(best)] if best >= least else None


def resolved(name: Column, columns: list[str], least: float = LEAST_ALIKE) -> Column:
    """``best_name`` of a column of names, null where none is alike enough; the rules that need no blocks are plain expressions.

    Only names that equal no column in any of the plain ways go through Python, in Arrow batches, each distinct one of a batch once.
    """

    @F.pandas_udf("string")
    def alike(names: pd.Series) -> pd.Series:
        return names.map({n: best_name(n, columns, least) for n in names.dropna().unique()})

    plain = lambda c: F.regexp_replace(F.lower(c), "[ -]", "_")
    out = F.when(name == "", F.lit(None).cast("string")).when(name.isin(*columns), name)
    for same, of in ((F.lower, str.lower), (plain, _plain)):
        for c in columns:
            out = out.when(same(name) == of(c), F.lit(c))
    return out.otherwise(alike(name))
