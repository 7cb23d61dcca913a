"""Encoders and scalers that are fitted once, kept with their model, and applied to rows that come later."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

#: Values of a column that an encoder keeps at most.
MOST_VALUES = 1000


class RowEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits how columns become numbers: ``methods`` as JSON (column to label, onehot or target), ``scaled`` columns, ``target``.

    ``label``: the place in string order; ``onehot``: a column for each value but the first; ``target``: the smoothed mean of
    ``target`` (see ``features.target_encode``) as ``{column}_target``. Then ``scaled`` columns, encoded ones too, become
    scores (``method`` standard or robust; empty: by skewness). ``columns`` names the numeric columns that are features as they are.
    """

    methods = Param(Params._dummy(), "methods", "column to method, as JSON", TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "numeric columns", TypeConverters.toListString)
    scaled = Param(Params._dummy(), "scaled", "columns to scale", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target of target encoders", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "standard, robust or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, methods: str = "{}", columns: list[str] | None = None, scaled: list[str] | None = None, target: str = "", method: str = ""):
        super().__init__()
        self._setDefault(methods="{}", columns=[], scaled=[], target="", method="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RowEncoderModel:
        get, state = self.getOrDefault, {"encoders": [], "scalers": {}, "features": list(self.getOrDefault(self.columns))}
        target = get(self.target)
        for c, method in json.loads(get(self.methods)).items():
            if method in ("label", "onehot"):
                values = features.distinct_values(dataset, c, MOST_VALUES)
                state["encoders"].append({"column": c, "method": method, "values": values})
                state["features"] += [c] if method == "label" else [f"{c}_{v}" for v in values[1:]]
            elif method == "target":
                features.distinct_values(dataset, c, MOST_VALUES)  # the map is bounded
                made = features.target_encode(dataset.select(F.col(c).cast("string").alias(c), target), c, target)
                means = {r[c]: r["m"] for r in made.where(F.col(c).isNotNull()).groupBy(c).agg(F.first(f"{c}_target").alias("m")).collect()}
                prior = dataset.where(F.col(c).isNotNull() & F.col(target).isNotNull()).agg(F.avg(F.col(target).cast("double"))).first()[0]
                state["encoders"].append({"column": c, "method": method, "means": means, "prior": prior})
                state["features"].append(f"{c}_target")
            else:
                raise ValueError(f"unknown method {method!r}")
        model = RowEncoderModel(state=json.dumps(state))
        if get(self.scaled):
            state["scalers"], _ = features.scalers(model.transform(dataset), get(self.scaled), get(self.method) or None)
            model = RowEncoderModel(state=json.dumps(state))
        return model


class RowEncoderModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Encodes rows as those of the fit were: a null or unknown value is 0 (the overall mean for a target encoder), a feature whose column is
    missing is 0, and other columns stay. The features are doubles, in a fixed order, behind the other columns."""

    state = Param(Params._dummy(), "state", "what was fitted, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "{}"):
        super().__init__()
        self._setDefault(state="{}")
        self._set(**self._input_kwargs)

    @property
    def feature_names(self) -> list[str]:
        return json.loads(self.getOrDefault(self.state))["features"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault(self.state))
        names, have = state["features"], set(dataset.columns)
        made = {c: F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0)) for c in names if c in have}
        for e in state["encoders"]:
            c = e["column"]
            if c not in have:
                continue
            text = F.col(f"`{c}`").cast("string")
            if e["method"] == "label":
                made[c] = F.greatest(F.coalesce(F.array_position(F.array(*(F.lit(v) for v in e["values"])).cast("array<string>"), text), F.lit(0)) - 1, F.lit(0)).cast("double")
            elif e["method"] == "onehot":
                made |= {f"{c}_{v}": F.coalesce((text == v).cast("double"), F.lit(0.0)) for v in e["values"][1:]}
            else:
                pairs = [F.lit(x) for k, v in e["means"].items() for x in (k, float(v))]
                found = F.try_element_at(F.create_map(*pairs), text) if pairs else F.lit(None).cast("double")
                made[f"{c}_target"] = F.coalesce(found, F.lit(float(e["prior"] or 0.0)))
        out = {c: made.get(c, F.lit(0.0)) for c in names}
        for c, (middle, width) in state["scalers"].items():
            if c in out:
                out[c] = (out[c] - F.lit(middle)) / F.lit(width)
        return dataset.select(*(F.col(f"`{c}`") for c in dataset.columns if c not in out), *(v.alias(c) for c, v in out.items()))
