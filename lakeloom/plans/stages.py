"""Stages run one after another; one that fails is noted, and those that need it are skipped."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import charts, cleaning, features, insights, models, profile, scoring


@dataclasses.dataclass
class Context:
    """What stages hand on: the table as it is, results by stage, and errors."""

    df: DataFrame
    target: str | None = None
    task: str | None = None
    results: dict[str, object] = dataclasses.field(default_factory=dict)
    errors: dict[str, str] = dataclasses.field(default_factory=dict)
    skipped: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Context], object]
    needs: tuple[str, ...] = ()


def run(context: Context, stages: list[Stage]) -> Context:
    """Runs the stages in order; a stage's return value is its result."""
    for stage in stages:
        if any(n in context.errors or n in context.skipped for n in stage.needs):
            context.skipped.append(stage.name)
            continue
        try:
            context.results[stage.name] = stage.run(context)
        except Exception as e:  # later stages that do not need it go on
            context.errors[stage.name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]
    return context


def _profile(c: Context) -> list:
    found = profile.roles(c.df).orderBy("position").collect()  # a row for each column
    c.target = c.target or profile.target([(r["name"], r["role"], r["distinct"] or 0) for r in found])
    row = next(r for r in found if r["name"] == c.target)
    c.task = c.task or profile.task(row["role"], row["distinct"] or 0)
    return found


def _clean(c: Context):
    c.df, report = cleaning.clean(c.df)
    return report


def _features(c: Context) -> list[str]:
    roles = {r["name"]: (r["role"], r["distinct"] or 0) for r in c.results["profile"]}
    for name, (role, distinct) in roles.items():
        if name != c.target and role in ("categorical", "binary") and dict(c.df.dtypes).get(name) == "string":
            if distinct == 2:
                c.df = features.label_encode(c.df, name)
            elif distinct <= 10:
                c.df = features.one_hot(c.df, name)
            else:
                label = profile.kinds(c.df)[c.target] == "numeric"
                c.df = features.target_encode(c.df, name, c.target) if label else c.df
    drop = [n for n, (role, _) in roles.items() if role in ("id", "text", "datetime", "complex", "empty") and n != c.target]
    c.df = c.df.drop(*drop)
    columns = [n for n, k in profile.kinds(c.df).items() if k in ("numeric", "boolean") and n != c.target]
    columns = features.drop_correlated(c.df, columns)
    c.df, c.results["scaling"] = features.scale(c.df, columns)
    return columns


def _train(c: Context) -> dict:
    rows, classes = models.prepare(c.df, c.results["features"], c.target)
    train, test = models.split(rows)
    found, failed = models.train(train, c.task, classes=max(2, len(classes)), folds=3)
    if not found:
        raise RuntimeError(f"no model could be trained: {failed}")
    voted = models.vote(test, [t.model for t in found], c.task, max(2, len(classes)))
    return {"models": found, "failed": failed, "ensemble": models.score(voted, c.task), "test": {t.name: models.score(t.model.transform(test), c.task) for t in found}}


PROFILE = Stage("profile", _profile)
CLEAN = Stage("clean", _clean, ("profile",))
FEATURES = Stage("features", _features, ("profile", "clean"))
TRAIN = Stage("train", _train, ("features",))
ANALYZE = Stage("analyze", lambda c: {"kpis": scoring.kpis(c.df), "takeaways": insights.takeaways(c.df)})
DASHBOARD = Stage("dashboard", lambda c: {s.title: charts.build(c.df, s) for s in insights.suggestions(c.df)})

ANALYSIS = [PROFILE, CLEAN, ANALYZE, DASHBOARD]
LEARNING = [PROFILE, CLEAN, FEATURES, TRAIN]
