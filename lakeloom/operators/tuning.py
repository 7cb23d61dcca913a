"""A search of a model's settings within a time: its jobs carry a tag, and those that still run when the time is over are cancelled."""

from __future__ import annotations

import collections
import dataclasses
import itertools
import random
import threading
import time
import uuid

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models


@dataclasses.dataclass
class Searched:
    """The model of the best setting, fitted on all rows; ``score`` is None where no setting was finished in time."""

    model: object
    score: float | None
    setting: dict
    tried: list[tuple[dict, float]]
    failed: list[tuple[dict, str]]
    stopped: bool


def settings(name: str, most: int | None = None, seed: int = 42) -> list[dict]:
    """The settings in the order of trial: the estimator as it is, then its grid in a seeded order; ``most`` of them at most."""
    space = models.SPACES.get(name, {})
    grid = [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())] if space else []
    random.Random(seed).shuffle(grid)
    return [{}, *grid][:most]


def search_within(rows: DataFrame, name: str, task: str, seconds: float, classes: int = 2, folds: int = 3, most: int | None = None, seed: int = 42, parallelism: int = 2) -> Searched:
    """The best of the settings that are judged on all folds within ``seconds``, by its mean score; ties go to the one tried first.

    ``rows`` has ``row_id, label, features``. Settings are tried ``parallelism`` at a time. When the time is over, their jobs
    are cancelled and what is not judged on every fold does not count; where nothing was, the estimator as it is stands.
    The fit of the best setting on all rows comes after, so the whole takes the time and one fit. A setting whose fit fails is
    listed and leaves the others; a fold without rows does not count.
    """
    context = rows.sparkSession.sparkContext
    base = models.estimators(task, classes)[name]
    configured = lambda setting: base.copy({base.getParam(p): v for p, v in setting.items()})
    tag, over = f"search-{uuid.uuid4().hex}", threading.Event()
    waiting = collections.deque(enumerate(settings(name, most, seed)))
    scores: dict[int, tuple[dict, float]] = {}
    failed: list[tuple[dict, str]] = []
    folded = models.with_folds(rows, folds).cache()

    def judge(setting: dict) -> float:
        found = []
        for i in range(folds):
            train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
            if not test.isEmpty() and not train.isEmpty():
                found.append(models.score(configured(setting).fit(train).transform(test), task))
        return float(np.mean(found)) if found else float("-inf")

    def work() -> None:
        context.addJobTag(tag)
        try:
            while not over.is_set() and waiting:
                try:
                    n, setting = waiting.popleft()
                except IndexError:  # another thread took the last one
                    return
                try:
                    value = judge(setting)
                except Exception as e:
                    if not over.is_set():  # else its jobs were cancelled
                        failed.append((setting, str(e).splitlines()[0][:200]))
                    continue
                if not over.is_set():
                    scores[n] = (setting, value)
        finally:
            context.removeJobTag(tag)

    end = time.monotonic() + seconds
    threads = [InheritableThread(target=work) for _ in range(max(1, parallelism))]
    try:
        for t in threads:
            t.start()
        for t in threads:
            t.join(max(0.0, end - time.monotonic()))
    finally:
        stopped = any(t.is_alive() for t in threads)
        over.set()
        while any(t.is_alive() for t in threads):  # a thread between two jobs starts one more
            context.cancelJobsWithTag(tag)
            time.sleep(0.05)
        folded.unpersist()
    best = max(scores, key=lambda n: (scores[n][1], -n), default=None)
    setting, value = scores[best] if best is not None else ({}, None)
    return Searched(configured(setting).fit(rows), value, setting, [scores[n] for n in sorted(scores)], failed, stopped)
