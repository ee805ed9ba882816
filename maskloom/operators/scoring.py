"""Pluggable scorers: model and annotator calls behind a batch interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """``make_scorer`` is called once per task; what it returns turns batches into batches of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for batch in batches:
            yield score(batch)

    return rows.mapInPandas(run, schema)


def asked(rows: DataFrame, answers: DataFrame, key: str, field: str) -> DataFrame:
    """Every asked row with its answer, ``missing`` where none came back."""
    return rows.join(answers.select(key, field), key, "left").withColumn(field, F.coalesce(field, F.lit("missing")))


def retried(call: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = 4, pause: float = 1.0, most: float = 8.0, sleep=time.sleep) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``call``, again after a growing pause (doubled each time, at most ``most`` times ``pause``) when it fails; the last failure is raised."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        for attempt in range(attempts):
            try:
                return call(batch)
            except Exception:
                if attempt + 1 == attempts:
                    raise
                sleep(pause * min(2**attempt, most))
        raise AssertionError("no attempt")

    return run


def in_batches(call: Callable[[pd.DataFrame], pd.DataFrame], size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """``call`` with at most ``size`` rows at a time; a row of a batch that fails is left out, so that it comes back as missing."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for low in range(0, len(batch), size):
            try:
                out.append(call(batch.iloc[low : low + size]))
            except Exception:  # noqa: PERF203 - a failed batch must not take the task with it
                continue
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame()

    return run


def resumed(rows: DataFrame, done: DataFrame, key: str, make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Scores of the rows that ``done`` lacks, for appending to it."""
    return scored(rows.join(done.select(key), key, "left_anti"), make_scorer, schema)


def alignment_warnings(asked_rows: DataFrame, answers: DataFrame, key: str, surface: str) -> DataFrame:
    """``key, warning``: ids without an answer, answered twice, answered unasked, and surfaces that differ from what was asked."""
    per = answers.groupBy(key).agg(F.count("*").alias("n"), F.min(surface).alias("answered"))
    both = asked_rows.select(key, F.col(surface).alias("asked"), F.lit(True).alias("was_asked")).join(per, key, "full")
    warning = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing_answer"), F.when(F.col("n") > 1, "duplicate_answer"), F.when(F.col("was_asked").isNull(), "unknown_id"),
        F.when(F.col("was_asked") & F.col("n").isNotNull() & ~F.col("asked").eqNullSafe(F.col("answered")), "surface_repaired"),
    ))
    return both.select(key, F.explode(warning).alias("warning"))


def complete_windows(generated: DataFrame, judged: DataFrame, window: str) -> DataFrame:
    """``window, n_generated, n_judged, state``: done where as many rows are judged as generated, resume where some are, else start."""
    made, had = generated.groupBy(window).agg(F.count("*").alias("n_generated")), judged.groupBy(window).agg(F.count("*").alias("n_judged"))
    n = F.coalesce("n_judged", F.lit(0))
    state = F.when(n >= F.col("n_generated"), "done").when(n > 0, "resume").otherwise("start")
    return made.join(had, window, "left").select(window, "n_generated", n.alias("n_judged"), state.alias("state"))
