"""Judging trained models from a run table.

One row per run: ``run``, ``task``, ``train_score``, ``test_score`` (accuracy or R squared)
and, where known, ``leaky_features``, ``minority_pct``, ``has_cv``, ``features``,
``low_features`` and ``silhouette``. Rows are judged on their own, so any number of runs
is one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col, named, require_columns

# Lower bounds per label. The report includes the bound; on screen the upper
# bound must be exceeded and the lower one reached.
REPORT_LIMITS = {"classification": (0.95, 0.85, 0.7), "regression": (0.85, 0.6, 0.3)}
SCREEN_LIMITS = {"classification": (0.9, 0.7), "regression": (0.8, 0.5)}

# Bounds of the gap between training and test score.
GAP_MILD, GAP_MODERATE, GAP_SEVERE = 0.10, 0.15, 0.25
GAP_SMALL = 0.05

LOW_IMPORTANCE = 0.01
MOST_STEPS = 5


def quality_label(runs: DataFrame, scheme: str = "report", name: str = "quality") -> DataFrame:
    require_columns(runs, "task", "test_score")
    score = F.col("test_score")
    if scheme == "report":
        label = F.lit("neutral")
        for task, (strong, good, fair) in REPORT_LIMITS.items():
            band = F.when(score >= strong, "strong").when(score >= good, "good").when(score >= fair, "reasonable").otherwise("weak")
            label = F.when(F.col("task") == task, band).otherwise(label)
    elif scheme == "screen":
        label = F.lit("neutral")
        for task, (strong, fair) in SCREEN_LIMITS.items():
            band = F.when(score > strong, "strong").when(score >= fair, "reasonable").otherwise("weak")
            label = F.when(F.col("task") == task, band).otherwise(label)
    else:
        raise ValueError(f"unknown scheme: {scheme}")
    return runs.withColumn(name, label)


def overfit_severity(runs: DataFrame) -> DataFrame:
    """The gap, its severity, and the band the report speaks of."""
    require_columns(runs, "train_score", "test_score")
    gap = F.round(F.col("train_score") - F.col("test_score"), 6)
    severity = F.when(gap >= GAP_SEVERE, "severe").when(gap >= GAP_MODERATE, "moderate").when(gap >= GAP_MILD, "mild").otherwise("none")
    band = F.when(gap > GAP_MILD, "noticeable").when(gap > GAP_SMALL, "small").otherwise("fine")
    return runs.withColumns({"gap": gap, "severity": severity, "report_band": band})


def next_steps(runs: DataFrame) -> DataFrame:
    """Up to five suggestions per run, in a fixed order, each with its priority."""
    require_columns(runs, "run", "task", "train_score", "test_score")
    is_class, is_reg = F.col("task") == "classification", F.col("task") == "regression"
    score, gap = F.col("test_score"), F.round(F.col("train_score") - F.col("test_score"), 6)

    def known(name: str) -> Column:
        return F.col(name) if name in runs.columns else F.lit(None)

    advice = [
        ("remove_leaky_features", "high", known("leaky_features") > 0),
        ("collect_minority_rows", "high", known("minority_pct") < 10),
        ("raise_accuracy", "high", is_class & (score < 0.7)),
        ("raise_r2", "high", is_reg & (score < 0.5)),
        ("cross_validate", "medium", ~known("has_cv").cast("boolean")),
        ("drop_low_importance", "medium", (known("features") > 5) & (known("low_features") > 0)),
        ("confirm_small_gap", "low", (gap > GAP_SMALL) & (gap < GAP_MILD)),
        ("separate_clusters", "medium", (F.col("task") == "clustering") & (known("silhouette") < 0.25)),
        ("double_check_leakage", "low", is_class & (score >= 0.95)),
    ]
    entries = [
        F.struct(F.lit(step).alias("step"), F.lit(priority).alias("priority"), F.coalesce(fits, F.lit(False)).alias("fits"))
        for step, priority, fits in advice
    ]
    chosen = F.slice(F.filter(F.array(*entries), lambda a: a["fits"]), 1, MOST_STEPS)
    return runs.select("run", F.posexplode(chosen).alias("ord", "a")).select("run", "ord", F.col("a.step").alias("step"), F.col("a.priority").alias("priority"))


def best_model(runs: DataFrame, by: Sequence[str] = ("task",), order: str = "run") -> DataFrame:
    """The run with the highest test score per group; the earlier of equal ones."""
    require_columns(runs, "run", "test_score", order, *by)
    place = F.struct((-F.col("test_score")).alias("s"), col(order).alias("o"))
    scored = runs.where(F.col("test_score").isNotNull())
    return scored.groupBy(*named(by)).agg(F.min_by("run", place).alias("run"), F.max("test_score").alias("test_score"))


def shared_importance(importances: DataFrame, by: Sequence[str] = (), top: int = 10) -> DataFrame:
    """Features that matter to at least two runs: their importance relative to the run's
    strongest feature, among its ``top``, averaged over all runs."""
    require_columns(importances, "run", "feature", "importance", *by)
    in_run = Window.partitionBy(*named(by), "run").orderBy(F.desc("importance"), "feature")
    ranked = importances.select(
        *named(by),
        "run",
        "feature",
        F.coalesce(F.try_divide("importance", F.first("importance").over(in_run)), F.lit(0.0)).alias("relative"),
        F.row_number().over(in_run).alias("place"),
    ).where(F.col("place") <= top)
    runs = ranked.groupBy(*named(by)).agg(F.count_distinct("run").alias("runs"))
    sums = ranked.groupBy(*named(by), "feature").agg(F.sum("relative").alias("total"), F.count("*").alias("agreed_by"))
    joined = sums.join(runs, list(by)) if by else sums.withColumn("runs", runs.scalar())
    shared = joined.where("agreed_by >= 2").withColumn("avg_importance", F.col("total") / F.col("runs"))
    across = Window.partitionBy(*(named(by) or [F.lit(0)])).orderBy(F.desc("avg_importance"), "feature")
    return shared.select(*named(by), "feature", "avg_importance", "agreed_by", F.row_number().over(across).alias("ord")).where(F.col("ord") <= top)


def metric_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("run",), metrics: Sequence[str] = ("accuracy",)) -> DataFrame:
    """Old and new value per metric; better is higher, but lower for error metrics."""
    require_columns(old, *keys, *metrics)
    require_columns(new, *keys, *metrics)

    def long(df: DataFrame, name: str) -> DataFrame:
        values = F.array(*[F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("v")) for m in metrics])
        return df.select(*named(keys), F.explode(values).alias("e")).select(*named(keys), "e.metric", F.col("e.v").alias(name))

    change = F.round(F.col("new_value") - F.col("old_value"), 6)
    gain = F.when(F.col("metric").isin("mae", "rmse"), -change).otherwise(change)
    return long(old, "old_value").join(long(new, "new_value"), [*keys, "metric"]).select(
        *named(keys), "metric", "old_value", "new_value", change.alias("change"), (gain > 0).alias("better")
    )
