"""One long table that tells the story of several trained models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col
from .diagnose import REPORT_LIMITS
from .train import TrainResult

REPORT_SCHEMA = "run string, section string, ord int, key string, value string"
LISTED_FEATURES = 15

# Names of metrics.
METRIC_NAMES = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1 Score",
    "r2": "R²",
    "mae": "MAE",
    "rmse": "RMSE",
}
QUALITY_NAMES = ("strong", "good", "reasonable")


def quality_of(task: str, score: float) -> str:
    for name, limit in zip(QUALITY_NAMES, REPORT_LIMITS[task]):
        if score >= limit:
            return name
    return "weak"


def best_run(results: Sequence[TrainResult]) -> TrainResult:
    """The highest test score; the first of equal ones."""
    return max(results, key=lambda r: r.test_score)


def model_report(results: Sequence[TrainResult], attributions: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (run, section, ord, key, value): comparison, verdict, metrics, train against
    test, cross-validation, leading importances, hyperparameters and contributions.

    ``attributions`` holds top contributions per run, key column first; they are added as a
    table and do not pass through the driver.
    """
    if not results:
        raise ValueError("no results to report")
    spark, rows = results[0].scored.sparkSession, []
    best = best_run(results)
    for r in results:
        if len(results) > 1:
            rows.append((r.run, "comparison", 0, "best", str(r is best).lower()))
        rows.append((r.run, "verdict", 0, "quality", quality_of(r.task, r.test_score)))
        info = [("algorithm", r.algorithm), ("target", r.data.target), ("features", str(len(r.data.features)))]
        info += [("train_rows", str(r.data.train_rows)), ("test_rows", str(r.data.test_rows))]
        if r.data.positive is not None:
            info.append(("positive_class", r.data.classes[r.data.positive]))
        rows += _section(r.run, "data", info)
        rows += _section(r.run, "metrics", [(METRIC_NAMES[k], f"{v:.4f}") for k, v in r.metrics.items()])
        rows += _section(
            r.run,
            "train_vs_test",
            [("train", f"{r.train_score:.4f}"), ("test", f"{r.test_score:.4f}"), ("gap", f"{r.gap:.4f}"), ("band", _band(r.gap))],
        )
        if r.cv:
            folds = [(f"fold {i + 1}", f"{s:.4f}") for i, s in enumerate(r.cv["scores"])]
            rows += _section(r.run, "cross_validation", [*folds, ("mean", f"{r.cv['mean']:.4f}"), ("std", f"{r.cv['std']:.4f}")])
        rows += _section(r.run, "importance", [(f, f"{v:.4f}") for f, v in r.importance[:LISTED_FEATURES]])
        rows += _section(r.run, "hyperparameters", [(k, str(v)) for k, v in r.hyperparams.items()])
        if r.data.imbalance:
            rows.append((r.run, "warnings", 0, "minority_pct", f"{r.data.imbalance['minority_pct']:.2f}"))
        rows += _section(r.run, "leakage", [(f, f"{v:.4f}") for f, v in r.data.leaky])
    report = spark.createDataFrame(rows, REPORT_SCHEMA)
    for run, table in (attributions or {}).items():
        part = table.select(
            F.lit(run).alias("run"),
            F.lit("attributions").alias("section"),
            F.col("rank").cast("int").alias("ord"),
            F.concat(col(table.columns[0]).cast("string"), F.lit(": "), F.col("feature")).alias("key"),
            F.format_string("%+.4f", "contribution").alias("value"),
        )
        report = report.unionByName(part)
    return report


def _section(run: str, section: str, pairs: Sequence[tuple[str, str]]) -> list[tuple]:
    return [(run, section, i, k, v) for i, (k, v) in enumerate(pairs)]


def _band(gap: float) -> str:
    return "noticeable" if gap > 0.1 else "small" if gap > 0.05 else "fine"
