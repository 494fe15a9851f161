"""Cross-validation of linear regression from sums, in one pass over the rows.

The products of all columns, summed per fold, are enough: those of all other folds give a fold's model, its own
give the model's error on it. A missing value is a zero and a mark of its own, so the same sums serve whatever
median the other folds fill in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, is_text, require_columns
from ..operators.ordering import medians_without
from .prepare import finite
from .split import deal_folds, fold_number


def linear_fold_scores(df: DataFrame, target: str, features: Sequence[str], key: str, folds: int = 5) -> list[dict[str, Any]]:
    """Per fold: fold, rows, r2 and rmse of least squares learned on all other folds.

    Missing and infinite features take the median of the other folds (0 without any); rows without a target are
    left out. r2 is None for a fold of fewer than two rows or without variance. Folds follow from the keys;
    should one be empty, rows are dealt in turn.
    """
    require_columns(df, target, key, *features)
    if folds < 2:
        raise ValueError("need at least 2 folds")
    if not features or any(is_text(df, f) for f in features):
        raise ValueError("linear_fold_scores takes one number column or more")
    rows = df.where(finite(df, target).isNotNull())
    numbers = [finite(df, target).cast("double").alias("y"), *[finite(df, f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]]
    plain = rows.select(fold_number(col(key), folds).alias("__fold"), *numbers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fold_scores(plain, len(features), folds)
    except _EmptyFold as empty:
        if empty.rows < folds:
            raise ValueError(f"{folds} folds need at least {folds} rows") from None
    finally:
        plain.unpersist()
    dealt = deal_folds(rows, key, folds, name="__fold").select("__fold", *numbers).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fold_scores(dealt, len(features), folds)
    finally:
        dealt.unpersist()


class _EmptyFold(Exception):
    def __init__(self, rows: int):
        super().__init__(rows)
        self.rows = rows


def _fold_scores(plain: DataFrame, count: int, folds: int) -> list[dict[str, Any]]:
    names = [f"x{i}" for i in range(count)]
    all_names = ["y", *names]
    totals = plain.groupBy("__fold").agg(F.count("*").alias("n"), *[F.struct(F.sum(c).alias("s"), F.count(c).alias("n")).alias(c) for c in all_names]).collect()
    if len(totals) < folds:
        raise _EmptyFold(sum(r["n"] for r in totals))
    known = {c: sum(r[c].n for r in totals) for c in all_names}
    means = [sum(r[c].s or 0.0 for r in totals) / known[c] if known[c] else 0.0 for c in all_names]
    sums = _moments(plain, folds, means)
    missing = [c for i, c in enumerate(names) if sums[:, 0, 2 + 2 * i].any()]
    out = []
    for k, fills in enumerate(medians_without(plain, missing, "__fold", folds)):
        # In terms of centred columns, a filled value is the column plus the fill times its mark.
        shift = [0.0 if c not in missing else (fills[c] or 0.0) - means[1 + i] for i, c in enumerate(names)]
        out.append({"fold": k, **_score(sums.sum(axis=0) - sums[k], sums[k], shift)})
    return out


def linear_cv(df: DataFrame, target: str, features: Sequence[str], key: str, folds: int = 5) -> DataFrame:
    """linear_fold_scores() as a table: fold, rows, r2, rmse."""
    rows = [(r["fold"], r["rows"], r["r2"], r["rmse"]) for r in linear_fold_scores(df, target, features, key, folds)]
    return df.sparkSession.createDataFrame(rows, "fold int, rows bigint, r2 double, rmse double")


def _moments(plain: DataFrame, folds: int, means: Sequence[float]) -> np.ndarray:
    """Sums of products per fold, of one, each centred column and its mark for missing values, and the target."""
    count = len(means) - 1
    width = 2 * count + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width, width))
        for batch in batches:
            fold = batch.column(0).to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], axis=1) - means
            marks = np.isnan(values[:, 1:])
            design = np.ones((len(fold), width))
            design[:, 1:-1:2], design[:, 2:-1:2] = np.where(marks, 0.0, values[:, 1:]), marks
            design[:, -1] = values[:, 0]
            for k in np.unique(fold):
                own = design[fold == k]
                total[k] += own.T @ own
        cells = np.arange(total.size)
        yield pa.record_batch([pa.array(cells), pa.array(total.ravel())], names=["cell", "v"])

    cells = plain.mapInArrow(products, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(folds * width * width)
    out[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    return out.reshape(folds, width, width)


def _score(others: np.ndarray, own: np.ndarray, shift: Sequence[float]) -> dict[str, Any]:
    count = len(shift)
    # Columns of the model in terms of the summed ones: one, and each feature with its fill.
    mix = np.zeros((2 * count + 2, count + 1))
    mix[0, 0] = 1
    for i, s in enumerate(shift):
        mix[1 + 2 * i, 1 + i], mix[2 + 2 * i, 1 + i] = 1, s
    weights = np.linalg.lstsq(mix.T @ others @ mix, mix.T @ others[:, -1], rcond=1e-12)[0]
    square, cross, products = own[-1, -1], mix.T @ own[:, -1], mix.T @ own @ mix
    rows = int(round(own[0, 0]))
    error = max(float(square - 2 * weights @ cross + weights @ products @ weights), 0.0)
    spread = float(square - own[0, -1] ** 2 / max(rows, 1))
    known = rows > 1 and spread > 1e-12 * max(square, 1e-300)
    return {"rows": rows, "r2": 1 - error / spread if known else None, "rmse": (error / rows) ** 0.5 if rows else None}
