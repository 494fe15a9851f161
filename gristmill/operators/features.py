"""Derived columns: arithmetic of two columns, transforms of one, equal-width bins."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_double, bin_index, require_columns, safe_ratio

EPSILON = 2.220446049250313e-16

# Suffixes of default names.
COMBINE_NAMES = {"add": "plus", "subtract": "minus", "multiply": "times", "divide": "div"}
TRANSFORM_NAMES = {
    "log": "log",
    "log10": "log10",
    "sqrt": "sqrt",
    "square": "squared",
    "abs": "abs",
    "standardize": "zscore",
    "normalize": "norm",
}


def combine_columns(df: DataFrame, a: str, b: str, op: str, name: str | None = None) -> DataFrame:
    """a op b as double; a division by zero gives NULL."""
    require_columns(df, a, b)
    if op not in COMBINE_NAMES:
        raise ValueError(f"unknown operation: {op}")
    x, y = as_double(df, a), as_double(df, b)
    result = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": safe_ratio(x, y)}[op]
    return df.withColumn(name or f"{a}_{COMBINE_NAMES[op]}_{b}", result)


@dataclass(frozen=True)
class Spread:
    """Learned location and scale of a column."""

    mean: float | None
    std: float | None
    low: float | None
    high: float | None

    def as_dict(self) -> dict:
        return asdict(self)


def learn_spread(df: DataFrame, column: str) -> Spread:
    x = as_double(df, column)
    row = df.agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")
    ).first()
    return Spread(row.mean, row.std, row.low, row.high)


def transform_with(df: DataFrame, column: str, transform: str, spread: Spread | None, name: str | None = None) -> DataFrame:
    if transform not in TRANSFORM_NAMES:
        raise ValueError(f"unknown transform: {transform}")
    return df.withColumn(name or f"{column}_{TRANSFORM_NAMES[transform]}", _transformed(as_double(df, column), transform, spread))


def _transformed(x: Column, transform: str, spread: Spread | None) -> Column:
    if transform == "log":
        return F.when(x > 0, F.ln(x))
    if transform == "log10":
        return F.when(x > 0, F.log10(x))
    if transform == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if transform == "square":
        return x * x
    if transform == "abs":
        return F.abs(x)
    if transform == "standardize":
        if spread.std is None or spread.std < EPSILON:
            raise ValueError("standard deviation is zero or unknown; cannot standardize")
        return (x - F.lit(spread.mean)) / F.lit(spread.std)
    if spread.low is None or spread.high - spread.low < EPSILON:
        raise ValueError("minimum equals maximum or is unknown; cannot normalize")
    return (x - F.lit(spread.low)) / F.lit(spread.high - spread.low)


def transform_column(df: DataFrame, column: str, transform: str, name: str | None = None) -> DataFrame:
    """log, log10, sqrt, square, abs, standardize (sample deviation) or normalize (to 0..1)."""
    require_columns(df, column)
    spread = learn_spread(df, column) if transform in ("standardize", "normalize") else None
    return transform_with(df, column, transform, spread, name)


def bin_width(spread: Spread, bins: int) -> float:
    span = spread.high - spread.low
    return 1.0 if abs(span) < EPSILON else span / bins


def bin_with(df: DataFrame, column: str, bins: int, spread: Spread, name: str | None = None) -> DataFrame:
    """Add the bin number, its edges and a label ``low-high`` to every row."""
    if bins <= 0:
        raise ValueError("number of bins must be greater than zero")
    if spread.low is None:
        raise ValueError(f"column {column} has no values to bin")
    name = name or f"{column}_binned"
    low, width = F.lit(spread.low), F.lit(bin_width(spread, bins))
    place = bin_index(as_double(df, column), low, width, bins)
    start = low + place * width
    label = F.format_string("%.1f-%.1f", start, start + width)
    return df.withColumns(
        {
            name: F.when(place.isNotNull(), label),
            f"{name}_index": place,
            f"{name}_low": start,
            f"{name}_high": start + width,
        }
    )


def bin_column(df: DataFrame, column: str, bins: int, name: str | None = None) -> DataFrame:
    require_columns(df, column)
    if bins <= 0:
        raise ValueError("number of bins must be greater than zero")
    return bin_with(df, column, bins, learn_spread(df, column), name)
