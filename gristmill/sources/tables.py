"""Reading and writing delimited text and Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, require_columns

# Separators looked for, earlier ones winning ties.
SEPARATORS = (",", "\t", ";", "|")


def detect_separator(header: str) -> str:
    """The candidate that occurs most often in the header line; a comma when none does."""
    return max(SEPARATORS, key=header.count)


def load_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Delimited text with a header row.

    Types come from ``schema``, or from all rows, which Spark reads in one more distributed pass: a
    column has the narrowest type that every value fits, text at last, so no value is lost. With
    a ``schema``, a value that does not fit is read as NULL. Tables without rows or columns are an error.
    """
    if sep is None:
        first = spark.read.text(path).first()
        if first is None:
            raise ValueError(f"{path} is empty")
        sep = detect_separator(first[0])
    options = {"header": True, "sep": sep, "mode": "PERMISSIVE"}
    df = spark.read.csv(path, schema=schema, inferSchema=schema is None, **options)
    if not df.columns:
        raise ValueError(f"{path} has no columns")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return with_default_names(df)


def with_default_names(df: DataFrame) -> DataFrame:
    """Blank headers, which Spark names _c0, _c1, ..., become column_0, column_1, ..."""
    names = [f"column_{i}" if n == f"_c{i}" or not n.strip() else n for i, n in enumerate(df.columns)]
    return df.toDF(*names) if names != df.columns else df


def load_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pick the reader by suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".csv", ".tsv", ".txt"):
        return load_csv(spark, path, **options)
    if suffix in (".parquet", ".pq"):
        return load_parquet(spark, path)
    raise ValueError(f"no reader for {suffix or path}")


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write Parquet or CSV with a header, one file per task."""
    if format == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif format == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no writer for {format}")


def prediction_table(scored: DataFrame, key: str, label_text: str | None = "predicted_label") -> DataFrame:
    """key, prediction (6 places) and, for classes, the decoded label."""
    require_columns(scored, key, "prediction")
    kept = [col(key), F.round("prediction", 6).alias("prediction")]
    if label_text and label_text in scored.columns:
        kept.append(col(label_text))
    return scored.select(*kept)
