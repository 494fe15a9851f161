"""Column and row shaping: drop, rename, cast, filter, sort, page, summary."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import (
    epoch_seconds,
    NUMBER_PATTERN,
    col,
    is_numeric,
    looks_numeric,
    named,
    require_columns,
    type_name,
)
from .ordering import rows_at

# Accepted names of cast targets.
CAST_TARGETS = {
    "f64": "double",
    "float": "double",
    "i64": "bigint",
    "integer": "bigint",
    "str": "string",
    "string": "string",
    "text": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "category": "string",
}

# Up to this depth a page is one top-k job; deeper pages are found by position.
SHALLOW_PAGE = 10_000


def drop_column(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.drop(column)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, old)
    if new != old and new in df.columns:
        raise ValueError(f"column {new} already exists")
    return df.withColumnRenamed(old, new)


def cast_columns(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Cast several columns in one projection; values that do not convert become NULL."""
    require_columns(df, *targets)
    unknown = [t for t in targets.values() if t not in CAST_TARGETS]
    if unknown:
        raise ValueError(f"unknown type: {', '.join(unknown)}")
    return df.withColumns({name: _converted(df, name, CAST_TARGETS[target]) for name, target in targets.items()})


def cast_column(df: DataFrame, column: str, target: str) -> DataFrame:
    return cast_columns(df, {column: target})


def _converted(df: DataFrame, name: str, target: str) -> Column:
    c, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType) and target in ("double", "bigint"):
        return F.when(looks_numeric(c), c.try_cast(target))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) and target in ("double", "bigint"):
        seconds = epoch_seconds(df, name)
        return seconds if target == "double" else F.floor(seconds)
    if isinstance(dtype, T.NumericType) and target == "boolean":
        return c != 0
    return c.try_cast(target)


def filter_rows(df: DataFrame, column: str, query: str) -> DataFrame:
    """Keep rows equal to a number query, or whose text form contains the query."""
    require_columns(df, column)
    query = query.strip()
    if is_numeric(df, column) and re.fullmatch(NUMBER_PATTERN, query):
        number = float(query)
        whole = isinstance(df.schema[column].dataType, T.IntegralType) and number.is_integer()
        keep = col(column) == F.lit(int(number) if whole else number)
    else:
        keep = col(column).cast("string").contains(query)
    return df.where(keep)


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    return df.where(col(column).isNotNull())


def sort_rows(df: DataFrame, column: str, descending: bool = False, tie_break: Sequence[str] = ()) -> DataFrame:
    """Sort by one column, NULLs first both ways; ``tie_break`` makes the order total."""
    require_columns(df, column, *tie_break)
    lead = col(column).desc_nulls_first() if descending else col(column).asc_nulls_first()
    return df.orderBy(lead, *named(tie_break))


def table_page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order, clamped to the table.

    A shallow page is a top-k. For a deep one only the buckets that hold it are sorted.
    """
    require_columns(df, *order_by)
    offset, limit = max(0, offset), max(0, limit)
    if offset + limit <= SHALLOW_PAGE:
        return df.orderBy(*named(order_by)).offset(offset).limit(limit)
    page = rows_at(df, order_by, lambda n: range(min(offset, n), min(offset + limit, n)), "__at")
    return page.orderBy("__at").drop("__at")


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row per column with its place, name, type and the row count of the table."""
    described = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(f.name).alias("column"),
            F.lit(type_name(f.dataType)).alias("dtype"),
            F.lit(len(df.columns)).alias("columns"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    total = df.agg(F.count("*").alias("rows"))
    return total.select("rows", F.inline(F.array(*described)))


