"""Missing values, encoding, and typing of text columns.

Operators that depend on the data come in two halves: ``learn_*`` reads the constants in one
aggregation, and the other half applies constants to any table, also to a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import (
    col,
    is_text,
    looks_numeric,
    named,
    require_columns,
    require_numeric,
    text_to_double,
    type_name,
    without_nan,
)
from .ordering import BUCKET, bucket_by_order, column_medians

ONE_HOT_LIMIT = 1_000


def learn_mean(df: DataFrame, column: str) -> float:
    require_numeric(df, column)
    mean = df.agg(F.avg(without_nan(df, column).cast("double"))).first()[0]
    return _known(mean, f"mean of {column}")


def learn_median(df: DataFrame, column: str, **options) -> float:
    require_numeric(df, column)
    return _known(column_medians(df, [column], **options)[column], f"median of {column}")


def learn_mode(df: DataFrame, column: str):
    """The most frequent value; the smallest of equally frequent ones."""
    top = value_counts(df, column).first()
    return _known(top and top[0], f"mode of {column}")


def _known(value, what: str):
    if value is None:
        raise ValueError(f"cannot compute the {what}: no values")
    return value


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values with their counts, most frequent first, ties by value."""
    require_columns(df, column)
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("value"))


def fill_value(df: DataFrame, column: str, value) -> DataFrame:
    """Replace missing values by a constant. A whole-number column becomes double when the
    constant is not whole."""
    c = without_nan(df, column)
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.IntegralType) and isinstance(value, float):
        return df.withColumn(column, F.coalesce(c.cast("double"), F.lit(value)))
    return df.withColumn(column, F.coalesce(c, F.lit(value).cast(dtype)))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    return fill_value(df, column, learn_mean(df, column))


def fill_median(df: DataFrame, column: str, **options) -> DataFrame:
    return fill_value(df, column, learn_median(df, column, **options))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    return fill_value(df, column, learn_mode(df, column))


def fill_zero(df: DataFrame, column: str) -> DataFrame:
    require_numeric(df, column)
    return fill_value(df, column, 0)


def fill_forward(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), **options
) -> DataFrame:
    """Carry the last known value forward along the row order, over gaps of any length.

    Rows are filled inside ordered buckets; what enters a bucket from the ones before it
    comes from a table with one row per bucket (and key). A key of any size is spread out.
    """
    require_columns(df, column, *order_by, *partition_by)
    cut = bucket_by_order(df, order_by, **options)
    parts = [*partition_by, BUCKET]
    order = named(order_by)
    known = without_nan(df, column)
    inside = Window.partitionBy(*named(parts)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(known, ignorenulls=True).over(inside)
    if len(cut.sizes) == 1:
        return cut.df.withColumn(column, filled).drop(BUCKET)
    at_border = F.max_by(known, F.when(known.isNotNull(), F.struct(*order)))
    keys = [F.coalesce(c.cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(named(partition_by))]
    nulls = [c.isNull().alias(f"__n{i}") for i, c in enumerate(named(partition_by))]
    marks = [f"__k{i}" for i in range(len(keys))] + [f"__n{i}" for i in range(len(nulls))]
    marked = cut.df.select("*", *keys, *nulls)
    borders = marked.groupBy(*marks, BUCKET).agg(at_border.alias("__last"))
    before = Window.partitionBy(*(marks or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(*marks, BUCKET, F.last("__last", ignorenulls=True).over(before).alias("__carry"))
    joined = marked.join(carried if marks else F.broadcast(carried), [*marks, BUCKET])
    inside = Window.partitionBy(*marks, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(known, ignorenulls=True).over(inside), F.col("__carry"))
    return joined.withColumn("__filled", filled).select(
        *[F.col("__filled").alias(column) if c == column else col(c) for c in df.columns]
    )


def learn_categories(df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> list:
    """The sorted distinct values as text; an error when there are more than ``limit``."""
    require_columns(df, column)
    found = df.where(col(column).isNotNull()).select(col(column).cast("string").alias("value")).distinct()
    values = [r.value for r in found.limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"column {column} has more than {limit} distinct values")
    return sorted(values)


def one_hot_with(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Replace a column by one 0/1 column per value; rows without a value stay NULL."""
    require_columns(df, column)
    names = {v: f"{column}_{v}" for v in values}
    clash = [n for n in names.values() if n in df.columns]
    if clash:
        raise ValueError(f"column {clash[0]} already exists")
    text = col(column).cast("string")
    return df.select(
        *[col(c) for c in df.columns if c != column],
        *[(text == F.lit(v)).cast("tinyint").alias(n) for v, n in names.items()],
    )


def one_hot(df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    return one_hot_with(df, column, learn_categories(df, column, limit))


def learn_numeric_text(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> list[str]:
    """The text columns whose non-empty values are numbers in more than ``threshold`` of cases."""
    texts = [c for c in columns if is_text(df, c)]
    if not texts:
        return []
    terms = []
    for i, name in enumerate(texts):
        filled = col(name).isNotNull() & (F.trim(col(name)) != "")
        terms += [
            F.count_if(filled).alias(f"n{i}"),
            F.count_if(filled & looks_numeric(col(name))).alias(f"k{i}"),
        ]
    row = df.agg(*terms).first()
    return [c for i, c in enumerate(texts) if row[f"n{i}"] and row[f"k{i}"] / row[f"n{i}"] > threshold]


def text_columns_to_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text_to_double(col(c)) for c in columns}) if columns else df


def coerce_mostly_numeric(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Turn mostly-numeric text columns into doubles; the others stay as they are."""
    columns = list(columns) if columns is not None else [c for c in df.columns if is_text(df, c)]
    return text_columns_to_double(df, learn_numeric_text(df, columns, threshold))


def type_recommendations(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Text that is mostly numbers should be f64, and numbers that are only 0 and 1, without
    NULL, should be bool. One aggregation over all columns, then one row per advice."""
    bool_like = ("f64", "i64", "i32", "f32")
    terms, advice = [], []
    for i, field in enumerate(df.schema.fields):
        c, dtype = col(field.name), type_name(field.dataType)
        if dtype == "str":
            terms += [F.count(c).alias(f"n{i}"), F.count_if(looks_numeric(F.trim(c))).alias(f"k{i}")]
            share = F.try_divide(F.col(f"k{i}").cast("double"), F.col(f"n{i}").cast("double"))
            fits = F.coalesce(share > threshold, F.lit(False))
            advice.append(_advice(i, field.name, dtype, "f64", "numeric_text", F.round(share, 4), fits))
        elif dtype in bool_like:
            terms += [
                F.count_if(c == 0).alias(f"z{i}"),
                F.count_if(c == 1).alias(f"o{i}"),
                F.count("*").alias(f"n{i}"),
            ]
            zeros, ones, rows = F.col(f"z{i}"), F.col(f"o{i}"), F.col(f"n{i}")
            fits = (zeros > 0) & (ones > 0) & (zeros + ones == rows)
            advice.append(_advice(i, field.name, dtype, "bool", "only_0_and_1", F.lit(1.0), fits))
    if not advice:
        return df.sparkSession.createDataFrame([], ADVICE_SCHEMA)
    rows = df.agg(*terms).select(F.inline(F.array(*advice)))
    return rows.where("fits").select("column", "current_type", "recommended_type", "reason", "share")


ADVICE_SCHEMA = "column string, current_type string, recommended_type string, reason string, share double"


def _advice(i: int, name: str, current: str, wanted: str, reason: str, share: Column, fits: Column) -> Column:
    return F.struct(
        F.lit(i).alias("ord"),
        F.lit(name).alias("column"),
        F.lit(current).alias("current_type"),
        F.lit(wanted).alias("recommended_type"),
        F.lit(reason).alias("reason"),
        share.alias("share"),
        fits.alias("fits"),
    )
