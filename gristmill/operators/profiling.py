"""Column profiles, hints, and before/after previews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, is_numeric, is_scalar, require_columns, type_name, without_nan


# Text longer than a digest.
LONG_TEXT = 64


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: counts, distinct values (NULL is one of them) and number moments.

    Moments of all columns come from one aggregation. Exact distinct counts come from one
    grouping of (column, value) pairs, which combines before the exchange, so a value that
    fills a third of the table costs nothing extra. ``approx=True`` estimates them in the
    first aggregation instead and saves the exchange.
    """
    columns = list(columns) if columns is not None else df.columns
    require_columns(df, *columns)
    terms, rows = [F.count("*").alias("rows")], []
    for i, name in enumerate(columns):
        c = without_nan(df, name)
        terms.append(F.count(c).alias(f"n{i}"))
        if is_numeric(df, name):
            x = c.cast("double")
            terms += [
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
            ]
        if approx and is_scalar(df, name):
            terms.append(F.approx_count_distinct(c).alias(f"d{i}"))
        rows.append(_profile_row(df, i, name, approx))
    wide = df.agg(*terms)
    profile = wide.select(F.inline(F.array(*rows)))
    if approx:
        return profile
    distinct = _distinct_counts(df, [c for c in columns if is_scalar(df, c)])
    return profile.drop("unique_count").join(F.broadcast(distinct), "name", "left").select(*PROFILE_COLUMNS)


PROFILE_COLUMNS = [
    "ord",
    "name",
    "dtype",
    "count",
    "null_count",
    "null_percent",
    "unique_count",
    "mean",
    "std",
    "min",
    "max",
]


def _profile_row(df: DataFrame, i: int, name: str, approx: bool) -> Column:
    total, known = F.col("rows"), F.col(f"n{i}")
    missing = total - known
    numeric = is_numeric(df, name)
    nothing = F.lit(None).cast("double")
    percent = F.when(total > 0, missing / total * 100.0).otherwise(0.0)
    unique = F.lit(None).cast("bigint")
    if approx and is_scalar(df, name):
        unique = F.col(f"d{i}") + F.when(missing > 0, 1).otherwise(0)
    return F.struct(
        F.lit(i).alias("ord"),
        F.lit(name).alias("name"),
        F.lit(type_name(df.schema[name].dataType)).alias("dtype"),
        total.alias("count"),
        missing.alias("null_count"),
        percent.alias("null_percent"),
        unique.cast("bigint").alias("unique_count"),
        (F.col(f"mean{i}") if numeric else nothing).alias("mean"),
        (F.col(f"std{i}") if numeric else nothing).alias("std"),
        (four_places(F.col(f"min{i}")) if numeric else nothing.cast("string")).alias("min"),
        (four_places(F.col(f"max{i}")) if numeric else nothing.cast("string")).alias("max"),
    )


def four_places(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value))


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return df.sparkSession.createDataFrame([], "name string, unique_count bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), identity(df, c).alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.name", "p.value").groupBy("name", "value").agg(F.lit(1))
    return values.groupBy("name").agg(F.count("*").alias("unique_count"))


def identity(df: DataFrame, name: str) -> Column:
    """Text that is equal exactly where the values are; 0.0 and -0.0 are one value.

    Long text is grouped by its digest, so that whole documents do not travel."""
    c = without_nan(df, name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(df.schema[name].dataType)
    return c.cast("string")


def profile_column(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    return profile_columns(df, [column], approx)


def column_hints(profile: DataFrame) -> DataFrame:
    """Advice per column of a profile: one row per hint, with the suggested action if any."""
    missing, unique, dtype = F.col("null_percent"), F.col("unique_count"), F.col("dtype")
    text = dtype == "str"
    fill = F.when(F.col("mean").isNotNull(), "fill_mean").otherwise("fill_mode")
    hints = [
        _hint("high_missing", (F.col("null_count") > 0) & (missing >= 40), fill),
        _hint("moderate_missing", (F.col("null_count") > 0) & (missing >= 10) & (missing < 40)),
        _hint("binary", (unique == 2) & (dtype != "bool"), F.lit("cast_bool")),
        _hint("one_hot", text & unique.between(3, 10), F.lit("one_hot")),
        _hint("high_cardinality", text & (unique > 50) & (unique > F.col("count") * 0.5)),
        _hint("constant", unique <= 1, F.lit("drop_column")),
    ]
    return (
        profile.select("name", F.explode(F.array(*hints)).alias("h"))
        .where("h.fits")
        .select("name", F.col("h.hint").alias("hint"), F.col("h.action").alias("suggested_action"))
    )


def _hint(name: str, fits: Column, action: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("hint"),
        F.coalesce(fits, F.lit(False)).alias("fits"),
        (F.lit(None).cast("string") if action is None else action).alias("action"),
    )


def preview(before: DataFrame, change: Callable[[DataFrame], DataFrame], column: str, sample_order: Sequence[str] | None = None, samples: int = 10) -> DataFrame:
    """The profile of one column before and after a change, plus the first values of the
    order when one is given. Neither table is modified."""
    after = change(before)
    parts = []
    for phase, df in (("before", before), ("after", after)):
        row = profile_column(df, column).withColumn("phase", F.lit(phase))
        if sample_order:
            picked = df.orderBy(*[col(c) for c in sample_order]).limit(samples)
            entries = F.collect_list(F.struct(*[col(c) for c in sample_order], col(column).cast("string").alias("__value")))
            shown = picked.agg(F.transform(F.sort_array(entries), lambda e: e["__value"]).alias("samples"))
            row = row.withColumn("samples", shown.scalar())
        parts.append(row)
    return parts[0].unionByName(parts[1]).drop("ord")
