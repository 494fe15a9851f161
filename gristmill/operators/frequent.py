"""Most frequent values of columns with any number of values, without exchanging them all.

Every task keeps a Misra-Gries summary: counts that are too low by at most the task's error. Their
sums bound the count of each value from both sides, so the values that can be among the most frequent
are known, and a second pass counts just these. Where the bounds prove nothing, as in a column of
nearly unique values, all values are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, is_scalar, require_columns
from ..session import cut_lineage
from .cleaning import value_counts

COUNTERS = 4_096
# Candidates up to this number are broadcast for the second pass.
MOST_CANDIDATES = 100_000
# Longer text is known to a summary by its digest.
LONG_TEXT = 64


def most_frequent(df: DataFrame, column: str, limit: int = 15, counters: int = COUNTERS) -> DataFrame:
    """The `limit` most frequent non-NULL values with exact counts, most frequent first, ties by value.

    The same rows as the first ones of ``value_counts``, for any table: a summary decides only which
    values are counted. An empty column gives no rows; NaN is a value, 0.0 and -0.0 are one.
    """
    require_columns(df, column)
    if limit < 1 or counters < 1:
        raise ValueError("limit and counters must be at least 1")
    found = candidates(df, column, limit, counters) if is_scalar(df, column) else None
    if found is not None:
        df = df.select(col(column), _key(df, column).alias("__key")).join(F.broadcast(found), F.col("__key") == F.col("__candidate"), "left_semi")
    return value_counts(df, column).limit(limit)


def candidates(df: DataFrame, column: str, limit: int, counters: int = COUNTERS) -> DataFrame | None:
    """Keys of all values that can be among the most frequent; None if summaries cannot tell.

    A value's count lies between its sum `low` and `low` plus the error of all tasks. `limit` values reach the
    least `low` of the first ones, so a value that cannot reach it is out, ties included.
    """
    keys = df.where(col(column).isNotNull()).select(_key(df, column).alias("value"))
    summed = keys.mapInArrow(_summaries(counters), "value string, low long").groupBy("value").agg(F.sum("low").alias("low"))
    summed = cut_lineage(summed)
    error = summed.where("value IS NULL").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    lows = summed.where("value IS NOT NULL")
    first = lows.orderBy(F.desc("low")).limit(limit).agg(F.count("*").alias("n"), F.min("low").alias("low")).first()
    if error and (first["n"] < limit or first["low"] <= error):
        return None
    reached = first["low"] if first["n"] == limit else 0
    possible = lows.where(F.col("low") + F.lit(error) >= F.lit(reached)).select(F.col("value").alias("__candidate"))
    return possible if possible.count() <= MOST_CANDIDATES else None


def _key(df: DataFrame, name: str) -> Column:
    """Text that is equal where the values are."""
    c, dtype = col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.when(F.length(c) > LONG_TEXT, F.sha2(c, 256)).otherwise(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0).cast(dtype)
    if isinstance(dtype, T.BinaryType):
        return F.sha2(c, 256)
    return c.cast("string")


def _summaries(counters: int):
    """Per task: values with counts that are at most `error` too low, and the error in a row without a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        error = 0
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for value, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                held[value] = held.get(value, 0) + n
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {value: n - cut for value, n in held.items() if n > cut}
                error += cut
        values, lows = [*held, None], [*held.values(), error]
        yield pa.record_batch([pa.array(values, pa.string()), pa.array(lows, pa.int64())], names=["value", "low"])

    return run
