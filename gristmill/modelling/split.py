"""Seeded splits and folds that depend on row keys, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col, hash_number, require_columns
from ..operators.ordering import running_totals, with_row_index

# 13 hex digits fit a double exactly.
FINE_DIGITS = 13
CLASS_LIMIT = 10_000
# Standard deviations around the expected hash.
BRACKET = 8.0


def holdout_flag(key: Column, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for about ``test_size`` of the keys; steps of 1/100 for whole percents, else 1/10000."""
    steps = 100 if abs(test_size * 100 - round(test_size * 100)) < 1e-9 else 10_000
    return hash_number(key, seed) % steps < int(round(test_size * steps))


def split_holdout(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    require_columns(df, key)
    return df.withColumn(name, holdout_flag(col(key), test_size, seed))


def both_sides(df: DataFrame, key: str, seed: int = 42, name: str = "is_test") -> DataFrame:
    """A split of at least two rows without an empty side: one gets the row with the least hash."""
    sides = df.agg(F.count("*").alias("n"), F.count_if(col(name)).alias("test")).first()
    if sides.n < 2 or 0 < sides.test < sides.n:
        return df
    ticket = hash_number(col(key), seed, FINE_DIGITS)
    least = df.agg(F.min(ticket)).first()[0]
    return df.withColumn(name, F.when(ticket == least, sides.test == 0).otherwise(col(name)))


def split_stratified(
    df: DataFrame,
    key: str,
    label: str,
    test_size: float = 0.2,
    seed: int = 42,
    name: str = "is_test",
    bracket: float = BRACKET,
    **options,
) -> DataFrame:
    """The same share of every class goes to the test side: round(test_size * class rows),
    in the order of a hash of the key.

    A class can be most of the table, so its rows are never ranked in one window: the hash
    value at the wanted rank is found per class, and rows are compared with it. Only rows
    whose hash is near the expected value take part in finding it; should they not suffice,
    all rows do.
    """
    require_columns(df, key, label)
    ticket = hash_number(col(key), seed, FINE_DIGITS).cast("double")
    tickets = df.select(col(label).alias("__class"), ticket.alias("__ticket")).where("__class IS NOT NULL")
    sizes = tickets.groupBy("__class").agg(F.count("*").alias("n")).limit(CLASS_LIMIT + 1).collect()
    if len(sizes) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} classes")
    bounds = [(r["__class"], *_expected(r.n, test_size, bracket)) for r in sizes]
    schema = T.StructType(
        [
            T.StructField("__class", df.select(col(label)).schema[0].dataType),
            T.StructField("__wanted", T.LongType()),
            T.StructField("__low", T.DoubleType()),
            T.StructField("__high", T.DoubleType()),
        ]
    )
    placed = tickets.join(F.broadcast(df.sparkSession.createDataFrame(bounds, schema)), "__class")
    under, inside = F.col("__ticket") < F.col("__low"), F.col("__ticket").between(F.col("__low"), F.col("__high"))
    found = placed.groupBy("__class", "__wanted").agg(F.count_if(under).alias("__below"), F.count_if(inside).alias("__inside"))
    rows = found.collect()
    if any(not r["__below"] <= r["__wanted"] <= r["__below"] + r["__inside"] for r in rows):
        return split_stratified(df, key, label, test_size, seed, name, bracket=float("inf"), **options)
    below = df.sparkSession.createDataFrame([(r["__class"], r["__below"]) for r in rows], T.StructType([schema[0], T.StructField("__below", T.LongType())]))
    counts = placed.where(inside).groupBy("__class", "__ticket", "__wanted").agg(F.count("*").alias("__n"))
    last = (
        running_totals(counts, "__ticket", ["__n"], ["__class"], **options)
        .join(F.broadcast(below), "__class")
        .where(F.col("running___n") + F.col("__below") <= F.col("__wanted"))
        .groupBy("__class")
        .agg(F.max("__ticket").alias("__last"))
    )
    joined = df.join(F.broadcast(last), df[label] == last["__class"], "left")
    return joined.withColumn(name, F.coalesce(ticket <= F.col("__last"), F.lit(False))).drop("__class", "__last")


def _expected(rows: int, share: float, bracket: float) -> tuple[int, float, float]:
    """How many rows of a class are wanted, and between which tickets the last of them lies.

    Tickets are hashes, so the one at a given share of the rows is within a few standard
    deviations of that share of their range."""
    top = float(16**FINE_DIGITS)
    slack = bracket * (math.sqrt(share * (1 - share) / rows) + 1 / rows)
    return math.floor(rows * share + 0.5), (share - slack) * top, (share + slack) * top


def fold_number(key: Column, folds: int = 5, seed: int = 42) -> Column:
    return (hash_number(key, f"fold{seed}") % folds).cast("int")


def deal_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Folds dealt in turn along the hashes of the keys, so that none is empty; for tables where a fold by hash is."""
    hashed = df.withColumn("__hash", hash_number(col(key), f"fold{seed}"))
    dealt = with_row_index(hashed, ["__hash", key], "__place")
    return dealt.withColumn(name, (F.col("__place") % folds).cast("int")).drop("__hash", "__place")


def assign_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """A fold from 0 to ``folds - 1`` for each key."""
    require_columns(df, key)
    if folds < 2:
        raise ValueError("need at least 2 folds")
    return df.withColumn(name, fold_number(col(key), folds, seed))
