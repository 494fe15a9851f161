"""Small tables behind charts: histogram, top values, correlation, scatter, box plot."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import (
    as_double,
    bin_index,
    col,
    is_numeric,
    numeric_columns,
    quoted,
    require_columns,
    require_numeric,
    text_literal,
)
from .cleaning import value_counts
from .features import EPSILON, learn_spread
from .ordering import group_quantiles, rows_at, spread_ranks

WIDE_PAIRS = 15


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width counts of the known values, empty bins included. A constant column gives
    one bin, and a column without values none."""
    require_numeric(df, column)
    if bins <= 0:
        raise ValueError("number of bins must be greater than zero")
    spark = df.sparkSession
    spread = learn_spread(df, column)
    if spread.low is None:
        return spark.createDataFrame([], "ord int, low double, high double, label string, count bigint")
    single = abs(spread.high - spread.low) < EPSILON
    n, width = (1, 1.0) if single else (bins, (spread.high - spread.low) / bins)
    low, step = F.lit(spread.low), F.lit(width)
    value = as_double(df, column)
    counts = df.where(value.isNotNull()).groupBy(bin_index(value, low, step, n).alias("ord")).agg(F.count("*").alias("count"))
    edges = spark.range(n).select(F.col("id").cast("int").alias("ord"))
    start = low + F.col("ord") * step
    return edges.join(F.broadcast(counts), "ord", "left").select(
        "ord",
        start.alias("low"),
        (start if single else start + step).alias("high"),
        F.format_string("%.2f" if single else "%.1f", start).alias("label"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def top_values(df: DataFrame, column: str, limit: int = 15) -> DataFrame:
    """The most frequent values, ties by value, with their share of the listed rows."""
    listed = value_counts(df, column).limit(limit)
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return listed.select(
        col("value").cast("string").alias("label"), "count", (F.col("count") / total * 100.0).alias("percent")
    )


def distribution(df: DataFrame, column: str, bins: int = 20, limit: int = 15) -> DataFrame:
    """A histogram for numbers and the top values for the rest, in one shape."""
    if is_numeric(df, column):
        rows = histogram(df, column, bins).select("ord", "label", "count")
        kind = "histogram"
    else:
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("count"), F.asc("label"))
        rows = top_values(df, column, limit).select((F.row_number().over(order) - 1).alias("ord"), "label", "count")
        kind = "frequency"
    return rows.select(F.lit(column).alias("column"), F.lit(kind).alias("kind"), "ord", "label", "count")


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are known; 0 for fewer than two such rows or no
    variance; never outside -1..1."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    scale = F.stddev_pop(a) * F.stddev_pop(b)
    r = F.coalesce(F.try_divide(F.covar_pop(x, y), scale), F.lit(0.0))
    return F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """One row (col_a, col_b, r) per pair and group, in one pass over the table.

    A few pairs are columns of one aggregation. Many would be too much generated code for
    the JVM to compile: then blocks of rows are multiplied as matrices, and only their sums are
    exchanged. Groups and infinite values go by pair instead: each row is spread over the
    pairs and combined per pair before the exchange.
    """
    numbers = {c: as_double(df, c) for p in pairs for c in p}
    groups = [col(b) for b in by]
    narrow = df.select(*groups, *[x.alias(f"__{c}") for c, x in numbers.items()])
    if len(pairs) <= WIDE_PAIRS:
        terms = [pearson(col(f"__{a}"), col(f"__{b}")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
        rows = [
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
        return narrow.groupBy(*groups).agg(*terms).select(*groups, F.inline(F.array(*rows)))
    if not by:
        names = list(numbers)
        ends = narrow.agg(
            *[F.avg(col(f"__{c}")).alias(f"m{i}") for i, c in enumerate(names)],
            F.coalesce(F.max(F.greatest(*[F.abs(col(f"__{c}")) for c in names])), F.lit(0.0)).alias("top"),
        ).first()
        if ends.top < float("inf"):
            return _pairs_by_blocks(narrow, names, [ends[i] or 0.0 for i in range(len(names))], pairs)
    spread = [
        f"struct({i} AS pair, {quoted(f'__{a}')} AS x, {quoted(f'__{b}')} AS y)" for i, (a, b) in enumerate(pairs)
    ]
    long = narrow.select(*groups, F.inline(F.expr(f"array({', '.join(spread)})")))
    found = long.groupBy(*groups, "pair").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    first, second = (F.expr("array(" + ", ".join(text_literal(p[i]) for p in pairs) + ")") for i in (0, 1))
    names = [F.element_at(n, F.col("pair") + 1).alias(c) for n, c in ((first, "col_a"), (second, "col_b"))]
    return found.select(*groups, *names, "r")


def _pairs_by_blocks(narrow: DataFrame, names: Sequence[str], means: Sequence[float], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson's r of pairs from products of blocks of rows, taken around the means.

    Only the columns that stand second in some pair are multiplied with all others, so many features against
    one target are as many numbers per task as there are features.
    """
    center, width = np.array(means), len(names)
    seconds = sorted({names.index(b) for _, b in pairs})
    few = len(seconds)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, few))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            known = ~np.isnan(x)
            x = np.where(known, x - center, 0.0)
            known = known.astype(float)
            y, there = x[:, seconds], known[:, seconds]
            total += np.stack([known.T @ there, x.T @ there, (x * x).T @ there, x.T @ y, known.T @ y, known.T @ (y * y)])
        columns = [np.repeat(np.arange(width), few), np.tile(seconds, width), *total.reshape(6, -1)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", *"nsqptu"])

    # Plain names: columns are looked up by name on the way to Arrow, and names may hold dots.
    plain = narrow.select(*[col(f"__{c}").alias(f"c{i}") for i, c in enumerate(names)])
    sums = plain.mapInArrow(products, "a long, b long, n double, s double, q double, p double, t double, u double")
    sums = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in "nsqptu"])
    wanted = [(names.index(a), names.index(b), a, b) for a, b in pairs]
    wanted = F.broadcast(narrow.sparkSession.createDataFrame(wanted, "a long, b long, col_a string, col_b string"))
    both = sums.join(wanted, ["a", "b"])
    n = F.col("n")
    varied = (F.col("q") / n - F.pow(F.col("s") / n, F.lit(2))) * (F.col("u") / n - F.pow(F.col("t") / n, F.lit(2)))
    shared = F.col("p") / n - F.col("s") / n * F.col("t") / n
    value = F.when((n > 1) & (varied > 0), F.greatest(F.least(shared / F.sqrt(varied), F.lit(1.0)), F.lit(-1.0)))
    return both.select("col_a", "col_b", F.coalesce(value, F.lit(0.0)).alias("r"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full matrix of the numeric columns in long form, diagonal 1."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        raise ValueError("no numeric columns found")
    spark = df.sparkSession
    diagonal = spark.createDataFrame([(c, c, 1.0) for c in columns], "col_a string, col_b string, r double")
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        return diagonal
    upper = pair_correlations(df, pairs)
    both = upper.select(F.inline(F.array(F.struct("col_a", "col_b", "r"), F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r"))))
    return diagonal.unionByName(both)


def scatter_sample(df: DataFrame, x: str, y: str, order_by: Sequence[str], most: int = 2_000, **options) -> DataFrame:
    """Known pairs in row order, thinned to ``most`` evenly spread positions."""
    require_columns(df, x, y, *order_by)
    pairs = df.select(*[col(c) for c in order_by], as_double(df, x).alias("__x"), as_double(df, y).alias("__y"))
    pairs = pairs.where("__x IS NOT NULL AND __y IS NOT NULL")
    picked = rows_at(pairs, order_by, lambda n: spread_ranks(n, most), "position", **options)
    return picked.select("position", F.col("__x").alias("x"), F.col("__y").alias("y"))


def _group_values(df: DataFrame, number: str, group: str, most: int) -> DataFrame:
    """The values of the largest groups, which are found first; being at most ``most`` names,
    they become a filter."""
    require_columns(df, number, group)
    values = df.select(col(group).cast("string").alias("group"), as_double(df, number).alias("value"))
    values = values.where("`group` IS NOT NULL AND value IS NOT NULL")
    largest = values.groupBy("group").count().orderBy(F.desc("count"), F.asc("group")).limit(most).collect()
    return values.where(F.col("group").isin([r.group for r in largest]))


def _boxes(values: DataFrame, options: dict) -> DataFrame:
    ranges = values.groupBy("group").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = group_quantiles(values, F.col("value"), [0.25, 0.5, 0.75], ["group"], **options)
    return ranges.join(F.broadcast(quartiles), "group").select(
        "group",
        F.col("n").alias("count"),
        "min",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "max",
    )


def box_plot(df: DataFrame, number: str, group: str, most: int = 20, **options) -> DataFrame:
    """Size, range and exact quartiles of the largest groups."""
    return _boxes(_group_values(df, number, group, most), options)


def box_outliers(df: DataFrame, number: str, group: str, most: int = 20, per_group: int = 50, **options) -> DataFrame:
    """The smallest ``per_group`` values outside 1.5 times the quartile range, per group."""
    values = _group_values(df, number, group, most)
    fences = _boxes(values, options).select(
        "group",
        (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    outside = values.join(F.broadcast(fences), "group").where("value < lower OR value > upper")
    ranked = Window.partitionBy("group").orderBy("value")
    return outside.select("group", "value", F.row_number().over(ranked).alias("ord")).where(F.col("ord") <= per_group)


def box_plot_with_outliers(df: DataFrame, number: str, group: str, most: int = 20, per_group: int = 50, **options) -> DataFrame:
    """Box-plot rows with the listed outliers of each group as an ascending array."""
    listed = box_outliers(df, number, group, most, per_group, **options)
    arrays = listed.groupBy("group").agg(F.sort_array(F.collect_list("value")).alias("outliers"))
    empty = F.array().cast("array<double>")
    boxes = box_plot(df, number, group, most, **options)
    return boxes.join(F.broadcast(arrays), "group", "left").withColumn("outliers", F.coalesce("outliers", empty))
