"""Order-dependent building blocks that never sort everything in one task.

A table is cut into ordered buckets: all rows of a lower bucket come before all rows of a
higher one. Windows then run per bucket, and one small table of per-bucket totals carries
positions and sums across the borders.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import (
    as_double,
    col,
    double_array,
    is_scalar,
    is_text,
    long_array,
    named,
    require_columns,
)
from ..session import cut_lineage

BUCKET = "__bucket"
SORT_KEY = "__sort_key"

# A bucket of this many rows is sorted by one task without trouble.
TASK_ROWS = 200_000
# Above this, a bucket that is also far larger than the others counts as hot.
HOT_ROWS = 5_000_000
# Tables of at most this many groups, with a few numbers for each, are handed to all tasks.
FEW_GROUPS = 10_000
# More percentiles than this are grouped by column name, not columns of one aggregation.
WIDE_COLUMNS = 15


@dataclass(frozen=True)
class Bucketed:
    """A table with a bucket column, and the number of rows of each bucket."""

    df: DataFrame
    sizes: list[int]

    @property
    def rows(self) -> int:
        return sum(self.sizes)

    @property
    def starts(self) -> list[int]:
        return [0, *itertools.accumulate(self.sizes)][:-1]

    def start(self) -> Column:
        return F.element_at(long_array(self.starts), F.col(BUCKET) + 1)


def match_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns where NULL is a group like any other; the columns of `by` come from the left."""
    renamed = {name: f"__match_{i}" for i, name in enumerate(by)}
    right = right.select(*[col(c).alias(renamed.get(c, c)) for c in right.columns])
    same = [col(name).eqNullSafe(F.col(other)) for name, other in renamed.items()]
    return left.join(right, same, how).drop(*renamed.values())


def bucket_by_order(
    df: DataFrame,
    order_by: Sequence[str],
    buckets: int | None = None,
    task_rows: int = TASK_ROWS,
    hot_rows: int = HOT_ROWS,
) -> Bucketed:
    """Cut the table into ordered buckets of similar size.

    The bucket is a fixed function of the first order column, taken from its approximate
    quantiles, so nothing is shuffled here. Where that column has no numeric form, or one of
    its values holds too many rows, the order columns alone go through Spark's range exchange
    and are written down once; a row's bucket then follows from comparing it with their borders.
    """
    require_columns(df, *order_by)
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lead = order_by[0]
    if is_scalar(df, lead) and not is_text(df, lead):
        keyed = df.withColumn(SORT_KEY, _sort_key(df, lead))
        steps = [i / buckets for i in range(1, buckets)]
        summary = keyed.agg(
            F.count("*").alias("n"),
            F.percentile_approx(SORT_KEY, steps, max(10_000, 10 * buckets)).alias("cuts"),
        ).first()
        if summary.n <= task_rows:
            return Bucketed(df.withColumn(BUCKET, F.lit(0)), [summary.n])
        cuts = sorted({c for c in summary.cuts if float("-inf") < c < float("inf")})
        splits = [float("-inf"), *cuts, float("inf")]
        if len(splits) > 2:
            placed = (
                Bucketizer(splits=splits, inputCol=SORT_KEY, outputCol="__place", handleInvalid="keep")
                .transform(keyed)
                .withColumn(BUCKET, F.col("__place").cast("int"))
                .drop(SORT_KEY, "__place")
            )
            sizes = _bucket_sizes(placed)
            if max(sizes) <= max(hot_rows, 4 * summary.n // buckets):
                return Bucketed(placed, sizes)
    keys = df.select(*named(order_by))
    rows = keys.count()
    if rows <= task_rows:
        return Bucketed(df.withColumn(BUCKET, F.lit(0)), [rows])
    ranged = keys.repartitionByRange(buckets, *named(order_by)).withColumn(BUCKET, F.spark_partition_id())
    # The partition of a row is taken from the written copy, which another run of the exchange might not repeat.
    key = F.struct(*named(order_by))
    tops = cut_lineage(cut_lineage(ranged).groupBy(BUCKET).agg(F.max(key).alias("__top"), F.count("*").alias("n")))
    sizes = [r.n for r in tops.orderBy(BUCKET).select("n").collect()]
    if len(sizes) < 2:
        return Bucketed(df.withColumn(BUCKET, F.lit(0)), sizes or [0])
    borders = tops.agg(F.array_sort(F.collect_list("__top"))).scalar()
    placed = df.withColumn("__borders", borders)
    placed = placed.withColumn(BUCKET, _borders_below(F.col("__borders"), len(sizes), key)).drop("__borders")
    return Bucketed(placed, sizes)


def _borders_below(borders: Column, most: int, key: Column) -> Column:
    """How many of at most ``most`` sorted borders are below the key, in as many comparisons as that number has bits."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(borders, at + step - 1) < key, at + step).otherwise(at))


def _sort_key(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the column's ascending order, NULL first and NaN last."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    return F.coalesce(as_double(df, name), F.lit(float("-inf")))


def _bucket_sizes(df: DataFrame) -> list[int]:
    counts = {r[BUCKET]: r["count"] for r in df.groupBy(BUCKET).count().collect()}
    return [counts.get(i, 0) for i in range(max(counts, default=0) + 1)]


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index", **options) -> DataFrame:
    """Number all rows from 0 along ``order_by``, which should identify each row."""
    cut = bucket_by_order(df, order_by, **options)
    inside = Window.partitionBy(BUCKET).orderBy(*named(order_by))
    index = cut.start() + F.row_number().over(inside) - 1
    return cut.df.withColumn(name, index).drop(BUCKET)


def rows_at(
    df: DataFrame,
    order_by: Sequence[str],
    ranks: Callable[[int], Sequence[int]],
    name: str = "row_index",
    **options,
) -> DataFrame:
    """The rows at the given positions of the order; ``ranks`` gets the row count.

    The positions must be few. Buckets without a wanted position are filtered out before
    the exchange, so a page or a sample moves only a small part of the table.
    """
    cut = bucket_by_order(df, order_by, **options)
    wanted = sorted(set(ranks(cut.rows)))
    touched, at = [], 0
    for bucket, (start, size) in enumerate(zip(cut.starts, cut.sizes)):
        while at < len(wanted) and wanted[at] < start:
            at += 1
        if at < len(wanted) and wanted[at] < start + size:
            touched.append(bucket)
    rows = cut.df
    if len(touched) < len(cut.sizes):
        rows = rows.where(F.col(BUCKET).isin(touched))
    inside = Window.partitionBy(BUCKET).orderBy(*named(order_by))
    indexed = rows.withColumn(name, cut.start() + F.row_number().over(inside) - 1).drop(BUCKET)
    if wanted == list(range(wanted[0], wanted[-1] + 1)) if wanted else False:
        return indexed.where(F.col(name).between(wanted[0], wanted[-1]))
    return indexed.where(F.array_contains(long_array(wanted), F.col(name)) if len(wanted) <= 64 else _in_set(name, wanted))


def _in_set(name: str, wanted: Sequence[int]) -> Column:
    return F.expr(f"`{name}` IN ({','.join(f'{w}L' for w in wanted)})")


def spread_ranks(rows: int, most: int) -> list[int]:
    """``most`` positions spread evenly over ``rows``: floor(i * rows / most)."""
    if rows <= most:
        return list(range(rows))
    step = rows / most
    return [int(i * step) for i in range(most)]


def running_totals(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    index: str = "position",
    **options,
) -> DataFrame:
    """Inclusive running sums along a numeric key, per group, plus the position from 0.

    Expects one row per group and key value. Each sum ``s`` becomes ``running_s``. A group
    of any size is spread over the buckets.
    """
    cut = bucket_by_order(df, [key], **options)
    direction = -1 if descending else 1
    parts = [*by, BUCKET]
    order = col(key).desc() if descending else col(key).asc()
    inside = Window.partitionBy(*named(parts)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if len(cut.sizes) == 1:
        running = [F.sum(col(s)).over(inside).alias(f"running_{s}") for s in sums]
        place = (F.count(F.lit(1)).over(inside) - 1).alias(index)
        return cut.df.select(*named(df.columns), *running, place)
    local = cut.df.groupBy(*named(parts)).agg(
        F.count("*").alias("__rows_before"), *[F.sum(col(s)).alias(f"__total_before_{i}") for i, s in enumerate(sums)]
    )
    groups = named(by) or [F.lit(0)]
    before = Window.partitionBy(*groups).orderBy(F.col(BUCKET) * direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.select(
        *named(parts),
        F.coalesce(F.sum("__rows_before").over(before), F.lit(0)).alias("__rows_before"),
        *[F.coalesce(F.sum(f"__total_before_{i}").over(before), F.lit(0)).alias(f"__total_before_{i}") for i in range(len(sums))],
    )
    joined = match_groups(cut.df, offsets if by else F.broadcast(offsets), parts)
    running = [(F.col(f"__total_before_{i}") + F.sum(col(s)).over(inside)).alias(f"running_{s}") for i, s in enumerate(sums)]
    place = (F.col("__rows_before") + F.count(F.lit(1)).over(inside) - 1).alias(index)
    return joined.select(*named(df.columns), *running, place)


def group_quantiles(
    df: DataFrame,
    value: Column,
    probs: Sequence[float],
    by: Sequence[str] = (),
    in_memory_rows: int = 500_000,
    accuracy: int = 10_000,
    **options,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, NULL included, with ``n`` and array ``q``.

    Spark's own ``percentile`` keeps the distinct values of a group in one task, so it serves
    only groups of a checked size. For larger ones, approximate quantiles a little to each
    side enclose every wanted rank. Only the values in between are exchanged: they are counted
    per value, laid out in ordered buckets, and read off at the rank. Should an enclosure
    miss its rank, all values take part.
    """
    rows = df.select(*named(by), value.cast("double").alias("__v")).where("__v IS NOT NULL")
    largest = rows.groupBy(*named(by)).count().agg(F.max("count")).first()[0] or 0
    if largest <= in_memory_rows:
        shares = F.array(*[F.lit(float(p)) for p in probs])
        return rows.groupBy(*named(by)).agg(F.count("*").alias("n"), F.percentile("__v", shares).alias("q"))
    found = cut_lineage(_enclosed_quantiles(rows, probs, by, accuracy, options))
    if found.where(F.exists("q", lambda v: v.isNull())).isEmpty():
        return found
    return _enclosed_quantiles(rows, probs, by, None, options)


def _enclosed_quantiles(rows: DataFrame, probs: Sequence[float], by: Sequence[str], accuracy: int | None, options: dict) -> DataFrame:
    """Quantiles read off between approximate bounds (or none); NULL where they miss a rank."""
    groups, k = named(by), len(probs)
    if accuracy is None:
        bounds = F.array(*[F.lit(float("-inf"))] * k, *[F.lit(float("inf"))] * k)
    else:
        ends = [max(0.0, p - 3 / accuracy) for p in probs] + [min(1.0, p + 3 / accuracy) for p in probs]
        bounds = F.percentile_approx("__v", ends, accuracy)
    cuts = rows.groupBy(*groups).agg(F.count("*").alias("n"), bounds.alias("__cuts"))
    if by:
        # One row per group. The rows of few groups stay where they are, however many a group has.
        cuts = cut_lineage(cuts)
        bounded = match_groups(rows, F.broadcast(cuts) if cuts.count() <= FEW_GROUPS else cuts, by)
    else:
        row = cuts.first()
        bounded = rows.withColumn("n", F.lit(row.n)).withColumn("__cuts", double_array(row["__cuts"]))
    low, high = (lambda i: F.col("__cuts")[i]), (lambda i: F.col("__cuts")[k + i])
    probes = [F.struct(F.lit(i).alias("__probe"), low(i).alias("__low"), high(i).alias("__high")) for i in range(k)]
    inside = bounded.select(*groups, "__v", F.inline(F.array(*probes))).where("__v BETWEEN __low AND __high")
    counts = inside.groupBy(*groups, "__probe", "__v").agg(F.count("*").alias("__c"))
    ranked = running_totals(counts, "__v", ["__c"], [*by, "__probe"], **options)
    below = bounded.groupBy(*groups, "n").agg(*[F.count_if(F.col("__v") < low(i)).alias(f"__b{i}") for i in range(k)])
    missed = [
        F.struct(F.lit(i).alias("__probe"), F.lit(float(p)).alias("__p"), F.col(f"__b{i}").alias("__below"))
        for i, p in enumerate(probs)
    ]
    below = below.select(*groups, "n", F.inline(F.array(*missed)))
    place = F.col("__p") * (F.col("n") - 1)
    first = F.col("__below") + F.col("running___c") - F.col("__c")
    last = F.col("__below") + F.col("running___c") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(first, last), F.col("__v")))

    part = place - F.floor(place)
    read = (
        match_groups(below, ranked, [*by, "__probe"], "left")
        .groupBy(*groups, "n", "__probe", "__p")
        .agg(at(F.floor(place)).alias("__lo"), at(F.ceil(place)).alias("__hi"))
        .select(*groups, "n", "__probe", (F.col("__lo") * (1 - part) + F.col("__hi") * part).alias("__q"))
    )
    values = [F.max(F.when(F.col("__probe") == i, F.col("__q"))) for i in range(k)]
    return read.groupBy(*groups, "n").agg(F.array(*values).alias("q"))


def column_medians(df: DataFrame, columns: Sequence[str], in_memory_rows: int = 500_000, **options) -> dict[str, float | None]:
    """The exact median of each column, NULL and NaN left out; None where nothing is left."""
    if not columns:
        return {}
    if len(columns) <= WIDE_COLUMNS:
        if df.count() > in_memory_rows:
            return _enclosed_medians(df, columns, F.lit(0), [(0,)], **options)[0]
        row = df.agg(*[F.percentile(as_double(df, c), 0.5).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[i] for i, c in enumerate(columns)}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), as_double(df, c).alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    found = group_quantiles(long, F.col("value"), [0.5], ["column"], in_memory_rows, **options).collect()
    medians = {r.column: r.q[0] for r in found}
    return {c: medians.get(c) for c in columns}


def medians_without(df: DataFrame, columns: Sequence[str], part: str, parts: int, **options) -> list[dict[str, float | None]]:
    """For each part k of 0 to ``parts - 1``, the exact medians over the rows of all other parts; all from the same few passes."""
    if not columns:
        return [{} for _ in range(parts)]
    return _enclosed_medians(df, columns, col(part), [tuple(p for p in range(parts) if p != k) for k in range(parts)], **options)


def _enclosed_medians(
    df: DataFrame, columns: Sequence[str], part: Column, unions: Sequence[Sequence[int]], accuracy: int | None = 10_000, **options
) -> list[dict[str, float | None]]:
    """Exact medians of each column over unions of parts.

    The median of a union lies between the least and the greatest median of its parts, and approximate quantiles a
    little to each side enclose those. Only values in between are counted and read off at the rank; should an
    enclosure miss its rank, all values take part.
    """
    values = df.select(part.alias("__part"), *[as_double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    places = range(len(columns))
    ends = [0.5 - 3 / (accuracy or 10), 0.5 + 3 / (accuracy or 10)]
    about = [F.percentile_approx(f"v{i}", ends, accuracy or 10).alias(f"q{i}") for i in places]
    found = values.groupBy("__part").agg(*[F.count(f"v{i}").alias(f"n{i}") for i in places], *(about if accuracy else [])).collect()
    rows = {(r["__part"], i): r[f"n{i}"] for r in found for i in places}
    used = [i for i in places if any(rows[r["__part"], i] for r in found)]
    if not used:
        return [{c: None for c in columns} for _ in unions]
    low, high = dict.fromkeys(used, float("-inf")), dict.fromkeys(used, float("inf"))
    if accuracy:
        for i in used:
            known = [r[f"q{i}"] for r in found if r[f"n{i}"]]
            low[i], high[i] = min(q[0] for q in known), max(q[1] for q in known)
    bounds = {i: double_array([low[i], high[i]]) for i in used}
    below = values.groupBy("__part").agg(*[F.count_if(F.col(f"v{i}") < bounds[i][0]).alias(f"b{i}") for i in used]).collect()
    under = {(r["__part"], i): r[f"b{i}"] for r in below for i in used}
    entries = [F.when(F.col(f"v{i}").between(bounds[i][0], bounds[i][1]), F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"))) for i in used]
    inside = values.select("__part", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    counts = inside.groupBy("__part", "i", "v").agg(F.count("*").alias("c"))
    members = [(k, p) for k, union in enumerate(unions) for p in union]
    belongs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in members])
    shared = counts.select("__part", "i", "v", "c", F.inline(belongs)).where("p = __part")
    summed = cut_lineage(shared.groupBy("k", "i", "v").agg(F.sum("c").alias("c")))
    ranked = running_totals(summed, "v", ["c"], ["k", "i"], **options)
    wanted = {}
    for k, union in enumerate(unions):
        for i in used:
            n = sum(rows.get((p, i), 0) for p in union)
            if n:
                before = sum(under.get((p, i), 0) for p in union)
                wanted[k, i] = ((n - 1) // 2 - before, n // 2 - before)
    ranks = df.sparkSession.createDataFrame([(k, i, r) for (k, i), pair in wanted.items() for r in set(pair)], "k int, i int, rank bigint")
    hit = ranked.join(F.broadcast(ranks), ["k", "i"]).where((F.col("rank") < F.col("running_c")) & (F.col("rank") >= F.col("running_c") - F.col("c")))
    at = {(r.k, r.i, r["rank"]): r.v for r in hit.select("k", "i", "rank", "v").collect()}
    if accuracy and any((k, i, r) not in at for (k, i), pair in wanted.items() for r in pair):
        return _enclosed_medians(df, columns, part, unions, None, **options)

    def median(k: int, i: int) -> float | None:
        return sum(at[k, i, r] * 0.5 for r in wanted[k, i]) if (k, i) in wanted else None

    return [{c: median(k, i) for i, c in enumerate(columns)} for k in range(len(unions))]
