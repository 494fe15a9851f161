import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import cleaning, ordering, shape

# Forces the many-bucket paths on small tables.
SPREAD = {"task_rows": 0, "buckets": 7}


def numbers(spark, values, partitions=4):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id long, v double").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("options", [{}, SPREAD, {"task_rows": 0, "buckets": 5, "hot_rows": 1}])
def test_row_index_is_the_position_in_the_order(spark, partitions, options):
    df = numbers(spark, range(300), partitions)
    got = dict(ordering.with_row_index(df, ["id"], **options).select("id", "row_index").collect())
    assert got == {i: i for i in range(300)}


def test_row_index_with_one_hot_leading_value_uses_all_order_columns(spark):
    df = spark.createDataFrame([(7.0 if i % 3 else float(i), i) for i in range(400)], "a double, b long")
    got = ordering.with_row_index(df, ["a", "b"], task_rows=0, buckets=6, hot_rows=20).collect()
    expected = {row: at for at, row in enumerate(sorted((r.a, r.b) for r in got))}
    assert all(r.row_index == expected[(r.a, r.b)] for r in got)


def test_row_index_over_text_and_nulls(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("c",)], "t string")
    got = {r.t: r.row_index for r in ordering.with_row_index(df, ["t"]).collect()}
    assert got == {None: 0, "a": 1, "b": 2, "c": 3}
    times = spark.sql("SELECT timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 7) AS t, id FROM range(50)")
    assert all(r.id == r.row_index for r in ordering.with_row_index(times, ["t"], **SPREAD).collect())


def test_rows_at_reads_only_the_wanted_places(spark):
    df = numbers(spark, range(500))
    got = ordering.rows_at(df, ["id"], lambda n: [0, 3, 250, n - 1], **SPREAD).collect()
    assert sorted(r.id for r in got) == [0, 3, 250, 499]
    assert ordering.rows_at(df, ["id"], lambda n: [], **SPREAD).count() == 0


def test_spread_ranks():
    assert ordering.spread_ranks(3, 5) == [0, 1, 2]
    assert ordering.spread_ranks(4001, 2000)[:3] == [0, 2, 4]
    assert len(set(ordering.spread_ranks(4001, 2000))) == 2000


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("options", [{}, SPREAD])
def test_running_totals_per_group(spark, descending, options):
    rows = [(g, float(k), (k * 7) % 5) for g in ("x", "y") for k in range(120)]
    df = spark.createDataFrame(rows, "g string, k double, c long")
    got = ordering.running_totals(df, "k", ["c"], ["g"], descending, **options).collect()
    for g in ("x", "y"):
        total = 0
        for at, r in enumerate(sorted((r for r in got if r.g == g), key=lambda r: -r.k if descending else r.k)):
            total += r.c
            assert (r.running_c, r.position) == (total, at)


@pytest.mark.parametrize("limit, accuracy", [(10**6, 10_000), (0, 10_000), (0, 100), (0, 2)])
def test_group_quantiles_equal_linear_interpolation(spark, limit, accuracy):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=501), "b": np.full(300, 2.5), "c": rng.integers(0, 9, 77) * 1.0}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in ordering.group_quantiles(df, F.col("v"), probs, ["g"], in_memory_rows=limit, accuracy=accuracy, **SPREAD).collect():
        assert r.n == len(data[r.g])
        assert np.allclose(r.q, np.quantile(data[r.g], probs))


def test_a_missed_enclosure_falls_back_to_all_values(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    enclosed, asked = ordering._enclosed_quantiles, []

    def missing(rows, probs, by, accuracy, options):
        asked.append(accuracy)
        found = enclosed(rows, probs, by, accuracy, options)
        return found if accuracy is None else found.withColumn("q", F.array(F.lit(None).cast("double")))

    monkeypatch.setattr(ordering, "_enclosed_quantiles", missing)
    assert ordering.group_quantiles(df, F.col("v"), [0.5], in_memory_rows=0).first().q == [499.5]
    assert asked == [10_000, None]


def test_column_medians_both_ways(spark):
    df = spark.createDataFrame([(1.0, 5), (float("nan"), 7), (3.0, None), (None, 100)], "a double, b long")
    for limit in (10, 0):
        assert ordering.column_medians(df, ["a", "b"], limit) == {"a": 2.0, "b": 7.0}
    empty = df.where("a > 100")
    assert ordering.column_medians(empty, ["a"]) == {"a": None}


@pytest.mark.parametrize("options", [{}, SPREAD, {"task_rows": 0, "buckets": 5, "hot_rows": 1}])
def test_forward_fill_crosses_bucket_borders(spark, options):
    values = [None] * 3 + [1.0] + [None] * 150 + [2.0, None, 3.0] + [None] * 40
    df = numbers(spark, values)
    got = dict(cleaning.fill_forward(df, "v", ["id"], **options).collect())
    last = None
    for i, v in enumerate(values):
        last = v if v is not None else last
        assert got[i] == last


def test_forward_fill_per_key_with_missing_keys(spark):
    rows = [(i, None if i % 4 == 0 else f"k{i % 3}", float(i) if i % 5 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    for options in ({}, SPREAD):
        got = {r.id: r.v for r in cleaning.fill_forward(df, "v", ["id"], ["k"], **options).collect()}
        last = {}
        for i, k, v in rows:
            last[k] = v if v is not None else last.get(k)
            assert got[i] == last[k]


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    df = numbers(spark, range(300))
    shallow = [r.id for r in shape.table_page(df, ["id"], 120, 15).collect()]
    monkeypatch.setattr(shape, "SHALLOW_PAGE", 0)
    assert [r.id for r in shape.table_page(df, ["id"], 120, 15).collect()] == shallow == list(range(120, 135))
    assert shape.table_page(df, ["id"], 295, 100).count() == 5
    assert shape.table_page(df, ["id"], 900, 10).count() == 0


def test_missing_groups_on_both_sides_of_each_threshold(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 > 0 THEN concat('g', id % 3) END AS g", "CAST(id % 101 AS DOUBLE) AS v", "id")
    small = ordering.group_quantiles(df, F.col("v"), [0.25, 0.9], ["g"])
    large = ordering.group_quantiles(df, F.col("v"), [0.25, 0.9], ["g"], in_memory_rows=0, task_rows=10)
    rows = {(r.g, r.n, *r.q) for r in small.collect()}
    assert len(rows) == 3 and rows == {(r.g, r.n, *r.q) for r in large.collect()}
    one, many = (
        {(r.g, r.id, r.position, r.running_v) for r in ordering.running_totals(df, "id", ["v"], ["g"], task_rows=n).collect()}
        for n in (10_000, 10)
    )
    assert len(one) == 3000 and one == many


def test_large_groups_stay_in_place(spark):
    """The rows are not exchanged by group, however Spark is set."""
    df = spark.range(3000).selectExpr("concat('g', id % 3) AS g", "CAST(id AS DOUBLE) AS v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cuts = df.groupBy("g").agg(F.max("v").alias("top"))
        plan = ordering.match_groups(df, F.broadcast(cuts), ["g"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert ordering.group_quantiles(df, F.col("v"), [0.5], ["g"], in_memory_rows=0).count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [1, 2, 7, 8])
def test_borders_below_a_key_are_counted_by_halving(spark, most):
    borders = [(None, 0), *[("abcdefgh"[i // 2], i) for i in range(1, most)]][:most]
    keys = [*borders, (None, -1), ("", 5), ("b", 3), ("zz", 0)]
    df = spark.createDataFrame([(keys, borders)], "keys array<struct<t string, n int>>, borders array<struct<t string, n int>>")
    df = df.select(F.explode("keys").alias("key"), "borders")
    below = ordering._borders_below(F.col("borders"), most, F.col("key"))
    got = df.select(below.alias("fast"), F.size(F.filter("borders", lambda b: b < F.col("key"))).alias("slow")).collect()
    assert len(got) == most + 4 and all(r.fast == r.slow for r in got)
