import pytest
from pyspark.sql import functions as F

from gristmill.modelling.prepare import leakage_check
from gristmill.operators import charts, cleaning, features, profiling, shape
from gristmill.operators.recipe import Recipe, replay, steps_from_json
from gristmill.sources import tables as sources

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "1.5", 10.0, "a", True),
        (2, "x", None, "b", False),
        (3, " 2 ", NAN, None, None),
        (4, None, -4.0, "a", True),
        (5, "1d", 0.0, "b", True),
    ]
    return spark.createDataFrame(rows, "id long, t string, x double, c string, b boolean")


def values(df, name, key="id"):
    return {r[key]: r[name] for r in df.collect()}


def test_drop_and_rename_reject_bad_names(small):
    assert "t" not in shape.drop_column(small, "t").columns
    for bad in (lambda: shape.drop_column(small, "nope"), lambda: shape.rename_column(small, "t", "x"), lambda: shape.rename_column(small, "nope", "y")):
        with pytest.raises(ValueError):
            bad()
    assert shape.rename_column(small, "t", "text").columns[1] == "text"


def test_cast_is_lenient_and_knows_its_targets(small):
    assert values(shape.cast_column(small, "t", "float"), "t") == {1: 1.5, 2: None, 3: 2.0, 4: None, 5: None}
    assert values(shape.cast_column(small, "id", "category"), "id", "x") is not None
    assert dict(shape.cast_columns(small, {"b": "i64", "id": "bool"}).dtypes)["b"] == "bigint"
    with pytest.raises(ValueError):
        shape.cast_columns(small, {"t": "f64", "x": "money"})


def test_filter_by_number_text_and_flag(small):
    assert set(values(shape.filter_rows(small, "x", "-4"), "x")) == {4}
    assert set(values(shape.filter_rows(small, "x", "0."), "x")) == {5}
    assert set(values(shape.filter_rows(small, "c", " a "), "c")) == {1, 4}
    assert set(values(shape.filter_rows(small, "b", "tru"), "b")) == {1, 4, 5}


def test_sort_puts_missing_first_both_ways(small):
    df = small.where("id <> 3")
    assert [r.id for r in shape.sort_rows(df, "x", True, ["id"]).collect()][0] == 2
    assert [r.id for r in shape.sort_rows(df, "x", False, ["id"]).collect()] == [2, 4, 5, 1]


def test_fills(small):
    assert values(cleaning.fill_mean(small, "x"), "x")[2] == pytest.approx(2.0)
    assert values(cleaning.fill_median(small, "x"), "x")[3] == 0.0
    assert values(cleaning.fill_zero(small, "x"), "x")[2] == 0.0
    assert values(cleaning.fill_mode(small, "c"), "c")[3] == "a"
    with pytest.raises(ValueError):
        cleaning.fill_zero(small, "c")
    nothing = small.withColumn("n", F.lit(None).cast("double"))
    for fill in (cleaning.fill_mean, cleaning.fill_median, cleaning.fill_mode):
        with pytest.raises(ValueError):
            fill(nothing, "n")


def test_mean_of_whole_numbers_becomes_double(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 2)], "id long, n int")
    assert values(cleaning.fill_mean(df, "n"), "n") == {1: 1.0, 2: 1.5, 3: 2.0}
    assert dict(cleaning.fill_mode(df, "n").dtypes)["n"] == "int"


def test_one_hot_keeps_missing_and_guards_width(small):
    df = cleaning.one_hot(small, "c")
    row = {r.id: (r.c_a, r.c_b) for r in df.collect()}
    assert row[1] == (1, 0) and row[2] == (0, 1) and row[3] == (None, None)
    with pytest.raises(ValueError):
        cleaning.one_hot(small, "id", limit=3)


def test_mostly_numeric_text(spark):
    rows = [(i, "oops" if i == 0 else f"{i}.5", "" if i < 5 else str(i), "x" if i % 2 else "1") for i in range(10)]
    df = cleaning.coerce_mostly_numeric(spark.createDataFrame(rows, "id long, a string, b string, c string"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double", "string"]
    assert values(df, "a")[0] is None and values(df, "b")[4] is None


def test_recommendations_need_only_zero_and_one_without_missing(spark):
    df = spark.createDataFrame([(0, 1.0, "1", 0), (1, 0.0, "2", None), (1, 1.0, None, 1)], "i int, d double, t string, n int")
    got = {r.column: r.recommended_type for r in cleaning.type_recommendations(df).collect()}
    assert got == {"i": "bool", "d": "bool", "t": "f64"}
    assert cleaning.type_recommendations(df.select(F.lit(True).alias("b"))).count() == 0


def test_transforms_and_their_edges(small):
    x = values(features.transform_column(small, "x", "log", "r"), "r")
    assert x[1] == pytest.approx(2.302585) and x[4] is None and x[5] is None and x[3] is None
    assert values(features.transform_column(small, "x", "sqrt"), "x_sqrt")[4] is None
    assert values(features.transform_column(small, "x", "normalize"), "x_norm")[4] == 0.0
    flat = small.withColumn("k", F.lit(3.0))
    for kind in ("standardize", "normalize"):
        with pytest.raises(ValueError):
            features.transform_column(flat, "k", kind)
    with pytest.raises(ValueError):
        features.transform_column(small, "x", "cube")
    assert values(features.combine_columns(small, "id", "x", "divide"), "id_div_x")[5] is None
    with pytest.raises(ValueError):
        features.combine_columns(small, "id", "x", "power")


def test_bins_clamp_the_top_edge_and_handle_constants(small):
    df = features.bin_column(small, "x", 4)
    assert {k: v for k, v in values(df, "x_binned_index").items()} == {1: 3, 2: None, 3: None, 4: 0, 5: 1}
    assert values(df, "x_binned")[1] == "6.5-10.0"
    flat = features.bin_column(small.withColumn("k", F.lit(3.0)), "k", 5)
    assert set(values(flat, "k_binned_index").values()) == {0}
    with pytest.raises(ValueError):
        features.bin_column(small, "x", 0)


def test_profile_counts_missing_as_one_value(small):
    got = {r.name: r for r in profiling.profile_columns(small).collect()}
    assert (got["x"]["count"], got["x"].null_count, got["x"].unique_count) == (5, 2, 4)
    assert got["x"].min == "-4.0000" and got["x"].max == "10.0000" and got["c"].mean is None
    approx = {r.name: r for r in profiling.profile_columns(small, approx=True).collect()}
    assert approx["c"].unique_count == 3


def test_profile_of_nested_and_empty_tables(spark, small):
    nested = small.withColumn("arr", F.array("x"))
    row = profiling.profile_column(nested, "arr").first()
    assert row.unique_count is None and row.null_count == 0
    empty = {r.name: r for r in profiling.profile_columns(small.limit(0)).collect()}
    assert empty["x"]["count"] == 0 and empty["x"].null_percent == 0.0


def test_negative_zero_is_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "z double")
    assert profiling.profile_column(df, "z").first().unique_count == 1


def test_preview_leaves_the_table_alone(small):
    rows = profiling.preview(small, lambda d: cleaning.fill_mean(d, "x"), "x", ["id"]).collect()
    before, after = (next(r for r in rows if r.phase == p) for p in ("before", "after"))
    assert before.null_count == 2 and after.null_count == 0
    assert after.samples[0] == "10.0" and len(after.samples) == 5


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 10.0, None, NAN)], "x double")
    counts = [r["count"] for r in charts.histogram(df, "x", 5).orderBy("ord").collect()]
    assert counts == [2, 1, 0, 0, 1]
    assert [r["count"] for r in charts.histogram(df.select(F.lit(2.0).alias("x")), "x").collect()] == [6]
    assert charts.histogram(df.where("x IS NULL"), "x").count() == 0


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, 6.0, 5.0, None)], "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r.r for r in charts.correlation_matrix(df).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] == 0.0 and got["a", "d"] == 0.0 and got["c", "c"] == 1.0
    assert len(got) == 16
    with pytest.raises(ValueError):
        charts.correlation_matrix(df.select(F.lit("t").alias("t")))


def test_many_pairs_take_the_spread_plan(spark, monkeypatch):
    df = spark.range(200).select(*[((F.col("id") * (j + 3)) % (11 + j)).cast("double").alias(f"x.{j}") for j in range(5)])
    few = {(r.col_a, r.col_b): r.r for r in charts.correlation_matrix(df).collect()}
    monkeypatch.setattr(charts, "WIDE_PAIRS", 0)
    many = {(r.col_a, r.col_b): r.r for r in charts.correlation_matrix(df).collect()}
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k]) for k in few)


def test_scatter_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(5000).select("id", (F.col("id") * 2.0).alias("x"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("y"))
    runs = [charts.scatter_sample(df.repartition(p), "x", "y", ["id"], 100, task_rows=0).orderBy("position").collect() for p in (1, 4, 17)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 100


def test_box_plot_outliers_and_group_order(spark):
    rows = [("a", float(v)) for v in range(1, 10)] + [("a", 100.0), ("b", 5.0), (None, 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.group: r for r in charts.box_plot_with_outliers(df, "v", "g").collect()}
    assert got["a"].median == 5.5 and got["a"].max == 100.0 and got["a"].outliers == [100.0]
    assert got["b"].q1 == got["b"].q3 == 5.0 and got["b"].outliers == []
    assert [r.group for r in charts.box_plot(df, "v", "g", most=1).collect()] == ["a"]


def test_recipe_undo_restore_and_replay(small):
    recipe = Recipe(small).apply("fill_mean", "x").apply("transform", "x", transform="standardize", name="z").apply("one_hot", "c")
    assert [s.action for s in recipe.steps] == ["fill_mean", "transform", "one_hot"]
    assert recipe.log().count() == 3
    assert "c" in recipe.undo().df.columns and recipe.restore(0).df.columns == small.columns
    assert recipe.restore(3) is recipe
    for bad in (lambda: Recipe(small).undo(), lambda: recipe.restore(4), lambda: recipe.apply("nope")):
        with pytest.raises(ValueError):
            bad()
    other = small.where("id IN (2, 4)")
    again = replay(steps_from_json(recipe.to_json()), other)
    assert again.columns == recipe.df.columns
    full = {r.id: r.z for r in recipe.df.collect()}
    assert {r.id: r.z for r in again.collect()} == {k: full[k] for k in (2, 4)}


def test_failed_step_leaves_no_trace(small):
    recipe = Recipe(small).apply("fill_zero", "x")
    with pytest.raises(ValueError):
        recipe.apply("cast", "x", target="money")
    assert len(recipe.steps) == 1


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_csv_finds_its_separator(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(sep.join(["id", "name", "when"]) + "\n" + "\n".join(sep.join([str(i), f"n{i}", "2024-01-02"]) for i in range(5)))
    df = sources.load(spark, str(path))
    assert df.count() == 5 and dict(df.dtypes) == {"id": "int", "name": "string", "when": "date"}


def test_csv_without_rows_or_with_late_surprises(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,b\n")
    with pytest.raises(ValueError):
        sources.load_csv(spark, str(path))
    path = tmp_path / "l.csv"
    path.write_text("a,\n1,2\n2,3\nlate,4\n")
    df = sources.load_csv(spark, str(path))
    assert df.columns == ["a", "column_1"] and [r.a for r in df.orderBy("column_1").collect()] == ["1", "2", "late"]
    assert sources.detect_separator("a;b,c") == "," and sources.detect_separator("a") == ","


def test_write_and_read_back(spark, small, tmp_path):
    for kind in ("csv", "parquet"):
        sources.write_table(small, str(tmp_path / kind), kind)
    assert sources.load_parquet(spark, str(tmp_path / "parquet")).count() == 5
    assert sources.load_csv(spark, str(tmp_path / "csv")).columns == small.columns
    with pytest.raises(ValueError):
        sources.write_table(small, str(tmp_path / "x"), "orc?")


def test_correlation_by_blocks_equals_pair_by_pair(spark):
    columns = [f"c{i}" for i in range(8)]
    rule = "CASE WHEN hash(id, {i}) % 5 = 0 THEN NULL ELSE CAST(hash(id, {i}, 7) % 1000 AS DOUBLE) * {i} + id END"
    df = spark.range(500).selectExpr(*[f"{rule.format(i=i)} AS c{i}" for i in range(8)]).repartition(4)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    blocks = {(r.col_a, r.col_b): r.r for r in charts.pair_correlations(df, pairs).collect()}
    assert len(blocks) == 28
    for a, b in pairs:
        one = charts.pair_correlations(df, [(a, b)]).first().r
        assert blocks[a, b] == pytest.approx(one, abs=1e-9)
    # An infinite value goes pair by pair.
    endless = df.withColumn("c0", F.when(F.col("c1") > 0, F.lit(float("inf"))).otherwise(F.col("c0")))
    assert len(charts.pair_correlations(endless, pairs).collect()) == 28


def test_names_with_dots_in_many_correlations(spark):
    names = [f"x.{i}" for i in range(18)]
    df = spark.range(200).selectExpr("id", "CAST(id AS DOUBLE) AS `y.t`", *[f"CAST(id * {i + 1} + hash(id, {i}) % {10 ** (i % 4 + 1)} AS DOUBLE) AS `x.{i}`" for i in range(18)])
    flagged = {r.feature: r.correlation for r in leakage_check(df, names, "y.t").collect()}
    for name in names:
        one = charts.pair_correlations(df, [(name, "y.t")]).first().r
        assert (name in flagged) == (abs(one) > 0.95)
        assert name not in flagged or flagged[name] == pytest.approx(one, abs=1e-4)
