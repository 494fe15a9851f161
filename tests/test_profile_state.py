import pytest
from pyspark.sql import functions as F

from gristmill.operators import cleaning, frequent, profile_state, profiling

EXACT = ("name", "dtype", "count", "null_count", "min", "max")


def facts(df):
    return {r["name"]: r for r in df.collect()}


def same_profile(merged, whole):
    merged, whole = facts(merged), facts(whole)
    assert merged.keys() == whole.keys()
    for name, row in whole.items():
        got = merged[name]
        assert [got[c] for c in EXACT] == [row[c] for c in EXACT]
        for c in ("null_percent", "mean", "std"):
            assert got[c] == (None if row[c] is None else pytest.approx(row[c], rel=1e-9, abs=1e-9))
        if row["unique_count"] is not None:
            assert abs(got["unique_count"] - row["unique_count"]) <= 0.05 * row["unique_count"] + 1


@pytest.fixture(scope="module")
def measures(spark):
    return spark.range(6000).select(
        F.col("id"),
        (F.col("id") % 7).cast("string").alias("day"),
        (1e9 + F.col("id") % 13).alias("far.away"),
        F.when(F.col("id") % 7 != 3, F.col("id") * 0.5).alias("part"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 11).alias("odd"),
        F.lit(None).cast("double").alias("empty"),
        F.concat(F.lit("t" * 80), F.col("id") % 1500).alias("text"),
        F.array("id").alias("list"),
    )


def test_slices_merge_to_the_profile_of_the_table(spark, measures, tmp_path):
    path = str(tmp_path / "states")
    for day in range(7):
        profile_state.write_states(profile_state.slice_states(measures.where(F.col("day") == str(day)), F.col("day")), path)
    states = profile_state.read_states(spark, path)
    assert states.count() == 7 * len(measures.columns)
    merged = profile_state.profile_of_states(states)
    same_profile(merged, profiling.profile_columns(measures))
    low, middle, high = facts(merged)["id"]["quantiles"]
    assert abs(low - 1500) < 160 and abs(middle - 3000) < 160 and abs(high - 4500) < 160
    assert facts(merged)["text"]["quantiles"] is None and facts(merged)["empty"]["quantiles"] is None


def test_a_slice_written_again_is_replaced(spark, measures, tmp_path):
    path = str(tmp_path / "states")
    profile_state.write_states(profile_state.slice_states(measures, F.col("day")), path)
    late = measures.where("day = '2'").withColumn("part", F.lit(-8.0))
    profile_state.write_states(profile_state.slice_states(late, F.col("day")), path)
    whole = measures.withColumn("part", F.when(F.col("day") == "2", -8.0).otherwise(F.col("part")))
    same_profile(profile_state.profile_of_states(profile_state.read_states(spark, path)), profiling.profile_columns(whole))


def test_merged_states_merge_again(measures):
    states = profile_state.slice_states(measures, F.col("day"))
    early = profile_state.merge_states(states.where("slice < '4'"), "early")
    again = early.unionByName(states.where("slice >= '4'"))
    same_profile(profile_state.profile_of_states(again), profiling.profile_columns(measures))


def test_states_of_odd_tables(spark, measures):
    assert profile_state.slice_states(measures.limit(0), F.col("day")).count() == 0
    one = measures.limit(1).withColumn("slice", F.lit(None).cast("string"))
    states = profile_state.slice_states(one, F.col("slice"))
    assert {r["slice"] for r in states.collect()} == {None}
    assert facts(profile_state.profile_of_states(states))["id"]["std"] is None


def listed(df):
    return [(r["value"], r["count"]) for r in df.collect()]


@pytest.mark.parametrize("counters", [1, 20, 4096])
@pytest.mark.parametrize("column", ["few", "skewed", "unique", "real", "long.text", "list", "raw"])
def test_most_frequent_equals_full_count(spark, column, counters):
    i = F.col("id")
    df = spark.range(0, 4000, 1, 5).select(
        F.when(i % 9 != 0, i % 6).alias("few"),
        F.when(i % 3 == 0, F.lit(-1)).otherwise(F.when(i % 4 == 0, i % 30).otherwise(i)).alias("skewed"),
        i.alias("unique"),
        F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 5 == 1, -0.0).when(i % 5 == 2, 0.0).otherwise(i / 7).alias("real"),
        F.concat(F.lit("x" * 90), F.when(i % 2 == 0, i % 10).otherwise(i)).alias("long.text"),
        F.array(i % 3).alias("list"),
        (i % 40).cast("string").cast("binary").alias("raw"),
    )
    expected = [tuple(str(x) for x in r) for r in listed(cleaning.value_counts(df, column).limit(15))]
    assert [tuple(str(x) for x in r) for r in listed(frequent.most_frequent(df, column, 15, counters))] == expected


def test_only_candidates_are_counted(spark):
    i = F.col("id")
    df = spark.range(0, 60_000, 1, 4).select(F.when(i % 3 == 0, i % 60).otherwise(i + 1000).alias("v"))
    found = frequent.candidates(df, "v", 10, counters=500)
    assert found is not None and found.count() <= 40
    assert frequent.candidates(spark.range(60_000), "id", 10, counters=500) is None
    assert frequent.most_frequent(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        frequent.most_frequent(df, "v", 0)
