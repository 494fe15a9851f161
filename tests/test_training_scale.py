"""Training steps read a large table a few times only, and still learn the same."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gristmill.modelling import cluster, prepare, split, train
from gristmill.modelling.linear_cv import linear_fold_scores
from gristmill.operators.ordering import medians_without


def counted(spark, df, column):
    """The table with a column whose every computation is counted, and the count."""
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    return df.withColumn(column, F.udf(look, df.schema[column].dataType)(F.col(column))), seen


@pytest.mark.parametrize("accuracy", [10_000, 40, None])
def test_medians_without_each_part_are_exact(spark, accuracy):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"part": rng.integers(0, 3, 3001), "a": rng.normal(size=3001), "b": rng.integers(0, 4, 3001).astype(float)})
    frame["a"] += frame["part"] * 5
    frame.loc[rng.random(3001) < 0.3, "b"] = np.nan
    frame["none"] = np.nan
    df = spark.createDataFrame(frame).repartition(3)
    found = medians_without(df, ["a", "b", "none"], "part", 3, **({} if accuracy == 10_000 else {"accuracy": accuracy}))
    for k in range(3):
        rest = frame[frame["part"] != k]
        assert found[k]["a"] == pytest.approx(rest["a"].median(), abs=1e-12)
        assert found[k]["b"] == rest["b"].median()
        assert found[k]["none"] is None


def test_fold_scores_compute_their_columns_once(spark):
    rows = [(i, float(i % 17), float(i % 5) if i % 4 else None) for i in range(2000)]
    df, seen = counted(spark, spark.createDataFrame(rows, "id int, y double, x double"), "x")
    scores = linear_fold_scores(df, "y", ["x"], "id", 4)
    assert sum(s["rows"] for s in scores) == 2000
    assert seen.value <= 2000


def test_prepared_folds_compute_the_source_once_and_share_what_is_alike(spark):
    rows = [(i, float(i % 7), "ab"[i % 2], float(i % 3)) for i in range(600)]
    df, seen = counted(spark, spark.createDataFrame(rows, "id int, x double, t string, y double"), "x")
    data = train.training_set(df, "y", ["x", "t"], "regression", "id")
    before = seen.value
    tables = train.prepared_folds(data, 3)
    assert [t.where(f"fold = {i}").count() > 0 for i, t in enumerate(tables)] == [True] * 3
    assert seen.value - before <= 600
    assert tables[0] is tables[1] is tables[2]
    train.release(tables)
    data.release()


def test_fold_preparations_are_those_learned_without_each_fold(spark):
    rows = [(i % 3, float(i % 11) if i % 5 else None, ["a", "b", "c", "d"][min(i % 4, 2 + (i == 7))]) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, x double, t string")
    found = prepare.learn_fold_preparations(df, ["x", "t"], "fold", 3)
    for k in range(3):
        alone = prepare.learn_preparation(df.where(F.col("fold") != k), ["x", "t"])
        assert (found[k].fills, found[k].categories) == (alone.fills, alone.categories)


@pytest.mark.parametrize("algorithm", ["xgboost", "lightgbm"])
@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_learns_from_grouped_rows_what_it_learns_from_single_ones(spark, task, algorithm):
    rows = [(i, float(i % 5), float(i % 3), float((i * 7) % 11 > 4) if task == "classification" else i % 5 * 2.0 + i % 7 % 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double")
    df = prepare.learn_preparation(df, ["a", "b"]).transform(df).select("id", "label", "features").coalesce(1).cache()
    classes = 3 if task == "classification" and algorithm == "xgboost" else 2
    if classes == 3:
        df = df.withColumn("label", F.col("label") + (F.col("id") % 15 == 3).cast("double"))
    estimator = train.make_estimator(task, algorithm, 1500, classes, n_estimators=4, max_depth=3)
    single, grouped = estimator.fit(df), train.learn(estimator, df, task)
    assert "weight" in (grouped.models[0] if classes == 3 else grouped).explainParam("weightCol").split("current: ")[-1]
    name = "prediction" if task == "regression" else "rawPrediction"
    value = (lambda c: F.array(c)) if task == "regression" else vector_to_array
    both = single.transform(df).select("id", value(name).alias("p")).join(train.score(grouped, df).select("id", value(name).alias("q")), "id")
    assert both.count() == 1500
    assert both.where(F.exists(F.zip_with("p", "q", lambda p, q: F.abs(p - q)), lambda d: d > 1e-6)).isEmpty()


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosting_learns_from_rows_of_equal_bins_what_it_learns_from_single_ones(spark, task, monkeypatch):
    monkeypatch.setattr(train, "BINNED_ROWS", 0)
    target = "double(x * a > 1 or id % 50 = 3)" if task == "classification" else "x * a + id % 7"
    df = spark.range(6000).selectExpr("id", "double(id % 3) AS a", "if(id % 5 = 0, 0, rand(3) * rand(4)) AS x", "double(7) AS c")
    df = df.selectExpr("id", "a", "x", "c", f"{target} AS label")
    df = prepare.learn_preparation(df, ["a", "x", "c"]).transform(df).select("id", "label", "features").coalesce(1).cache()
    bins = train.learn_bins(df, 6000)
    assert [len(c) for c in bins.centers[::2]] == [3, 1] and 40 <= len(bins.centers[1]) <= 64
    estimator = train.make_estimator(task, "lightgbm", 6000, n_estimators=4, num_leaves=8)
    binned = train.learn(estimator, df, task)
    assert "weight" in binned.explainParam("weightCol").split("current: ")[-1]
    # The same rows, each value replaced by the one that stands for it.
    nearest = F.udf(lambda v: [min(c, key=lambda m: (abs(m - x), m)) for c, x in zip(bins.centers, v.toArray().tolist())], "array<double>")
    single = estimator.fit(df.select("id", "label", array_to_vector(nearest("features")).alias("features")).coalesce(1))
    both = single.transform(df).select("id", F.col("prediction").alias("p")).join(binned.transform(df).select("id", F.col("prediction").alias("q")), "id")
    assert both.count() == 6000
    assert both.where(F.abs(F.col("p") - F.col("q")) > 1e-6).isEmpty()
    # Splits are as good as those that MLlib finds by itself.
    if task == "regression":
        error = [m.transform(df).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0] for m in (binned, estimator.fit(df))]
        assert error[0] <= error[1] * 1.02


def test_bins_that_leave_too_many_rows_are_not_used(spark):
    df = spark.range(3000).selectExpr("id", "rand(1) AS a", "rand(2) AS b", "rand(5) AS label")
    df = prepare.learn_preparation(df, ["a", "b"]).transform(df)
    assert train.learn_bins(df, 3000) is None
    assert train._apart([1.0, 3.0, 1.0, math.nextafter(1.0, 2.0), 2.0]) == (1.0, 2.0, 3.0)


def test_a_training_set_of_any_size_has_small_partitions(spark):
    class Asked:
        def repartition(self, n, *_):
            self.n = n
            return self

        def sortWithinPartitions(self, *_):
            return self

    for rows in (9_000_000, 54_000_000, 216_000_000):
        assert rows / train._balanced(Asked(), "id", rows).n < 600_000


def test_kmeans_takes_equal_points_as_one_with_a_weight(spark):
    centers = [[0.0, 0.0], [10.0, 0.0], [0.0, 30.0]]
    rows = [([c[0] + i % 3, c[1] + i % 2],) for c in centers for i in range(600)]
    model = cluster.kmeans(spark.createDataFrame(rows, "point array<double>"), 3, restarts=3)
    found = sorted(c.tolist() for c in model.clusterCenters())
    assert np.allclose(found, sorted([c[0] + 1, c[1] + 0.5] for c in centers))
    assert model.summary.trainingCost == pytest.approx(1800 * (2 / 3 + 0.25))
    assert model.getOrDefault("weightCol") == "weight"


def test_many_texts_are_known_without_exchanging_them(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS many", "CAST(id % 9 AS STRING) AS few", "CAST(id % 11 AS STRING) AS more")
    found = prepare._categories(df, ["many", "few", "more"], 10)
    assert found == {"few": [str(i) for i in range(9)]}


def test_the_side_of_a_row_is_hashed_once(spark):
    df, seen = counted(spark, spark.range(1000).selectExpr("id", "double(id % 5) AS x", "double(id % 7) AS y"), "id")
    data = train.training_set(df, "y", ["x"], "regression", "id")
    # Once for the key, once for its hash, if Spark does not share the two.
    assert seen.value <= 2000
    expected = df.where(split.holdout_flag(F.col("id"))).count()
    assert data.test_rows == expected
    data.release()


def test_rows_of_one_partition_are_dealt_to_several_tasks(spark, monkeypatch):
    """The flag of the test side says which task computed it; one partition would put all rows on one side."""
    monkeypatch.setattr(train, "holdout_flag", lambda *_: F.spark_partition_id() % 2 == 1)
    df = spark.range(0, 200_000, 1, 1).selectExpr("concat('a key of some length ', md5(cast(id AS string))) AS key", "id % 7 + rand(1) AS x", "id % 3 + rand(2) AS y")
    data = train.training_set(df, "y", ["x"], "regression", "key")
    assert min(data.train_rows, data.test_rows) > 10_000
    data.release()
