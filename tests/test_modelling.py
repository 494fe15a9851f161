import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions.expressions import hash_number
from gristmill.modelling import categories
from gristmill.modelling import cluster as C
from gristmill.modelling import density, diagnose, explain, metrics, prepare, report, split
from gristmill.modelling import train as T
from gristmill.modelling.linear_cv import linear_fold_scores

NAN, INF = float("nan"), float("inf")


def noise(i: int, seed: str):
    """A number near a standard normal from a hash of the key: a sum of uniforms."""
    parts = [hash_number(F.col("id"), f"{seed}{i}{k}") / float(2**32) for k in range(6)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return (total - 3.0) * math.sqrt(2.0)


def classes_table(spark, rows, classes, features, signal, apart=2.0):
    df = spark.range(rows).withColumn("target", (F.col("id") % classes).cast("int"))
    return df.select("id", "target", *[(noise(j, "c") + (F.col("target") * apart if j < signal else 0.0)).alias(f"x{j}") for j in range(features)])


def numbers_table(spark, rows, weights, spread):
    df = spark.range(rows).select("id", *[noise(j, "r").alias(f"f{j}") for j in range(10)])
    return df.withColumn("target", sum(w * F.col(f"f{j}") for j, w in enumerate(weights)) + noise(99, "e") * spread)


@pytest.fixture(scope="module")
def three(spark):
    df = classes_table(spark, 150, 3, 4, 4).cache()
    return T.training_set(df, "target", [f"x{j}" for j in range(4)], "classification", "id")


@pytest.fixture(scope="module")
def two(spark):
    df = classes_table(spark, 569, 2, 12, 8, 1.5).cache()
    return T.training_set(df, "target", [f"x{j}" for j in range(12)], "classification", "id")


@pytest.fixture(scope="module")
def line(spark):
    df = numbers_table(spark, 1000, (40, 30, 25, 20, 15, 10), 10).cache()
    return T.training_set(df, "target", [f"f{j}" for j in range(10)], "regression", "id")


QUICK = {
    "random_forest": {"n_estimators": 20, "max_depth": 8},
    "xgboost": {"n_estimators": 15, "max_depth": 3, "learning_rate": 0.3},
    "lightgbm": {"n_estimators": 15, "num_leaves": 8, "learning_rate": 0.3},
}


@pytest.mark.parametrize("algorithm", ["random_forest", "logistic_regression"])
def test_three_class_floor(three, algorithm):
    r = T.fit(three, algorithm, QUICK.get(algorithm))
    assert r.metrics["accuracy"] >= 0.90 and r.metrics["f1"] >= 0.88


@pytest.mark.parametrize("algorithm", T.ALGORITHMS["classification"])
def test_two_class_floor(two, algorithm):
    r = T.fit(two, algorithm, QUICK.get(algorithm))
    assert r.metrics["accuracy"] >= 0.92 and r.metrics["f1"] >= 0.90
    assert r.auc() > 0.95 and r.confusion().agg(F.sum("count")).first()[0] == two.test_rows


def test_boosting_of_three_classes(three):
    r = T.fit(three, "xgboost", {"n_estimators": 5, "max_depth": 3})
    assert r.metrics["accuracy"] >= 0.85 and r.auc() > 0.9 and len(r.importance) == 4


@pytest.mark.parametrize("algorithm", T.ALGORITHMS["regression"])
def test_regression_floor(line, algorithm):
    r = T.fit(line, algorithm, {**QUICK[algorithm], "n_estimators": 40} if algorithm in QUICK else None)
    assert r.metrics["r2"] >= 0.75 and r.metrics["mae"] > 0
    assert r.importance[0][0] in {"f0", "f1", "f2", "f3", "f4", "f5"}


def test_weak_signal_floor(spark):
    df = numbers_table(spark, 442, (30, 20, 20), 45)
    r = T.train(df, "target", [f"f{j}" for j in range(10)], "regression", "id", "linear_regression")
    assert 0.30 <= r.metrics["r2"] < 0.75


def test_cross_validation_floor(three):
    cv = T.fit(three, "logistic_regression", cv_folds=5).cv
    assert len(cv["scores"]) == 5 and min(cv["scores"]) >= 0.85 and cv["mean"] >= 0.90
    assert cv["mean"] == pytest.approx(np.mean(cv["scores"]), abs=1e-4) and cv["std"] == pytest.approx(np.std(cv["scores"]), abs=1e-4)


def with_gaps(spark, rows):
    df = numbers_table(spark, rows, (30, 20, 20), 45)
    return df.withColumn("f0", F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE f0 END"))


def test_linear_cv_equals_fitting_each_fold(spark):
    """Sums per fold give the scores that fitting on the other folds, with their medians, gives."""
    df = with_gaps(spark, 300)
    rows = [r.asDict() for r in df.withColumn("fold", split.fold_number(F.col("id"), 4)).collect()]
    names = [f"f{j}" for j in range(10)]
    x = np.array([[math.nan if r[f] is None else r[f] for f in names] for r in rows])
    y, fold = np.array([r["target"] for r in rows]), np.array([r["fold"] for r in rows])
    found = linear_fold_scores(df.repartition(5), "target", names, "id", 4)
    for k in range(4):
        fills = np.nanmedian(x[fold != k], axis=0)
        design = np.column_stack([np.ones(len(x)), np.where(np.isnan(x), fills, x)])
        weights = np.linalg.lstsq(design[fold != k], y[fold != k], rcond=None)[0]
        off = y[fold == k] - design[fold == k] @ weights
        r2 = 1 - (off**2).sum() / ((y[fold == k] - y[fold == k].mean()) ** 2).sum()
        assert found[k]["rows"] == (fold == k).sum()
        assert found[k]["r2"] == pytest.approx(r2, abs=1e-9) and found[k]["rmse"] == pytest.approx(np.sqrt((off**2).mean()))


def test_cross_validation_prepares_each_fold_anew(spark):
    data = T.training_set(with_gaps(spark, 300), "target", ["f0", "f1", "f2"], "regression", "id")
    one_pass = T.cross_validate(data, T.make_estimator("regression", "linear_regression", 240), 4)
    tables = T.prepared_folds(data, 4)
    each = T.cross_validate(data, T.make_estimator("regression", "linear_regression", 240), 4, prepared=tables)
    T.release(tables)
    assert np.allclose(one_pass["scores"], each["scores"], atol=1.01e-4) and len(each["scores"]) == 4


def test_no_fold_is_dropped(spark):
    rows = spark.range(100).where(split.fold_number(F.col("id"), 5) != 2).limit(8).collect()
    tiny = spark.createDataFrame([(r.id, float(i % 3), i % 2) for i, r in enumerate(rows)], "id long, x double, y int")
    data = T.training_set(tiny, "y", ["x"], "classification", "id")
    assert len(T.cross_validate(data, T.make_estimator("classification", "logistic_regression", 6), 5)["scores"]) == 5
    number = T.training_set(tiny.withColumn("y", F.col("id") * 1.5), "y", ["x"], "regression", "id")
    with pytest.raises(ValueError, match="no r2 for fold"):
        T.cross_validate(number, T.make_estimator("regression", "linear_regression", 6), 5)
    with pytest.raises(ValueError, match="need at least"):
        T.cross_validate(data, T.make_estimator("classification", "logistic_regression", 6), 9)


def test_guards(spark):
    one = spark.createDataFrame([(1, 1, 1)], "id long, x int, y int")
    single = spark.createDataFrame([(i, i, 1) for i in range(20)], "id long, x int, y int")
    few = spark.createDataFrame([(i, i, i % 2) for i in range(4)], "id long, x int, y int")
    for df in (one, single, few):
        with pytest.raises(ValueError):
            T.train(df, "y", ["x"], "classification", "id", "random_forest")
    ok = spark.createDataFrame([(i, i, i % 2) for i in range(40)], "id long, x int, y int")
    for kwargs in ({"features": []}, {"algorithm": "magic"}, {"task": "ranking"}, {"features": ["gone"]}):
        with pytest.raises(ValueError):
            T.train(**{"df": ok, "target": "y", "features": ["x"], "task": "classification", "key": "id", "algorithm": "random_forest", **kwargs})


def test_leakage_is_reported(spark):
    df = spark.range(100).select("id", noise(0, "l").alias("target"), noise(1, "l").alias("real_feature"))
    df = df.withColumn("leaky_feature", F.col("target") + 0.01 * noise(2, "l"))
    r = T.train(df, "target", ["real_feature", "leaky_feature"], "regression", "id", "linear_regression")
    assert [f for f, _ in r.data.leaky] == ["leaky_feature"]


def test_categorical_and_missing_features(spark):
    colors, sizes = ("red", "green", "blue"), ("S", "M", "L")
    df = spark.createDataFrame([(i, colors[i % 3], None if i % 20 == 0 else sizes[i % 3], i % 2) for i in range(60)], "id long, color string, size string, target int")
    r = T.train(df, "target", ["color", "size"], "classification", "id", "random_forest", QUICK["random_forest"])
    assert "accuracy" in r.metrics and r.data.preparation.categories["size"] == ["L", "M", "S", "__missing__"]
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i * 1.0, int(i > 50)) for i in range(100)], "id long, x double, y int")
    assert T.train(df, "y", ["x"], "classification", "id", "random_forest", QUICK["random_forest"]).metrics["accuracy"] > 0.8


def test_more_categories_than_tree_bins(spark):
    df = spark.createDataFrame([(i, f"c{i % 200:03d}", int(i % 200 >= 100)) for i in range(600)], "id long, c string, y int")
    assert T.train(df, "y", ["c"], "classification", "id", "random_forest", QUICK["random_forest"]).metrics["accuracy"] > 0.9
    coded = [prepare.learn_preparation(df, ["c"], listed_categories=n).transform(df).select("id", "c__num") for n in (100, 200)]
    assert coded[0].exceptAll(coded[1]).isEmpty() and coded[1].exceptAll(coded[0]).isEmpty()


def test_codes_from_a_table(spark):
    known = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("b",), ("",)] + [("hot",)] * 3000, "`c.d` string").withColumn("x", F.lit(1.0))
    stage = prepare.learn_preparation(known, ["c.d", "x"], listed_categories=2)
    rows = spark.createDataFrame([("new",), ("a",), (None,), (None,), ("é",), ("",), ("hot",), ("b",)], "`c.d` string").withColumn("x", F.lit(1.0))
    codes = [(r[0], r[1]) for r in stage.transform(rows).select("`c.d`", "__feature0__num").collect()]
    order = sorted(["b", "a", "__missing__", "é", "", "hot"])
    assert sorted(codes, key=str) == sorted([(r[0], float(order.index(r[0] or ("__missing__" if r[0] is None else ""))) if r[0] != "new" else 6.0) for r in rows.select("`c.d`").collect()], key=str)
    hot = stage.stages[1].codes.where("hot").select("text").collect()
    assert {r.text for r in hot} >= {"hot"}
    nothing = prepare.learn_preparation(known.limit(0), ["c.d", "x"], listed_categories=-1)
    assert nothing.transform(rows).select("__feature0__num").distinct().collect() == [(0.0,)]


def test_names_with_dots_train(spark):
    df = spark.range(300).select(F.col("id").alias("row.id"), F.concat(F.lit("t"), F.col("id") % 50).alias("te.xt"), F.col("id").cast("double").alias("nu.m"))
    df = df.withColumn("tar.get", F.col("`nu.m`") * 3)
    result = T.train(df, "tar.get", ["te.xt", "nu.m"], "regression", "row.id", "linear_regression", listed_categories=10, cv_folds=3)
    assert result.metrics["r2"] > 0.9999 and result.data.leaky == (("nu.m", 1.0),)
    assert {f for f, _ in result.importance} == {"te.xt", "nu.m"}


def test_frequent_values_stay_out_of_the_exchange(spark):
    """A value of a third of the rows is neither in the joined table nor a key of the join."""
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("c"))
    codes, sizes = categories.code_table(df, [F.col("c")])
    assert sizes == [6001] and [r.text for r in codes.where("hot").collect()] == ["hot"]
    joined = categories.join_codes(df, F.col("c"), codes, "code")
    assert joined.where("c = 'hot' AND code = 0").count() == 3000 and joined.select("code").distinct().count() == 6001
    encoded = prepare.label_encode(df, "c", "code", broadcast_limit=100)
    assert encoded.exceptAll(joined).isEmpty() and encoded.count() == 9000


def test_training_with_150000_categories(spark, tmp_path):
    df = spark.range(150_000).select("id", F.format_string("k%06d", "id").alias("c"), (F.col("id") * 2.0 + 1).alias("y"))
    data = T.training_set(df, "y", ["c"], "regression", "id", fit_scope="all")
    assert data.preparation.categories == {}
    result = T.fit(data, "linear_regression")
    assert result.metrics["r2"] > 0.999999
    model = T.save_model(result, str(tmp_path / "model"))
    again = T.load_model(str(tmp_path / "model"))
    one, two = (m.transform(df).select("id", "prediction") for m in (model, again))
    both = one.join(two.withColumnRenamed("prediction", "again"), "id")
    assert both.where("prediction <> again").isEmpty() and both.where("abs(prediction - (id * 2 + 1)) < 1e-3").count() == 150_000


def test_text_target_positive_class_and_dropped_rows(spark):
    df = classes_table(spark, 200, 2, 3, 3).withColumn("label", F.when(F.col("id") % 50 == 0, None).when(F.col("target") == 1, "yes").otherwise("no"))
    r = T.train(df, "label", ["x0", "x1", "x2"], "classification", "id", "logistic_regression", positive_class="no")
    assert r.data.classes == ("no", "yes") and r.data.positive == 0 and r.data.dropped_rows == 4
    assert set(x.predicted_label for x in r.scored.select("predicted_label").distinct().collect()) == {"no", "yes"}


def test_rare_class_is_split_by_share(spark):
    df = spark.range(400).withColumn("y", (F.col("id") % 20 == 0).cast("int")).withColumn("x", F.col("y") + noise(0, "s"))
    d = T.training_set(df, "y", ["x"], "classification", "id")
    assert d.imbalance["minority_pct"] == 5.0 and d.imbalance["stratified"]
    assert d.prepared.where("label = 1 AND is_test").count() == 4


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("y", F.col("id") % 3)
    runs = [
        {r.id for r in split.split_stratified(df.repartition(p), "id", "y", task_rows=0, buckets=5).where("is_test").collect()}
        for p in (1, 4, 17)
    ]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 33 * 3
    narrow = split.split_stratified(df, "id", "y", bracket=0.0).where("is_test")
    assert {r.id for r in narrow.collect()} == runs[0]
    assert sorted(r["count"] for r in split.assign_folds(df, "id").groupBy("fold").count().collect())[0] > 60


def test_saved_model_scores_the_same(two, spark, tmp_path):
    r = T.fit(two, "random_forest", QUICK["random_forest"])
    model = T.save_model(r, str(tmp_path / "m"))
    first = {x.id: x.prediction for x in model.transform(two.source).collect()}
    assert {x.id: x.prediction for x in T.load_model(str(tmp_path / "m")).transform(two.source).collect()} == first


def test_compare_report_and_diagnosis(three):
    results, failed = T.compare_all(three, QUICK)
    assert len(results) == 4 and not failed
    runs = T.run_table(results)
    assert diagnose.best_model(runs).first().test_score == max(r.test_score for r in results)
    assert runs.count() == 4 and diagnose.next_steps(runs).where("step = 'cross_validate'").count() == 4
    assert diagnose.shared_importance(T.importance_table(results)).count() > 0
    sections = {r.section for r in report.model_report(results).select("section").distinct().collect()}
    assert {"comparison", "verdict", "metrics", "train_vs_test", "importance"} <= sections


def test_tuning_and_its_limits(three):
    found = T.tune(three.source, "target", ["x0", "x1"], "classification", "logistic_regression", "id", folds=2, trials=2)
    assert found.trials.count() == 2 and found.best_score > 0.6
    draws = T.sample_hyperparams(T.SEARCH_SPACES["lightgbm"], 20)
    assert draws == T.sample_hyperparams(T.SEARCH_SPACES["lightgbm"], 20) and len(draws) == 20
    assert all(50 <= d["n_estimators"] < 300 and 0.01 <= d["learning_rate"] <= 0.31 for d in draws)
    with pytest.raises(ValueError):
        T.tune(three.source, "target", ["x0"], "classification", "linear_regression", "id")


class Try:
    def __init__(self, test_score, gap):
        self.test_score, self.gap = test_score, gap


def test_regularizing_stops_when_resolved_or_worse():
    levels = [(str(i), {}) for i in range(4)]

    def walk(*tries):
        it = iter(tries)
        return T.walk_levels(0.80, 0.20, levels, lambda name, h: next(it))

    done = walk(Try(0.79, 0.12), Try(0.78, 0.04))
    assert len(done.attempts) == 2 and done.chosen.gap == 0.04 and done.resolved and done.improved
    worse = walk(Try(0.79, 0.12), Try(0.79, 0.15))
    assert len(worse.attempts) == 2 and worse.chosen.gap == 0.12 and not worse.resolved
    lost = walk(Try(0.5, 0.10), Try(0.5, 0.09), Try(0.5, 0.08), Try(0.5, 0.07))
    assert not lost.improved and lost.chosen.gap == 0.10
    assert T.walk_levels(0.8, 0.2, [], None).chosen is None


def test_algorithm_choice():
    pick = prepare.choose_algorithm
    assert pick("classification", 20_000) == "lightgbm" and pick("regression", 2_000) == "random_forest"
    assert pick("classification", 100, 10, 6) == "random_forest" and pick("classification", 100, 10, 5) == "logistic_regression"
    assert pick("regression", 10) == "linear_regression" and pick("clustering", 9) == "dbscan" and pick("clustering", 9, clusters=4) == "kmeans"


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.25, 0.0, 0.0, 0.0)
    grid = {(r.actual, r.predicted): r["count"] for r in metrics.confusion_matrix(df.where("y = 1"), "y", "p", [0, 1, 2]).collect()}
    assert len(grid) == 9 and grid[1, 0] == 2 and grid[2, 2] == 0
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first().r2 == 1.0


@pytest.mark.parametrize("options", [{}, {"task_rows": 0, "buckets": 6}])
def test_roc_equals_pair_counting(spark, options):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    expected = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, F.col("y") == 1, F.col("s"), places=9, **options).first().auc == pytest.approx(expected)
    curve = metrics.roc_curve(df, F.col("y") == 1, F.col("s"), **options).orderBy("ord").collect()
    assert (curve[0].fpr, curve[0].tpr) == (0.0, 0.0) and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)
    assert len(curve) == len(set(s)) + 1


def test_auc_without_one_side_is_unknown(spark):
    df = spark.createDataFrame([(1, 0.5)], "y int, s double")
    assert metrics.roc_auc(df, F.col("y") == 1, F.col("s")).first().auc is None


def brute_force(points, eps, least):
    near = ((points[:, None] - points[None]) ** 2).sum(2) <= eps * eps
    core, labels, found = near.sum(1) >= least, -np.ones(len(points), int), 0
    for i in range(len(points)):
        if labels[i] == -1 and core[i]:
            labels[i], stack = found, [i]
            while stack:
                j = stack.pop()
                for k in np.where(near[j])[0] if core[j] else ():
                    if labels[k] == -1:
                        labels[k] = found
                        stack.append(k)
            found += 1
    return core, labels


@pytest.mark.parametrize("shape", ["even", "crowded", "apart", "four"])
def test_dbscan_equals_brute_force(spark, monkeypatch, shape):
    rng = np.random.default_rng(7)
    if shape == "even":
        points, eps, least = rng.uniform(0, 5, (250, 2)), 0.35, 5
    elif shape == "crowded":
        points, eps, least = np.vstack([rng.normal(c, 0.05, (90, 2)) for c in (0, 0.3, 2)]), 0.06, 4
        monkeypatch.setattr(density, "HOT_POINTS", 5)
    elif shape == "apart":
        points, eps, least = np.vstack([rng.uniform(0, 0.6, (150, 2)), rng.uniform(0, 0.6, (150, 2)) + [1.55, 0]]), 1.0, 5
    else:
        points, eps, least = rng.uniform(0, 2, (120, 4)), 0.6, 4
    core, labels = brute_force(points, eps, least)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, point array<double>")
    assert {r.id: r.cluster for r in density.dbscan(df, "id", eps, least).collect()} == dict(enumerate(labels.tolist()))
    assert dict(density.core_points(df, "id", eps, least).collect()) == dict(enumerate(core.tolist()))


def test_connected_parts_of_a_long_chain(spark):
    nodes = spark.range(40).selectExpr("id AS node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(31, 39)], "a long, b long")
    got = dict(density.connected(nodes, edges).collect())
    assert all(got[i] == 0 for i in range(30)) and got[30] == 30 and got[39] == 31


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(c, 0.2, (40, 3)) for c in (0, 3, 6)])
    return spark.createDataFrame([(i, p.tolist(), i // 40) for i, p in enumerate(points)], "id long, point array<double>, truth int")


def test_kmeans_and_ward_find_the_blobs(blobs):
    model = C.kmeans(blobs, 3, restarts=3)
    found = C.assign_nearest(blobs, [c.tolist() for c in model.clusterCenters()])
    for labels in (found, C.hierarchical(blobs, 3), C.hierarchical(blobs, 3, micro=20, exact=0)):
        assert labels.select("truth", "cluster").distinct().count() == 3
    assert C.silhouette_sq(found).first()[0] > 0.9


def plain_ward(points, weights, k):
    """Merge the cheapest of all pairs until k groups are left."""
    groups = [([i], p, w) for i, (p, w) in enumerate(zip(points, weights))]
    while len(groups) > k:
        at, w = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
        cost = ((at[:, None] - at[None]) ** 2).sum(2) * (w[:, None] * w / (w[:, None] + w))
        cost[np.tril_indices(len(groups))] = np.inf
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        both = (groups[a][0] + groups[b][0], (groups[a][1] * w[a] + groups[b][1] * w[b]) / (w[a] + w[b]), w[a] + w[b])
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [both]
    return {frozenset(g[0]) for g in groups}


@pytest.mark.parametrize("k", [1, 2, 7, 60, 119, 120])
def test_ward_equals_merging_the_cheapest_pair(k):
    rng = np.random.default_rng(k)
    points, weights = rng.normal(size=(120, 3)), rng.integers(1, 9, 120)
    groups = C.ward_groups(points, weights, k)
    assert sorted(set(groups)) == list(range(k))
    assert {frozenset(i for i, g in enumerate(groups) if g == n) for n in range(k)} == plain_ward(points, weights, k)


def test_ward_of_rows_counts_repeated_points(spark):
    rng = np.random.default_rng(5)
    distinct = rng.normal(size=(150, 2)).round(3)
    rows = [(i, distinct[i % 150 if i < 300 else i % 7].tolist()) for i in range(500)]
    weights = [sum(r[1] == p.tolist() for r in rows) for p in distinct]
    labels = C.hierarchical(spark.createDataFrame(rows, "id long, point array<double>"), 6).collect()
    groups = plain_ward(distinct, weights, 6)
    found = {frozenset(r.id % 150 if r.id < 300 else r.id % 7 for r in labels if r.cluster == n) for n in range(6)}
    assert len(labels) == 500 and found == groups


def test_many_ward_groups_need_no_matrix():
    rng = np.random.default_rng(9)
    assert len(set(C.ward_groups(rng.normal(size=(4000, 8)), np.ones(4000), 1000))) == 1000


def test_silhouettes_equal_brute_force(blobs):
    noisy = blobs.withColumn("cluster", F.when(F.col("id") % 10 == 0, 2).otherwise(F.col("truth")))
    noisy = noisy.withColumn("cluster", F.when(F.col("id") == 5, -1).otherwise(F.col("cluster")))
    rows = noisy.collect()
    points, labels = np.array([r.point for r in rows]), np.array([r.cluster for r in rows])

    def mean(distance):
        total = 0.0
        for i, own in enumerate(labels):
            if (labels == own).sum() > 1:
                a = distance[i][labels == own].sum() / ((labels == own).sum() - 1)
                b = min(distance[i][labels == c].mean() for c in set(labels) if c != own)
                total += (b - a) / max(a, b)
        return total / len(labels)

    square = ((points[:, None] - points[None]) ** 2).sum(2)
    assert C.silhouette_sq(noisy, places=9).first()[0] == pytest.approx(mean(square))
    # Cluster means in several values give the same.
    several = C.silhouette_rows(noisy, at_once=1).agg(F.avg("silhouette")).first()[0]
    assert several == pytest.approx(mean(square))


def test_cluster_call_profile_and_projection(spark, blobs):
    df = blobs.select("id", *[F.col("point")[j].alias(f"x{j}") for j in range(3)], F.when(F.col("truth") > 0, "far").otherwise("near").alias("kind"))
    found = C.cluster(df, ["x0", "x1", "x2"], "id", "kmeans", 3)
    assert found.n_clusters == 3 and found.silhouette_sq > 0.8
    labelled = df.join(found.labels.select("id", "cluster"), "id")
    profile = C.cluster_profile(labelled, "cluster", ["x0", "kind"])
    assert profile.count() == 6 and {r.side for r in profile.where("feature = 'x0'").collect()} >= {"higher", "lower"}
    sides = C.describe_clusters(profile).collect()
    assert len(sides) == 3 and any(r.higher == ["x0"] for r in sides)
    flat = C.project_2d(found.labels, "id", most=50, extra=["cluster"])
    assert flat.points.count() == 60 and flat.explained[0] > 0.9
    assert C.cluster(df, ["x0", "x1"], "id", "dbscan", eps=0.5, min_samples=4).n_clusters == 3
    with pytest.raises(ValueError):
        C.cluster(df, ["x0"], "id", "magic")


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = C.scale_columns(df, ["a", "b"]).collect()
    assert [r.a_scaled for r in got] == [-1.0, 1.0] and [r.b_scaled for r in got] == [0.0, 0.0]


def test_sampled_shapley_adds_up(two):
    r = T.fit(two, "random_forest", QUICK["random_forest"])
    found = explain.explain(r, 4, permutations=3, background=3)
    sums = {x.id: x.s for x in found.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    assert len(sums) == 4 and found.count() == 4 * 12
    pool = explain.background_rows(r, 3)
    scored = r.estimator_model.transform(two.prepared.sparkSession.createDataFrame([(i, b) for i, b in enumerate(pool)], "i int, v array<double>").select(explain.array_to_vector("v").alias("features")))
    base = np.mean([x.probability[1] for x in scored.collect()])
    for x in r.test_side.where(F.col("id").isin(list(sums))).collect():
        assert sums[x.id] == pytest.approx(x.probability[1] - base, abs=1e-9)


def test_sampled_shapley_of_a_linear_model_is_its_closed_form(line):
    r = T.fit(line, "linear_regression")
    closed = {(x.id, x.feature): x.contribution for x in explain.explain(r, 3).collect()}
    pool = explain.background_rows(r, 5)
    sampled = explain.sampled_shapley(r.test_side.orderBy("id").limit(3), "id", r.estimator_model, pool, line.features, F.col("prediction"), 2).collect()
    means, train = np.mean(pool, axis=0), line.train_side
    overall = np.mean([v.features.toArray() for v in train.select("features").collect()], axis=0)
    for x in sampled:
        j = line.features.index(x.feature)
        shift = r.estimator_model.coefficients[j] * (overall[j] - means[j])
        assert x.contribution == pytest.approx(closed[x.id, x.feature] + shift, abs=1e-8)


def test_explained_predictions_and_pushers(three):
    r = T.fit(three, "random_forest", QUICK["random_forest"])
    found = explain.explain(r, 3, permutations=2, background=2)
    shown = explain.explained_predictions(r, found, 2)
    assert shown.count() == 6 and {x.predicted for x in shown.collect()} <= {"0", "1", "2"}
    assert explain.push_pull(found, "id").where("rank > 2").count() == 0


def test_ward_of_many_clusters(spark):
    points = spark.range(1000).select("id", F.array(F.col("id") * 1.0, (F.col("id") % 7) * 1.0).alias("point"))
    assert C.hierarchical(points, 300).select("cluster").distinct().count() == 300


def test_metrics_without_some_labels(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", None), (None, "b"), (None, None), ("b", "c")]
    r = metrics.classification_metrics(spark.createDataFrame(rows, "y string, p string"), "y", "p").first()
    assert (r.rows, r.accuracy, r.precision, r.recall) == (5, 0.4, 0.5, round(1 / 3, 4))


def test_test_side_is_never_empty(spark):
    df = spark.createDataFrame([(600 + i, float(i)) for i in range(6)], "id long, x double")
    sided = split.both_sides(split.split_holdout(df, "id"), "id").groupBy("is_test").count().collect()
    assert {r.is_test: r["count"] for r in sided} == {True: 1, False: 5}


def test_failing_level_is_passed_over():
    from types import SimpleNamespace

    from gristmill.modelling.train import walk_levels

    def attempt(name, hyperparams):
        if name == "bad":
            raise ValueError("does not fit")
        return SimpleNamespace(test_score=0.9, gap=0.01)

    found = walk_levels(0.9, 0.3, [("bad", {}), ("good", {})], attempt)
    assert found.chosen.gap == 0.01 and [n for n, _ in found.failed] == ["bad"]
