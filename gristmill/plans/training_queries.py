"""Registered queries that train, cluster, explain and export models on whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..modelling import cluster as C
from ..modelling import density, diagnose, explain
from ..modelling import metrics as M
from ..modelling import prepare
from ..modelling import report as R
from ..modelling import split as S
from ..modelling import train as T
from ..modelling.linear_cv import linear_cv
from ..modelling.tree_attribution import flat_trees, tree_output
from ..session import ensure_checkpoint_dir, free_files
from ..sources import tables as sources
from .model_queries import hash_sql
from .tables import events, events_sql, rounded, table


# Inputs ----------------------------------------------------------------------------------


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with measures of the document texts."""
    documents = table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size(F.split("text", r"\s+")).alias("n_words"),
        F.size(F.split("text", "\n")).alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^0-9]+", "")).alias("n_digits"),
        F.length(F.regexp_replace("text", r"[^.,;:!?]+", "")).alias("n_marks"),
    )
    return table(spark, folder, "labels").join(documents, "doc_id")


DOCUMENT_FEATURES = ("lang", "source", "n_chars", "n_words", "n_lines", "n_digits", "n_marks")
PRICE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_suppkey", "l_returnflag")


def price_lines(spark, folder) -> DataFrame:
    """Order lines with one key per row."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, folder, "lineitem").select(line.alias("line"), "l_extendedprice", *PRICE_FEATURES)


def wide_lines(spark, folder) -> DataFrame:
    """Order lines with text features of many values; a seventh of the parts is missing."""
    part = F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("part "), F.col("l_partkey")))
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line")
    order = F.concat(F.lit("order "), F.col("l_orderkey"))
    return table(spark, folder, "lineitem").select(line, part.alias("part"), order.alias("order_text"), "l_quantity", "l_extendedprice")


def banded_lines(spark, folder) -> DataFrame:
    """Order lines with two targets that quantity and tax decide: a band, and their product."""
    heavy, taxed = F.col("l_quantity") > 25, F.col("l_tax") > 0.045
    band = F.when(heavy & taxed, "both").when(heavy, "heavy").when(taxed, "taxed").otherwise("neither")
    lines = table(spark, folder, "lineitem")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line")
    product = (F.col("l_quantity") * F.col("l_tax")).alias("product")
    return lines.select(line, "l_quantity", "l_tax", "l_discount", "l_returnflag", band.alias("band"), product)


BAND_FEATURES = ("l_quantity", "l_tax", "l_discount", "l_returnflag")


def _documents(spark, folder, target: str = "quality") -> T.TrainingSet:
    return T.training_set(labelled_documents(spark, folder), target, DOCUMENT_FEATURES, "classification", "doc_id")


def _prices(spark, folder) -> T.TrainingSet:
    return T.training_set(price_lines(spark, folder), "l_extendedprice", PRICE_FEATURES, "regression", "line")


def _orders(spark, folder) -> T.TrainingSet:
    df = table(spark, folder, "orders")
    features = ("o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey")
    return T.training_set(df, "o_orderstatus", features, "classification", "o_orderkey")


# Small enough to train in seconds on the test tables; any value can be given.
QUICK_FOREST = {"n_estimators": 20, "max_depth": 6, "min_samples_split": 4}
QUICK_BOOST = {"n_estimators": 10, "max_depth": 4}


# Preparation -----------------------------------------------------------------------------


def wide_category_codes(spark, folder):
    """Codes of two text features of many values, learned from the training side and joined to all lines."""
    sided = S.split_holdout(wide_lines(spark, folder), "line")
    learned = prepare.learn_preparation(sided.where(~F.col("is_test")), ["part", "order_text"], listed_categories=100)
    codes = [F.col(f"{f}__num").cast("bigint").alias(f"{f}_code") for f in ("part", "order_text")]
    return learned.transform(sided).select("line", "is_test", *codes)


# Training --------------------------------------------------------------------------------
#
# Learned numbers differ between libraries, so these queries return facts that SQL can state: exact
# sides of the split, and whether scores lie where they must. The numbers themselves are tested in tests/.


def _facts(spark, results, floor: float | None = None) -> DataFrame:
    """Sizes of both sides per run, whether all metrics are possible, and whether the main one is above a floor."""
    rows = []
    for result in results:
        m = result.metrics
        possible = all(0 <= v <= 1 for v in m.values()) if result.data.classes else m["r2"] <= 1 and m["mae"] <= m["rmse"]
        rows.append((result.algorithm, result.data.train_rows, result.data.test_rows, possible, floor is None or result.test_score >= floor))
    return spark.createDataFrame(rows, "algorithm string, train_rows bigint, test_rows bigint, possible boolean, above_floor boolean")


def train_rf_class(spark, folder):
    return _facts(spark, [T.fit(_orders(spark, folder), "random_forest", QUICK_FOREST)])


def train_rf_reg(spark, folder):
    return _facts(spark, [T.fit(_prices(spark, folder), "random_forest", QUICK_FOREST)])


def train_logreg(spark, folder):
    return _facts(spark, [T.fit(_documents(spark, folder), "logistic_regression")], 0.8)


def train_gbt_class(spark, folder):
    return _facts(spark, [T.fit(_documents(spark, folder), "xgboost", QUICK_BOOST)], 0.85)


def train_gbt_multiclass(spark, folder):
    """One boosted model per class."""
    return _facts(spark, [T.fit(_orders(spark, folder), "lightgbm", {"n_estimators": 3, "num_leaves": 8})])


def train_gbt_reg(spark, folder):
    return _facts(spark, [T.fit(_prices(spark, folder), "lightgbm", {"n_estimators": 10, "num_leaves": 16})])


def learned_bands(spark, folder):
    """The class that each kind of tree model predicts for every line of the test side, which is the line's own."""
    data = T.training_set(banded_lines(spark, folder), "band", BAND_FEATURES, "classification", "line")
    found = []
    for algorithm, hyperparams in (("random_forest", QUICK_FOREST), ("xgboost", QUICK_BOOST), ("lightgbm", QUICK_BOOST)):
        scored = T.fit(data, algorithm, hyperparams).test_side
        found.append(scored.select("line", F.lit(algorithm).alias("algorithm"), "predicted_label"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def learned_product(spark, folder):
    """Boosting at its default settings, a forest and a linear model explain three quarters of a product's variance and more."""
    data = T.training_set(banded_lines(spark, folder), "product", BAND_FEATURES, "regression", "line")
    return _facts(spark, [T.fit(data, a, QUICK_FOREST if a == "random_forest" else None) for a in T.ALGORITHMS["regression"]], 0.75)


def linreg_1d(spark, folder):
    """Slope, intercept and quality of a one-feature model, learned on the training side."""
    lines = price_lines(spark, folder).select("line", "l_quantity", F.col("l_extendedprice").alias("label"))
    sided = S.split_holdout(lines, "line")
    assembled = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(sided)
    model = LinearRegression(solver="normal", regParam=0.0).fit(assembled.where(~F.col("is_test")))
    scored = M.regression_metrics(model.transform(assembled), "label", "prediction", ["is_test"], 3)
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    return scored.select("*", F.round(F.lit(slope), 3).alias("slope"), F.round(F.lit(intercept), 3).alias("intercept"))


def train_cv(spark, folder):
    result = T.fit(_prices(spark, folder), "linear_regression", cv_folds=5)
    scores = result.cv["scores"]
    mean = sum(scores) / len(scores)
    rows = [(i, s <= 1, abs(result.cv["mean"] - mean) < 1e-3) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "fold int, possible boolean, mean_fits boolean")


def cv_linear(spark, folder):
    """Scores per fold of a model of one column with missing values, which take the median of the other folds."""
    quantity = F.expr("CASE WHEN l_quantity % 10 = 3 THEN NULL ELSE l_quantity END").alias("quantity")
    lines = price_lines(spark, folder).select("line", quantity, "l_extendedprice")
    return rounded(linear_cv(lines, "l_extendedprice", ["quantity"], "line"), 6)


def compare_all(spark, folder):
    data = _documents(spark, folder)
    results, _ = T.compare_all(data, {"random_forest": QUICK_FOREST, "xgboost": QUICK_BOOST, "lightgbm": {"n_estimators": 10, "num_leaves": 8}})
    return _facts(spark, results, 0.8)


def tune(spark, folder):
    found = T.tune(labelled_documents(spark, folder), "quality", DOCUMENT_FEATURES, "classification", "logistic_regression", "doc_id", folds=3, trials=5)
    trials = found.trials.orderBy("rank").collect()
    in_order = all(a.score >= b.score for a, b in zip(trials, trials[1:]))
    different = len({tuple(sorted(t.hyperparams.items())) for t in trials}) == len(trials)
    return spark.createDataFrame([(len(trials), in_order, different)], "trials bigint, in_order boolean, different boolean")


def auto_regularize(spark, folder):
    """Levels of a forest that has learned its training rows by heart."""
    deep = T.fit(_documents(spark, folder), "random_forest", {"n_estimators": 20, "max_depth": 15})
    levels = [(name, {**h, "n_estimators": 20}) for name, h in T.REGULARIZATION_LEVELS["random_forest"]]
    walked = T.auto_regularize(deep, levels)
    chosen = sum(r is walked.chosen for _, r in walked.attempts)
    in_order = [name for name, _ in walked.attempts] == [name for name, _ in levels][: len(walked.attempts)]
    narrower = walked.chosen.gap <= deep.gap
    return spark.createDataFrame([(chosen, in_order, narrower, len(walked.failed))], "chosen bigint, in_order boolean, narrower boolean, failed bigint")


def drop_low_importance(spark, folder):
    full = T.fit(_prices(spark, folder), "random_forest", QUICK_FOREST, run="full")
    lean = T.drop_low_importance(full, run="lean")
    kept = set(lean.data.features)
    weakest = min(dict(full.importance)[f] for f in kept)
    dropped = [v for f, v in full.importance if f not in kept]
    fits = kept <= set(full.data.features) and all(v <= weakest for v in dropped)
    sizes = (lean.data.train_rows, lean.data.test_rows)
    return spark.createDataFrame([(fits, *sizes)], "weakest_dropped boolean, train_rows bigint, test_rows bigint")


def retrain_diff(spark, folder):
    old = T.fit(_documents(spark, folder), "random_forest", QUICK_FOREST, run="forest")
    new = T.renamed(T.retrain(old, max_depth=3), "forest")
    diff = diagnose.metric_diff(T.metric_table([old]), T.metric_table([new]), ["run"], ["accuracy", "precision", "recall", "f1"])
    fits = F.abs(F.col("new_value") - F.col("old_value") - F.col("change")) < 1e-6
    return diff.select("run", "metric", fits.alias("change_fits"), (F.col("better") == (F.col("change") > 0)).alias("better_fits"))


def feature_importance(spark, folder):
    importance = dict(T.fit(_prices(spark, folder), "random_forest", QUICK_FOREST).importance)
    whole = abs(sum(importance.values()) - 1) < 1e-2
    rows = [(f, v >= 0, whole) for f, v in importance.items()]
    return spark.createDataFrame(rows, "feature string, positive boolean, sums_to_one boolean")


def confusion_of_model(spark, folder):
    cells = T.fit(_orders(spark, folder), "random_forest", QUICK_FOREST).confusion()
    return cells.groupBy("actual").agg(F.sum("count").alias("rows"), F.count("*").alias("columns"))


def roc_of_model(spark, folder):
    points = [(r.fpr, r.tpr) for r in T.fit(_documents(spark, folder), "logistic_regression").roc().orderBy("ord").collect()]
    rising = all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(points, points[1:]))
    row = (points[0] == (0.0, 0.0), rising, all(0 <= x <= 1 and 0 <= y <= 1 for x, y in points))
    return spark.createDataFrame([row], "from_origin boolean, rising boolean, inside boolean")


# Export ----------------------------------------------------------------------------------


def predictions_export(spark, folder):
    """Test predictions written and read back."""
    result = T.fit(_documents(spark, folder), "logistic_regression")
    path = f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    sources.write_table(sources.prediction_table(result.test_side, "doc_id"), path)
    back = sources.load_parquet(spark, path)
    return back.select("doc_id", F.col("prediction").isin(0.0, 1.0).alias("of_a_class"))


def model_export(spark, folder):
    """A saved model, read back, scores all rows as it did before: 0 rows differ."""
    result = T.fit(_prices(spark, folder), "linear_regression")
    return _saved_and_read(spark, result, price_lines(spark, folder))


def wide_model_export(spark, folder):
    """The same of a model over text features whose code table is saved with it."""
    features = ("part", "order_text", "l_quantity")
    data = T.training_set(wide_lines(spark, folder), "l_extendedprice", features, "regression", "line", listed_categories=100)
    result = T.only_model(T.fit(data, "linear_regression"))
    # Rows are exchanged for every feature, so the training set's files go before those of scoring come.
    del data
    return _saved_and_read(spark, result, wide_lines(spark, folder))


def _saved_and_read(spark, result, df):
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    free_files(spark)
    model = T.save_model(result, path)
    free_files(spark)
    again = T.load_model(path)
    both = model.transform(df).select(*result.data.features, F.col("prediction").alias("first"))
    scored = again.transform(both)
    return scored.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("first") - F.col("prediction")) > 1e-9).alias("different"))


# Clustering ------------------------------------------------------------------------------


def vectors(spark, folder) -> DataFrame:
    point = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", point.alias("point"), "label")


CUSTOMER_FEATURES = ("c_acctbal", "c_nationkey")


def customer_points(spark, folder) -> DataFrame:
    df = C.scale_columns(table(spark, folder, "customer"), CUSTOMER_FEATURES, "_s")
    return df.select("c_custkey", F.array("c_acctbal_s", "c_nationkey_s").alias("point"))


def scale_features(spark, folder):
    df = events(spark, folder, "event_id", "value", "user_id", "const")
    return rounded(C.scale_columns(df, ["value", "user_id", "const"]))


def kmeans_assign(spark, folder):
    """Each vector to the nearest of the label centers."""
    points = vectors(spark, folder)
    means = points.select("label", F.posexplode("point").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("c")).orderBy("label").collect()
    return C.assign_nearest(points, [[e.m for e in r.c] for r in rows]).select("vec_id", "cluster")


def kmeans_clusters(spark, folder):
    found = C.cluster(table(spark, folder, "customer"), ["c_acctbal", "c_nationkey", "c_mktsegment"], "c_custkey", "kmeans", 4)
    sizes = C.cluster_sizes(found.labels).agg(F.sum("size").alias("rows"), F.count("*").alias("clusters"), F.min("size").alias("least"))
    return sizes.select("rows", "clusters", (F.col("least") > 0).alias("none_empty"), F.lit(-1 <= found.silhouette_sq <= 1).alias("possible"))


def hierarchical_clusters(spark, folder):
    points = vectors(spark, folder).select("vec_id", "point")
    sizes = C.cluster_sizes(C.hierarchical(points, 4))
    return sizes.agg(F.sum("size").alias("rows"), F.count("*").alias("clusters"), F.max("n_clusters").alias("n_clusters"))


def dbscan_core_points(spark, folder):
    return density.core_points(customer_points(spark, folder), "c_custkey", 0.1, 5)


def dbscan_labels(spark, folder):
    """Core points with the least core point of their cluster, which no numbering of clusters changes."""
    points = customer_points(spark, folder)
    cores = density.core_points(points, "c_custkey", 0.1, 5).where("core").select("c_custkey")
    labels = density.dbscan(points, "c_custkey", 0.1, 5).join(cores, "c_custkey").select("c_custkey", "cluster")
    least = labels.groupBy("cluster").agg(F.min("c_custkey").alias("least"))
    return labels.join(least, "cluster").select("c_custkey", "least")


def cluster_sizes(spark, folder):
    labels = vectors(spark, folder).select((F.col("label") - 1).alias("cluster"))
    return C.cluster_sizes(labels)


def silhouette(spark, folder):
    return C.silhouette_sq(vectors(spark, folder), "label", 6)


def cluster_profile(spark, folder):
    df = table(spark, folder, "customer").withColumn("cluster", F.col("c_nationkey") % 4 - 1)
    return rounded(C.cluster_profile(df, "cluster", ["c_acctbal", "c_nationkey", "c_mktsegment"]))


def projection_2d(spark, folder):
    df = vectors(spark, folder)
    view = C.project_2d(df, "vec_id", extra=["label"])
    apart = view.points.agg(F.abs(F.corr("x", "y")) < 0.2).scalar()
    return view.points.select("vec_id", "position", "label", F.lit(view.explained[0] >= view.explained[1] > 0).alias("in_order"), apart.alias("uncorrelated"))


# Explanation -----------------------------------------------------------------------------

COEFFICIENTS = {"value": 0.4, "user_id": -0.02, "signed": 0.2, "flag01": 3.0}


def _attributions(spark, folder):
    return explain.linear_attribution(events(spark, folder, "event_id", *COEFFICIENTS), "event_id", COEFFICIENTS)


def linear_attribution(spark, folder):
    return rounded(_attributions(spark, folder))


def top_contributions(spark, folder):
    return rounded(explain.top_contributions(_attributions(spark, folder), "event_id", 10))


def push_pull(spark, folder):
    return rounded(explain.push_pull(_attributions(spark, folder), "event_id", 2))


def tree_attribution(spark, folder):
    result = T.fit(_documents(spark, folder), "random_forest", QUICK_FOREST)
    found = explain.explain(result, None, permutations=4, background=4)
    return explain.explained_predictions(result, found, 5)


def tree_additivity(spark, folder):
    """Whether the contributions of every test document add up to its probability less the background's mean."""
    result = T.fit(_documents(spark, folder), "random_forest", QUICK_FOREST)
    pool = explain.background_rows(result)
    trees = flat_trees(result.estimator_model, spark)
    base = float(sum(tree_output(t, np.array(pool))[:, 1] for t in trees).mean())
    sums = explain.explain(result, None).groupBy("doc_id").agg(F.sum("contribution").alias("total"), F.count("*").alias("n"))
    scored = result.test_side.select("doc_id", vector_to_array("probability")[1].alias("p"))
    adds_up = F.abs(F.col("total") - (F.col("p") - F.lit(base))) < 1e-9
    return scored.join(sums, "doc_id").select("doc_id", (adds_up & (F.col("n") == len(result.data.features))).alias("adds_up"))


def model_report(spark, folder):
    data = _documents(spark, folder)
    forest = T.fit(data, "random_forest", QUICK_FOREST)
    linear = T.fit(data, "logistic_regression", cv_folds=3)
    shown = explain.top_contributions(explain.explain(linear, 3), "doc_id")
    return R.model_report([forest, linear], {"logistic_regression": shown})


# Checks ----------------------------------------------------------------------------------

_LINES_SQL = "(SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, l_quantity AS x, l_extendedprice AS y FROM lineitem)"
_LINREG_SQL = f"""
WITH e AS (SELECT *, {hash_sql('line')} % 100 < 20 AS is_test FROM {_LINES_SQL}),
m AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM e WHERE NOT is_test),
s AS (SELECT is_test, y, y - (slope * x + intercept) AS r, slope, intercept FROM e, m)
SELECT is_test, count(*) AS rows, round(1 - sum(r * r) / (var_pop(y) * count(*)), 3) AS r2, round(avg(abs(r)), 3) AS mae,
       round(sqrt(avg(r * r)), 3) AS rmse, round(max(slope), 3) AS slope, round(max(intercept), 3) AS intercept
FROM s GROUP BY is_test
"""

_WIDE_CODES_SQL = f"""
WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line,
       CASE WHEN l_partkey % 7 = 0 THEN '__missing__' ELSE 'part ' || l_partkey END AS part, 'order ' || l_orderkey AS order_text FROM lineitem),
e AS (SELECT *, {hash_sql('line')} % 100 < 20 AS is_test FROM l),
p AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS code FROM (SELECT DISTINCT part FROM e WHERE NOT is_test)),
o AS (SELECT order_text, row_number() OVER (ORDER BY order_text) - 1 AS code FROM (SELECT DISTINCT order_text FROM e WHERE NOT is_test))
SELECT line, is_test, coalesce(p.code, (SELECT count(*) FROM p)) AS part_code, coalesce(o.code, (SELECT count(*) FROM o)) AS order_text_code
FROM e LEFT JOIN p USING (part) LEFT JOIN o USING (order_text)
"""

_LEARNED_BANDS_SQL = f"""
WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, l_quantity > 25 AS heavy, l_tax > 0.045 AS taxed FROM lineitem)
SELECT line, algorithm, CASE WHEN heavy AND taxed THEN 'both' WHEN heavy THEN 'heavy' WHEN taxed THEN 'taxed' ELSE 'neither' END AS predicted_label
FROM l, (SELECT unnest(['random_forest', 'xgboost', 'lightgbm']) AS algorithm) WHERE {hash_sql('line')} % 100 < 20
"""

_DOCUMENTS_SQL = """
d AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY quality),
z AS (SELECT CAST(sum(floor(n * 0.2 + 0.5)) AS BIGINT) AS test_rows, CAST(sum(n) AS BIGINT) AS rows FROM d)
"""
_SIDES_SQL = "z AS (SELECT count(*) FILTER (WHERE {flag}) AS test_rows, count(*) AS rows FROM {source})"
_ORDER_SIDES_SQL = _SIDES_SQL.format(flag=f"{hash_sql('o_orderkey')} % 100 < 20", source="orders")
_CV_LINEAR_SQL = f"""
WITH p AS (SELECT {hash_sql('line', 'fold42')} % 5 AS fold, y, CASE WHEN x % 10 = 3 THEN NULL ELSE x END AS x FROM {_LINES_SQL}),
k AS (SELECT unnest(range(5)) AS k),
m AS (SELECT k, median(x) AS fill FROM k JOIN p ON fold <> k GROUP BY k),
z AS (SELECT k, fold, y, coalesce(x, fill) AS x FROM p, m),
c AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM z WHERE fold <> k GROUP BY k),
o AS (SELECT z.k, y, a + b * x AS fitted, avg(y) OVER (PARTITION BY z.k) AS mean FROM z JOIN c ON c.k = z.k WHERE fold = z.k)
SELECT CAST(k AS INTEGER) AS fold, count(*) AS rows, round(1 - sum((y - fitted) * (y - fitted)) / sum((y - mean) * (y - mean)), 6) AS r2,
       round(sqrt(avg((y - fitted) * (y - fitted))), 6) AS rmse FROM o GROUP BY k
"""
_PRICE_SIDES_SQL = _SIDES_SQL.format(flag=f"{hash_sql('line')} % 100 < 20", source=_LINES_SQL)


def _facts_sql(sides: str, *algorithms: str) -> str:
    return f"WITH {sides} " + " UNION ALL ".join(
        f"SELECT '{a}' AS algorithm, rows - test_rows AS train_rows, test_rows, true AS possible, true AS above_floor FROM z" for a in algorithms
    )


_TEST_DOCUMENTS_SQL = f"""
WITH e AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {hash_sql('doc_id', digits=13)}) AS place, count(*) OVER (PARTITION BY quality) AS n
           FROM labels JOIN documents USING (doc_id))
SELECT doc_id, true AS of_a_class FROM e WHERE place <= floor(n * 0.2 + 0.5)
"""
_DBSCAN_SQL = """
WITH RECURSIVE p AS {points},
near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 5),
e AS (SELECT a, b FROM near WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
r(k, least) AS (SELECT k, k FROM core UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.k WHERE r.least < e.b)
SELECT k AS c_custkey, min(least) AS least FROM r GROUP BY k
"""

_SCALED_SQL = ", ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 6) AS {c}_scaled"
    for c in ("value", "user_id", "const")
)

_CUSTOMER_SQL = (
    "(SELECT c_custkey AS k, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, "
    "(c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer)"
)

_FLAT_SQL = "(SELECT vec_id, label, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_ASSIGN_SQL = f"""
WITH f AS {_FLAT_SQL},
c AS (SELECT label, j, avg(x) AS m FROM f GROUP BY label, j),
d AS (SELECT f.vec_id, c.label, sum((f.x - c.m) * (f.x - c.m)) AS d FROM f JOIN c USING (j) GROUP BY f.vec_id, c.label)
SELECT vec_id, CAST(arg_min(label, d) AS INTEGER) AS cluster FROM d GROUP BY vec_id
"""

_SILHOUETTE_SQL = f"""
WITH f AS {_FLAT_SQL},
p AS (SELECT a.vec_id, a.label AS own, b.label AS other, b.vec_id AS o, sum((a.x - b.x) * (a.x - b.x)) AS d
      FROM f a JOIN f b USING (j) GROUP BY a.vec_id, a.label, b.label, b.vec_id),
m AS (SELECT vec_id, own, other, CASE WHEN own = other THEN sum(d) / nullif(count(*) - 1, 0) ELSE avg(d) END AS d FROM p GROUP BY vec_id, own, other),
s AS (SELECT vec_id, max(d) FILTER (WHERE own = other) AS a, min(d) FILTER (WHERE own <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sq FROM s
"""

_PROFILE_SQL = """
WITH e AS (SELECT c_nationkey % 4 - 1 AS cluster, * FROM customer),
g AS (SELECT avg(c_acctbal) AS b, avg(c_nationkey) AS n FROM e),
s AS (SELECT cluster, count(*) AS size, avg(c_acctbal) AS b, avg(c_nationkey) AS n FROM e WHERE cluster <> -1 GROUP BY cluster),
m AS (SELECT cluster, 'c_acctbal' AS feature, s.b AS mean, (s.b - g.b) / abs(g.b) * 100 AS percent, size FROM s, g
      UNION ALL SELECT cluster, 'c_nationkey', s.n, (s.n - g.n) / abs(g.n) * 100, size FROM s, g),
t AS (SELECT cluster, c_mktsegment AS mode, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c_mktsegment) AS r FROM e WHERE cluster <> -1 GROUP BY cluster, c_mktsegment)
SELECT cluster, size, feature, round(mean, 6) AS mean, round(percent, 6) AS percent,
       CASE WHEN percent >= 10 THEN 'higher' WHEN percent <= -10 THEN 'lower' END AS side, CAST(NULL AS VARCHAR) AS mode FROM m
UNION ALL SELECT cluster, size, 'c_mktsegment', NULL, NULL, NULL, mode FROM t JOIN s USING (cluster) WHERE r = 1
"""

_ATTRIBUTION_SQL = f"WITH e AS {events_sql('event_id', *COEFFICIENTS)}, a AS (" + " UNION ALL ".join(
    f"SELECT event_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, ({f} - avg({f}) OVER ()) * CAST({c} AS DOUBLE) AS contribution FROM e"
    for f, c in COEFFICIENTS.items()
) + ")"

TRAINING_QUERIES = {
    "wide_category_codes": (wide_category_codes, _WIDE_CODES_SQL),
    "train_rf_class": (train_rf_class, _facts_sql(_ORDER_SIDES_SQL, "random_forest")),
    "train_rf_reg": (train_rf_reg, _facts_sql(_PRICE_SIDES_SQL, "random_forest")),
    "train_logreg": (train_logreg, _facts_sql(_DOCUMENTS_SQL, "logistic_regression")),
    "train_gbt_class": (train_gbt_class, _facts_sql(_DOCUMENTS_SQL, "xgboost")),
    "train_gbt_multiclass": (train_gbt_multiclass, _facts_sql(_ORDER_SIDES_SQL, "lightgbm")),
    "train_gbt_reg": (train_gbt_reg, _facts_sql(_PRICE_SIDES_SQL, "lightgbm")),
    "learned_bands": (learned_bands, _LEARNED_BANDS_SQL),
    "learned_product": (learned_product, _facts_sql(_PRICE_SIDES_SQL, *T.ALGORITHMS["regression"])),
    "linreg_1d": (linreg_1d, _LINREG_SQL),
    "cv_linear": (cv_linear, _CV_LINEAR_SQL),
    "train_cv": (train_cv, "SELECT CAST(unnest(range(5)) AS INTEGER) AS fold, true AS possible, true AS mean_fits"),
    "compare_all": (compare_all, _facts_sql(_DOCUMENTS_SQL, *T.ALGORITHMS["classification"])),
    "tune": (tune, "SELECT CAST(5 AS BIGINT) AS trials, true AS in_order, true AS different"),
    "auto_regularize": (auto_regularize, "SELECT CAST(1 AS BIGINT) AS chosen, true AS in_order, true AS narrower, CAST(0 AS BIGINT) AS failed"),
    "drop_low_importance": (drop_low_importance, f"WITH {_PRICE_SIDES_SQL} SELECT true AS weakest_dropped, rows - test_rows AS train_rows, test_rows FROM z"),
    "retrain_diff": (retrain_diff, "SELECT 'forest' AS run, unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, true AS change_fits, true AS better_fits"),
    "feature_importance": (feature_importance, "SELECT feature, true AS positive, true AS sums_to_one FROM (SELECT unnest(['" + "', '".join(PRICE_FEATURES) + "']) AS feature)"),
    "confusion_of_model": (confusion_of_model, f"SELECT CAST((SELECT count(DISTINCT b.o_orderstatus) FROM orders b WHERE b.o_orderstatus < a.o_orderstatus) AS DOUBLE) AS actual, count(*) AS rows, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS columns FROM orders a WHERE {hash_sql('o_orderkey')} % 100 < 20 GROUP BY o_orderstatus"),
    "roc_of_model": (roc_of_model, "SELECT true AS from_origin, true AS rising, true AS inside"),
    "predictions_export": (predictions_export, _TEST_DOCUMENTS_SQL),
    "wide_model_export": (wide_model_export, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM lineitem"),
    "model_export": (model_export, "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM lineitem"),
    "scale_features": (
        scale_features,
        f"SELECT event_id, round(value, 6) AS value, user_id, const, {_SCALED_SQL} FROM {events_sql('event_id', 'value', 'user_id', 'const')}",
    ),
    "kmeans_assign": (kmeans_assign, _ASSIGN_SQL),
    "kmeans_clusters": (kmeans_clusters, "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS clusters, true AS none_empty, true AS possible FROM customer"),
    "hierarchical_clusters": (hierarchical_clusters, "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS clusters, CAST(4 AS BIGINT) AS n_clusters FROM embeddings"),
    "dbscan_core_points": (
        dbscan_core_points,
        f"WITH p AS {_CUSTOMER_SQL} SELECT a.k AS c_custkey, count(*) >= 5 AS core FROM p a JOIN p b "
        "ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.01 GROUP BY a.k",
    ),
    "dbscan_labels": (dbscan_labels, _DBSCAN_SQL.replace("{points}", _CUSTOMER_SQL)),
    "cluster_sizes": (
        cluster_sizes,
        "SELECT CAST(label - 1 AS INTEGER) AS cluster, count(*) AS size, (SELECT count(DISTINCT label) FROM embeddings WHERE label <> 0) AS n_clusters FROM embeddings GROUP BY label",
    ),
    "silhouette": (silhouette, _SILHOUETTE_SQL),
    "cluster_profile": (cluster_profile, _PROFILE_SQL),
    "projection_2d": (projection_2d, "SELECT vec_id, position, label, true AS in_order, true AS uncorrelated FROM (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS position, count(*) OVER () AS n FROM embeddings) WHERE position % greatest(1, n // 1000) = 0"),
    "linear_attribution": (
        linear_attribution,
        _ATTRIBUTION_SQL + " SELECT event_id, feature, round(value, 6) AS value, round(contribution, 6) AS contribution FROM a",
    ),
    "top_contributions": (
        top_contributions,
        _ATTRIBUTION_SQL
        + ", r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(contribution) DESC, feature) AS rank FROM a) "
        "SELECT event_id, feature, round(value, 6) AS value, round(contribution, 4) AS contribution, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
    ),
    "push_pull": (
        push_pull,
        _ATTRIBUTION_SQL
        + ", r AS (SELECT *, CASE WHEN contribution > 0 THEN 'push' ELSE 'pull' END AS direction, row_number() OVER (PARTITION BY event_id, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS rank FROM a WHERE contribution <> 0) "
        "SELECT event_id, direction, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 6) AS contribution FROM r WHERE rank <= 2",
    ),
    "tree_attribution": (tree_attribution, None),
    "tree_additivity": (tree_additivity, _TEST_DOCUMENTS_SQL.replace("of_a_class", "adds_up")),
    "model_report": (model_report, None),
}
