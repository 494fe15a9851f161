"""Registered queries for model preparation, splits, metrics and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import hash_number
from ..modelling import diagnose, metrics, prepare, split
from ..modelling import train as T
from ..modelling.categories import learn_one_hot_vectors
from ..operators import profiling
from ..operators.charts import pair_correlations
from .data_queries import HINT_COLUMNS, events_profile_sql
from .tables import events, events_sql, rounded, table

HASH_SQL = "CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, {digits}) AS BIGINT)"


def hash_sql(key: str, seed: int | str = 42, digits: int = 8) -> str:
    return HASH_SQL.format(key=key, seed=seed, digits=digits)


# Preparation -----------------------------------------------------------------------------


def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.label_encode(events(spark, folder, "event_id", "type_n"), "type_n")


def label_encode_names(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name")
    return prepare.label_encode(df, "c_name", "code", broadcast_limit=1_000)


def impute_median(spark, folder):
    return rounded(prepare.impute_median(events(spark, folder, "event_id", "value_n", "inf_v"), ["value_n", "inf_v"]))


def prepare_target(spark, folder):
    df = events(spark, folder, "event_id", "type_n")
    return prepare.prepare_target(df, "type_n", null_target="impute")


def prepare_target_drop(spark, folder):
    return rounded(prepare.prepare_target(events(spark, folder, "event_id", "value_n"), "value_n"))


def class_imbalance(spark, folder):
    return prepare.class_balance(table(spark, folder, "labels"), "toxic")


def leakage_check(spark, folder):
    df = events(spark, folder, "value", "leaky", "value_n", "user_id", "const")
    return prepare.leakage_check(df, ["leaky", "value_n", "user_id", "const"], "value")


def split_holdout(spark, folder):
    return split.split_holdout(events(spark, folder, "event_id", "event_type"), "event_id")


def split_stratified(spark, folder):
    return split.split_stratified(events(spark, folder, "event_id", "event_type"), "event_id", "event_type")


def cv_fold_assignment(spark, folder):
    return split.assign_folds(events(spark, folder, "event_id"), "event_id")


SCREENED = HINT_COLUMNS + ("value_rare",)


def _screen_profile(spark, folder):
    return profiling.profile_columns(events(spark, folder, *SCREENED))


def feature_screen(spark, folder):
    return prepare.feature_screen(_screen_profile(spark, folder))


def default_features(spark, folder):
    return prepare.default_features(_screen_profile(spark, folder), "event_type")


def one_hot_vectors(spark, folder):
    """A slot for every order: size, place and value of the only entry, or nothing for a missing number."""
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS wide")
    vectors = learn_one_hot_vectors(df, "wide").apply(df)
    parts = [F.regexp_extract(F.col("wide").cast("string"), r"^\((\d+),\[(\d+)\],\[([\d.]+)\]\)$", i).cast("double") for i in (1, 2, 3)]
    return vectors.select("o_orderkey", *[p.cast("bigint").alias(n) for p, n in zip(parts, ("size", "slot", "entry"))])


CHOICE_TABLES = ("nation", "customer", "orders", "lineitem", "events")
CHOICE_TASKS = ("classification", "regression")


def default_algorithm(spark, folder):
    """The algorithm that each table's rows and columns lead to."""
    rows = []
    for name in CHOICE_TABLES:
        df = table(spark, folder, name)
        texts = sum(t == "string" for _, t in df.dtypes)
        n = df.count()
        rows += [(name, task, n, prepare.choose_algorithm(task, n, len(df.columns), texts)) for task in CHOICE_TASKS]
    return spark.createDataFrame(rows, "table_name string, task string, rows long, algorithm string")


# Per case: the target of the events, the task, and the rows of the table, the last two of them too few for it.
GUARD_CASES = (
    ("const", "classification", "TRUE"),
    ("event_type", "classification", "TRUE"),
    ("flag01", "classification", "TRUE"),
    ("value_rare", "regression", "TRUE"),
    ("value_rare", "regression", "event_id < 4"),
    ("flag01", "classification", "event_id < 4"),
)


def training_guards(spark, folder):
    """Which tables training refuses, and for which reason."""
    rows = []
    for target, task, where in GUARD_CASES:
        df = events(spark, folder, *dict.fromkeys(["event_id", "value", target])).where(where)
        try:
            T.training_set(df, target, ["value"], task, "event_id")
            reason = "accepted"
        except ValueError as error:
            reason = "one class" if "distinct value" in str(error) else "too few rows"
        rows.append((target, task, where, reason))
    return spark.createDataFrame(rows, "target string, task string, source string, reason string")


def _guards_sql() -> str:
    """Two rows and classes at least, and five rows with a target."""
    return " UNION ALL ".join(
        f"SELECT '{target}' AS target, '{task}' AS task, '{where}' AS source, CASE WHEN count({target}) < 2 THEN 'too few rows' "
        f"WHEN '{task}' = 'classification' AND count(DISTINCT {target}) < 2 THEN 'one class' WHEN count({target}) < 5 THEN 'too few rows' "
        f"ELSE 'accepted' END AS reason FROM {events_sql(*dict.fromkeys(['event_id', target]))} WHERE {where}"
        for target, task, where in GUARD_CASES
    )


def _choice_sql() -> str:
    shape = "(SELECT count_if(data_type = 'VARCHAR') * 2 > count(*) FROM duckdb_columns() WHERE table_name = '{0}')"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{task}' AS task, count(*) AS rows, CASE WHEN count(*) >= 10000 THEN 'lightgbm' "
        f"WHEN count(*) >= 1000 THEN 'random_forest' WHEN '{task}' = 'regression' THEN 'linear_regression' "
        f"WHEN {shape.format(name)} THEN 'random_forest' ELSE 'logistic_regression' END AS algorithm FROM {name}"
        for name in CHOICE_TABLES
        for task in CHOICE_TASKS
    )


def target_suggestions(spark, folder):
    profile = _screen_profile(spark, folder)
    both = [prepare.target_suggestions(profile, t).withColumn("task", F.lit(t)) for t in ("classification", "regression")]
    return both[0].unionByName(both[1])


# Metrics on rule-based scores ------------------------------------------------------------

# A score and a label that follow from the tables, so both engines can compute them.
SCORED_SQL = """(SELECT event_id, user_id, event_type, value / 500e0 AS score,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
  CASE WHEN value > 40e0 AND event_id % 3 <> 0 THEN 1 ELSE 0 END AS prediction FROM events)"""


def scored_events(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value / 500e0 AS score",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label",
        "CASE WHEN value > 40e0 AND event_id % 3 <> 0 THEN 1 ELSE 0 END AS prediction",
    )


GUESS_RULE = "CASE WHEN event_id % 3 = 0 THEN event_type WHEN value > 60e0 THEN 'purchase' WHEN value > 20e0 THEN 'view' ELSE 'click' END"


def guessed_types(spark, folder) -> DataFrame:
    return table(spark, folder, "events").selectExpr("event_id", "event_type", f"{GUESS_RULE} AS guess")


def classification_metrics(spark, folder):
    return metrics.classification_metrics(guessed_types(spark, folder), "event_type", "guess")


def classification_metrics_binary(spark, folder):
    return metrics.classification_metrics(scored_events(spark, folder), "label", "prediction")


def metrics_positive_class(spark, folder):
    return metrics.classification_metrics(scored_events(spark, folder), "label", "prediction", positive=0)


MISSING_GUESS = "CASE WHEN event_id % 5 = 0 THEN 'zz' WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 2 THEN 'purchase' ELSE event_type END"


def metrics_with_missing_labels(spark, folder):
    """Two text classes; some labels and guesses are missing, some guesses are of a class without labels."""
    df = events(spark, folder, "event_id", "event_type", "type_n").where("event_type IN ('click', 'purchase')")
    return metrics.classification_metrics(df.selectExpr("type_n", f"{MISSING_GUESS} AS guess"), "type_n", "guess")


def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(guessed_types(spark, folder), "event_type", "guess")


PRICE_RULE = "l_quantity * (1400e0 + 30e0 * (l_suppkey % 10))"


def priced_lines(spark, folder) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", f"{PRICE_RULE} AS prediction"
    )


def regression_metrics(spark, folder):
    return metrics.regression_metrics(priced_lines(spark, folder), "l_extendedprice", "prediction")


def regression_metrics_by_supplier(spark, folder):
    return metrics.regression_metrics(priced_lines(spark, folder), "l_extendedprice", "prediction", ["l_suppkey"], 3)


def roc_curve(spark, folder):
    df = scored_events(spark, folder)
    return rounded(metrics.roc_curve(df, F.col("label") == 1, F.col("score")))


def roc_auc(spark, folder):
    return metrics.roc_auc(scored_events(spark, folder), F.col("label") == 1, F.col("score"), places=6)


def roc_auc_by_user(spark, folder):
    df = scored_events(spark, folder)
    return metrics.roc_auc(df, F.col("label") == 1, F.col("score"), ["user_id"], places=6)


def roc_auc_macro(spark, folder):
    """The leading vector components as class scores of the labels."""
    df = table(spark, folder, "embeddings").selectExpr("label", "transform(slice(embedding, 1, 10), x -> CAST(x AS DOUBLE)) AS scores")
    return metrics.roc_auc_macro(df, "label", "scores", 6)


def residual_sample(spark, folder):
    df = table(spark, folder, "orders").selectExpr("o_orderkey", "o_totalprice", "o_custkey * 100e0 AS prediction")
    return metrics.residual_sample(df, "o_totalprice", "prediction", ["o_orderkey"])


# Run tables: one simple model per user, on a training and a test side -----------------------

RUN_RULE = "value > 30e0"
FLIP_RULE = "event_id % (2 + user_id % 12) = 0"


def user_runs(spark, folder) -> DataFrame:
    """A run per user: accuracy of a rule on both sides, and facts about its data."""
    df = table(spark, folder, "events").selectExpr(
        "event_id",
        "user_id",
        f"CAST({RUN_RULE} AS INT) AS label",
        f"CAST(({RUN_RULE}) <> ({FLIP_RULE}) AS INT) AS prediction",
    )
    sides = df.withColumn("is_test", hash_number(F.col("event_id")) % 100 < 40)
    hit = (F.col("label") == F.col("prediction")).cast("int")
    share = F.avg("label") * 100
    return sides.groupBy(F.col("user_id").alias("run")).agg(
        F.lit("classification").alias("task"),
        F.round(F.avg(F.when(~F.col("is_test"), hit)), 4).alias("train_score"),
        F.round(F.avg(F.when(F.col("is_test"), hit)), 4).alias("test_score"),
        F.round(F.least(share, 100 - share), 2).alias("minority_pct"),
        (F.max("event_id") % 2 == 0).alias("has_cv"),
        F.lit(6).alias("features"),
        (F.min("event_id") % 3).alias("low_features"),
    )


RUNS_SQL = f"""(WITH s AS (
  SELECT user_id AS run, event_id, CAST({RUN_RULE} AS INT) AS label,
         CAST((CAST({RUN_RULE} AS INT) = CAST(({RUN_RULE}) <> ({FLIP_RULE}) AS INT)) AS INT) AS hit,
         {hash_sql('event_id')} % 100 < 40 AS is_test FROM events)
SELECT run, 'classification' AS task, round(avg(hit) FILTER (WHERE NOT is_test), 4) AS train_score,
       round(avg(hit) FILTER (WHERE is_test), 4) AS test_score,
       round(least(avg(label) * 100, 100 - avg(label) * 100), 2) AS minority_pct,
       max(event_id) % 2 = 0 AS has_cv, 6 AS features, min(event_id) % 3 AS low_features
FROM s GROUP BY run)"""


def quality_label(spark, folder):
    runs = user_runs(spark, folder).select("run", "task", "test_score")
    screened = diagnose.quality_label(runs, "screen", "screen_quality")
    return diagnose.quality_label(screened, "report")


def overfit_severity(spark, folder):
    return diagnose.overfit_severity(user_runs(spark, folder).select("run", "train_score", "test_score"))


def next_steps(spark, folder):
    return diagnose.next_steps(user_runs(spark, folder))


def best_model(spark, folder):
    return diagnose.best_model(user_runs(spark, folder))


IMPORTANCE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_partkey")


def shared_importance(spark, folder):
    """Per supplier, how strongly each column goes with the price, as importance."""
    df = table(spark, folder, "lineitem")
    pairs = [(f, "l_extendedprice") for f in IMPORTANCE_FEATURES]
    found = pair_correlations(df, pairs, ["l_suppkey"]).select(
        F.col("l_suppkey").alias("run"), F.col("col_a").alias("feature"), F.round(F.abs("r"), 4).alias("importance")
    )
    return rounded(diagnose.shared_importance(found, top=3))


def metric_diff(spark, folder):
    """Two pricing rules compared per supplier."""
    old = metrics.regression_metrics(priced_lines(spark, folder), "l_extendedprice", "prediction", ["l_suppkey"], 2)
    better = priced_lines(spark, folder).withColumn("prediction", F.col("prediction") + F.col("l_suppkey") % 7 * 100.0)
    new = metrics.regression_metrics(better, "l_extendedprice", "prediction", ["l_suppkey"], 2)
    return diagnose.metric_diff(old, new, ["l_suppkey"], ["r2", "mae", "rmse"])


# Checks ----------------------------------------------------------------------------------

_SCREEN_SQL = f"WITH p AS ({events_profile_sql(*HINT_COLUMNS)} UNION ALL {events_profile_sql('value_rare')}) "

_ROC_POINTS_SQL = """
WITH e AS {scored}, g AS (SELECT {by} score, sum(label) AS pos, sum(1 - label) AS neg FROM e GROUP BY {by} score),
t AS (SELECT {by} score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, row_number() OVER w AS ord,
      sum(pos) OVER ({part}) AS ap, sum(neg) OVER ({part}) AS an, count(*) OVER ({part}) AS points
      FROM g WINDOW w AS ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
_ROC_SQL = _ROC_POINTS_SQL.format(scored=SCORED_SQL, by="", part="")
_AUC = "round(CASE WHEN max(ap) * max(an) > 0 THEN CAST(sum(neg * (cp - pos / 2.0)) AS DOUBLE) / (CAST(max(ap) AS DOUBLE) * max(an)) END, {places})"

_METRICS_SQL = """
WITH e AS (SELECT {label} AS y, {prediction} AS p FROM {source}),
c AS (SELECT DISTINCT y AS k FROM e UNION SELECT DISTINCT p FROM e),
m AS (SELECT k, count(*) FILTER (WHERE y = k) AS s, count(*) FILTER (WHERE p = k) AS q, count(*) FILTER (WHERE y = k AND p = k) AS h FROM c, e GROUP BY k),
r AS (SELECT k, s, h, CASE WHEN q > 0 THEN h * 1.0::DOUBLE / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN h * 1.0::DOUBLE / s ELSE 0 END AS re FROM m),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
"""
_WEIGHTED_SQL = _METRICS_SQL.format(label="event_type", prediction="guess", source=f"(SELECT event_type, {GUESS_RULE} AS guess FROM events)") + (
    "SELECT CAST(sum(s) AS BIGINT) AS rows, round(sum(h) * 1.0::DOUBLE / sum(s), 4) AS accuracy, round(sum(pr * s) / sum(s), 4) AS precision, "
    "round(sum(re * s) / sum(s), 4) AS recall, round(sum(f1 * s) / sum(s), 4) AS f1 FROM f"
)


def _binary_sql(positive: int) -> str:
    return _METRICS_SQL.format(label="label", prediction="prediction", source=SCORED_SQL) + (
        f"SELECT CAST((SELECT sum(s) FROM f) AS BIGINT) AS rows, round((SELECT sum(h) * 1.0::DOUBLE / sum(s) FROM f), 4) AS accuracy, "
        f"round(pr, 4) AS precision, round(re, 4) AS recall, round(f1, 4) AS f1 FROM f WHERE k = {positive}"
    )


def _regression_sql(prediction: str, places: int, by: str = "") -> str:
    keep, group = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    error = f"(l_extendedprice - ({prediction}))"
    return (
        f"SELECT {keep} count(*) AS rows, round(1 - sum({error} * {error}) / (var_pop(l_extendedprice) * count(*)), {places}) AS r2, "
        f"round(avg(abs({error})), {places}) AS mae, round(sqrt(avg({error} * {error})), {places}) AS rmse FROM lineitem {group}"
    )


_MACRO_SQL = """
WITH x AS (SELECT label, unnest(range(10)) AS class, unnest(embedding[1:10]) AS s FROM embeddings),
e AS (SELECT class, CAST(s AS DOUBLE) AS score, CAST(label = class AS INT) AS label FROM x),
""" + _ROC_POINTS_SQL.format(scored="(SELECT 1)", by="class,", part="PARTITION BY class").replace("WITH e AS (SELECT 1),", "") + (
    f"SELECT round(avg(auc), 6) AS auc, count(auc) AS classes FROM (SELECT class, {_AUC.format(places=12)} AS auc FROM t GROUP BY class)"
)

_DIFF_SQL = f"""
WITH o AS ({_regression_sql(PRICE_RULE, 2, 'l_suppkey')}),
n AS ({_regression_sql(PRICE_RULE + ' + l_suppkey % 7 * 100e0', 2, 'l_suppkey')}),
m AS ({" UNION ALL ".join(
    f"SELECT o.l_suppkey, '{m}' AS metric, o.{m} AS old_value, n.{m} AS new_value, round(n.{m} - o.{m}, 6) AS change FROM o JOIN n USING (l_suppkey)"
    for m in ("r2", "mae", "rmse"))})
SELECT *, CASE WHEN metric = 'r2' THEN change > 0 ELSE change < 0 END AS better FROM m
"""

_STEPS_SQL = f"""
WITH r AS {RUNS_SQL},
a AS (
  SELECT run, 2 AS k, 'collect_minority_rows' AS step, 'high' AS priority FROM r WHERE minority_pct < 10
  UNION ALL SELECT run, 3, 'raise_accuracy', 'high' FROM r WHERE test_score < 0.7
  UNION ALL SELECT run, 5, 'cross_validate', 'medium' FROM r WHERE NOT has_cv
  UNION ALL SELECT run, 6, 'drop_low_importance', 'medium' FROM r WHERE features > 5 AND low_features > 0
  UNION ALL SELECT run, 7, 'confirm_small_gap', 'low' FROM r WHERE round(train_score - test_score, 6) > 0.05 AND round(train_score - test_score, 6) < 0.1
  UNION ALL SELECT run, 9, 'double_check_leakage', 'low' FROM r WHERE test_score >= 0.95
),
n AS (SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS INTEGER) AS ord, step, priority FROM a)
SELECT * FROM n WHERE ord < 5
"""

_SHARED_SQL = f"""
WITH i AS ({" UNION ALL ".join(
    f"SELECT l_suppkey AS run, '{f}' AS feature, round(abs(covar_pop({f}, l_extendedprice) / (stddev_pop({f}) * stddev_pop(l_extendedprice))), 4) AS importance FROM lineitem GROUP BY l_suppkey"
    for f in IMPORTANCE_FEATURES)}),
k AS (SELECT *, row_number() OVER w AS place, importance / first_value(importance) OVER w AS relative FROM i WINDOW w AS (PARTITION BY run ORDER BY importance DESC, feature)),
s AS (SELECT feature, sum(relative) / (SELECT count(DISTINCT run) FROM k) AS avg_importance, count(*) AS agreed_by FROM k WHERE place <= 3 GROUP BY feature HAVING count(*) >= 2)
SELECT feature, round(avg_importance, 6) AS avg_importance, agreed_by, CAST(ord AS INTEGER) AS ord
FROM (SELECT *, row_number() OVER (ORDER BY avg_importance DESC, feature) AS ord FROM s) WHERE ord <= 3
"""

_MEDIAN_SQL = "(SELECT quantile_cont({c}, 0.5) FROM e WHERE isfinite({c}))"

_MISSING_SQL = f"""
WITH e AS (SELECT type_n AS a, {MISSING_GUESS} AS p FROM {events_sql('event_id', 'event_type', 'type_n')}
           WHERE event_type IN ('click', 'purchase') AND type_n IS NOT NULL),
m AS (SELECT max(a) AS c FROM e),
k AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = p) AS hits, count(*) FILTER (WHERE a = c) AS support,
             count(*) FILTER (WHERE p = c) AS claimed, count(*) FILTER (WHERE a = c AND p = c) AS tp FROM e, m)
SELECT n AS rows, round(CAST(hits AS DOUBLE) / n, 4) AS accuracy, round(CAST(tp AS DOUBLE) / claimed, 4) AS precision,
       round(CAST(tp AS DOUBLE) / support, 4) AS recall, round(2e0 * tp / (claimed + support), 4) AS f1 FROM k
"""

MODEL_QUERIES = {
    "label_encode": (
        label_encode,
        f"SELECT event_id, type_n, dense_rank() OVER (ORDER BY coalesce(type_n, '__missing__')) - 1 AS type_n_code FROM {events_sql('event_id', 'type_n')}",
    ),
    "label_encode_names": (
        label_encode_names,
        "SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS code FROM customer",
    ),
    "impute_median": (
        impute_median,
        f"WITH e AS {events_sql('event_id', 'value_n', 'inf_v')} SELECT event_id, "
        + ", ".join(f"round(CASE WHEN isfinite({c}) THEN {c} ELSE {_MEDIAN_SQL.format(c=c)} END, 6) AS {c}" for c in ("value_n", "inf_v"))
        + " FROM e",
    ),
    "prepare_target": (
        prepare_target,
        f"SELECT event_id, coalesce(type_n, 'nan') AS type_n, dense_rank() OVER (ORDER BY coalesce(type_n, 'nan')) - 1 AS label FROM {events_sql('event_id', 'type_n')}",
    ),
    "prepare_target_drop": (
        prepare_target_drop,
        f"SELECT event_id, value_n, value_n AS label FROM {events_sql('event_id', 'value_n')} WHERE value_n IS NOT NULL",
    ),
    "class_imbalance": (
        class_imbalance,
        "WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS count FROM labels GROUP BY toxic) "
        "SELECT class, count, round(count / (SELECT sum(count) FROM c) * 100, 2) AS percent, "
        "round((SELECT min(count) / sum(count) FROM c) * 100, 2) AS minority_pct, (SELECT min(count) / sum(count) FROM c) * 100 < 20 AS imbalanced FROM c",
    ),
    "leakage_check": (
        leakage_check,
        f"WITH e AS {events_sql('value', 'leaky', 'value_n', 'user_id')}, r AS (SELECT 'leaky' AS feature, corr(leaky, value) AS c FROM e "
        "UNION ALL SELECT 'value_n', corr(value_n, value) FROM e UNION ALL SELECT 'user_id', corr(user_id, value) FROM e) "
        "SELECT feature, round(c, 4) AS correlation FROM r WHERE abs(c) > 0.95",
    ),
    "split_holdout": (split_holdout, f"SELECT event_id, event_type, {hash_sql('event_id')} % 100 < 20 AS is_test FROM events"),
    "split_stratified": (
        split_stratified,
        f"WITH e AS (SELECT event_id, event_type, {hash_sql('event_id', 42, 13)} AS h FROM events) "
        "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY h) <= round(0.2 * count(*) OVER (PARTITION BY event_type)) AS is_test FROM e",
    ),
    "cv_fold_assignment": (
        cv_fold_assignment,
        f"SELECT event_id, CAST({hash_sql('event_id', 'fold42')} % 5 AS INTEGER) AS fold FROM events",
    ),
    "feature_screen": (
        feature_screen,
        _SCREEN_SQL + "SELECT name, unique_count >= least(count * 0.9, count - 1) AS id_like, unique_count <= 1 AS low_variance, null_percent > 50 AS high_nulls FROM p",
    ),
    "default_features": (
        default_features,
        _SCREEN_SQL + "SELECT name, unique_count <= 1 AS low_variance, null_percent > 50 AS high_nulls FROM p WHERE name <> 'event_type' AND NOT (unique_count >= least(count * 0.9, count - 1))",
    ),
    "one_hot_vectors": (
        one_hot_vectors,
        "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS wide FROM orders), "
        "k AS (SELECT wide, row_number() OVER (ORDER BY wide) - 1 AS slot, count(*) OVER () AS size FROM (SELECT DISTINCT wide FROM o WHERE wide IS NOT NULL)) "
        "SELECT o_orderkey, size, slot, CASE WHEN slot IS NOT NULL THEN 1 END AS entry FROM o LEFT JOIN k USING (wide)",
    ),
    "default_algorithm": (default_algorithm, _choice_sql()),
    "training_guards": (training_guards, _guards_sql()),
    "target_suggestions": (
        target_suggestions,
        _SCREEN_SQL + "SELECT name, dtype, unique_count, 'classification' AS task FROM p WHERE unique_count BETWEEN 2 AND 20 "
        "UNION ALL SELECT name, dtype, unique_count, 'regression' FROM p WHERE dtype IN ('f64', 'i64', 'f32', 'i32') AND unique_count > 10",
    ),
    "classification_metrics": (classification_metrics, _WEIGHTED_SQL),
    "classification_metrics_binary": (classification_metrics_binary, _binary_sql(1)),
    "metrics_positive_class": (metrics_positive_class, _binary_sql(0)),
    "metrics_with_missing_labels": (metrics_with_missing_labels, _MISSING_SQL),
    "confusion_matrix": (
        confusion_matrix,
        f"WITH e AS (SELECT event_type AS a, {GUESS_RULE} AS p FROM events), k AS (SELECT a AS c FROM e UNION SELECT p FROM e) "
        "SELECT x.c AS actual, y.c AS predicted, (SELECT count(*) FROM e WHERE e.a = x.c AND e.p = y.c) AS count FROM k x, k y",
    ),
    "regression_metrics": (regression_metrics, _regression_sql(PRICE_RULE, 4)),
    "regression_metrics_by_supplier": (regression_metrics_by_supplier, _regression_sql(PRICE_RULE, 3, "l_suppkey")),
    "roc_curve": (
        roc_curve,
        _ROC_SQL + "SELECT CAST(0 AS BIGINT) AS ord, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL "
        "SELECT ord, round(CAST(cn AS DOUBLE) / an, 6), round(CAST(cp AS DOUBLE) / ap, 6) FROM t WHERE ord % greatest(1, (points + 1) // 200) = 0",
    ),
    "roc_auc": (roc_auc, _ROC_SQL + f"SELECT {_AUC.format(places=6)} AS auc FROM t"),
    "roc_auc_by_user": (
        roc_auc_by_user,
        _ROC_POINTS_SQL.format(scored=SCORED_SQL, by="user_id,", part="PARTITION BY user_id")
        + f"SELECT user_id, {_AUC.format(places=6)} AS auc FROM t GROUP BY user_id",
    ),
    "roc_auc_macro": (roc_auc_macro, _MACRO_SQL),
    "residual_sample": (
        residual_sample,
        "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_totalprice AS actual, o_custkey * 100e0 AS prediction FROM orders) "
        "SELECT position, round(actual, 4) AS actual, round(prediction, 4) AS prediction, round(actual - prediction, 4) AS residual FROM p "
        "WHERE position % greatest(1, (SELECT count(*) FROM p) // 500) = 0",
    ),
    "quality_label": (
        quality_label,
        f"SELECT run, task, test_score, CASE WHEN test_score >= 0.95 THEN 'strong' WHEN test_score >= 0.85 THEN 'good' WHEN test_score >= 0.7 THEN 'reasonable' ELSE 'weak' END AS quality, "
        f"CASE WHEN test_score > 0.9 THEN 'strong' WHEN test_score >= 0.7 THEN 'reasonable' ELSE 'weak' END AS screen_quality FROM {RUNS_SQL}",
    ),
    "overfit_severity": (
        overfit_severity,
        f"WITH r AS {RUNS_SQL}, g AS (SELECT run, train_score, test_score, round(train_score - test_score, 6) AS gap FROM r) SELECT *, "
        "CASE WHEN gap >= 0.25 THEN 'severe' WHEN gap >= 0.15 THEN 'moderate' WHEN gap >= 0.1 THEN 'mild' ELSE 'none' END AS severity, "
        "CASE WHEN gap > 0.1 THEN 'noticeable' WHEN gap > 0.05 THEN 'small' ELSE 'fine' END AS report_band FROM g",
    ),
    "next_steps": (next_steps, _STEPS_SQL),
    "best_model": (
        best_model,
        f"SELECT task, run, test_score FROM {RUNS_SQL} WHERE test_score IS NOT NULL ORDER BY test_score DESC, run LIMIT 1",
    ),
    "shared_importance": (shared_importance, _SHARED_SQL),
    "metric_diff": (metric_diff, _DIFF_SQL),
}
