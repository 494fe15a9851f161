"""Training, cross-validation, tuning, comparison and export of supervised models."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JError
from pyspark import SparkContext, StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, IndexToString
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import col, double_array, require_columns
from ..operators.charts import pair_correlations
from ..session import ensure_checkpoint_dir
from . import metrics as M
from .prepare import (
    IMBALANCE_LIMIT,
    LEAKAGE_LIMIT,
    LISTED_CATEGORIES,
    Preparation,
    choose_algorithm,
    finite,
    inner_names,
    is_text,
    learn_classes,
    learn_fold_preparations,
    learn_preparation,
    model_features,
)
from .linear_cv import linear_fold_scores
from .split import both_sides, deal_folds, fold_number, holdout_flag, split_stratified

SEED = 42
DEEPEST = 30
TREE_BINS = 64
# Rows per partition of a training set, and of a large one beyond its first few partitions.
PARTITION_ROWS = 20_000
LARGE_PARTITION_ROWS = 500_000
# Iterative training takes equal rows as one with a weight if that leaves at most this part of the rows.
GROUPED_PART = 0.1
# From this many rows on, boosting takes rows of equal bins as one, by the same part. Bins of features with many
# values are learned first, from values that show in so many rows.
BINNED_ROWS = 1_000_000
PROOF_ROWS = 10_000
QUANTILE_ACCURACY = 10_000
# The least rows of a leaf in either style of boosting.
BOOSTED_LEAF_ROWS = {"xgboost": 1, "lightgbm": 20}

# The target as numbers, while a table may still hold a column called label.
LABEL = "__label"
HELD_OUT = "__held_out"

# Algorithms per task, in the order they are compared.
ALGORITHMS = {
    "classification": ("random_forest", "logistic_regression", "xgboost", "lightgbm"),
    "regression": ("random_forest", "linear_regression", "xgboost", "lightgbm"),
}


def make_estimator(task: str, algorithm: str, train_rows: int, classes: int = 2, **hyperparams) -> Estimator:
    """An MLlib estimator for an algorithm name and its usual hyperparameters.

    ``xgboost`` and ``lightgbm`` name two parameter styles of Spark's gradient-boosted trees.
    """
    if task not in ALGORITHMS:
        raise ValueError(f"unknown task: {task}")
    if algorithm not in ALGORITHMS[task]:
        raise ValueError(f"unknown algorithm for {task}: {algorithm}")
    h = {k: v for k, v in hyperparams.items() if v is not None}
    if algorithm == "random_forest":
        shared = dict(
            numTrees=int(h.get("n_estimators", 100)),
            maxDepth=min(int(h.get("max_depth", 0)) or DEEPEST, DEEPEST),
            minInstancesPerNode=max(1, math.ceil(int(h.get("min_samples_split", 2)) / 2)),
            maxBins=TREE_BINS,
            seed=SEED,
            cacheNodeIds=True,
            checkpointInterval=10,
        )
        if task == "classification":
            return RandomForestClassifier(featureSubsetStrategy="sqrt", **shared)
        return RandomForestRegressor(featureSubsetStrategy="all", **shared)
    if algorithm == "logistic_regression":
        return LogisticRegression(
            regParam=1.0 / (float(h.get("C", 1.0)) * max(train_rows, 1)),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=int(h.get("max_iter", 1000)),
            family="multinomial" if classes > 2 else "binomial",
        )
    if algorithm == "linear_regression":
        return LinearRegression(solver="auto", regParam=0.0)
    shared = dict(
        maxIter=int(h.get("n_estimators", 100)),
        stepSize=float(h.get("learning_rate", 0.1)),
        maxDepth=_boosted_depth(algorithm, h),
        maxBins=TREE_BINS,
        seed=SEED,
        cacheNodeIds=True,
        checkpointInterval=10,
    )
    # Leaves hold at least as many rows as in the styles' own defaults.
    shared["minInstancesPerNode"] = int(h.get("min_child_samples", BOOSTED_LEAF_ROWS[algorithm]))
    if task == "regression":
        return GBTRegressor(**shared)
    boosted = GBTClassifier(**shared)
    return OneVsRest(classifier=boosted, parallelism=4) if classes > 2 else boosted


def _boosted_depth(algorithm: str, h: Mapping[str, Any]) -> int:
    depth = int(h.get("max_depth", 0))
    if algorithm == "xgboost":
        return min(depth or 6, DEEPEST)
    by_leaves = math.ceil(math.log2(max(2, int(h.get("num_leaves", 31)))))
    return min(depth, by_leaves, DEEPEST) if depth > 0 else min(by_leaves, DEEPEST)


# The training set ------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainingSet:
    """A split and prepared table: (key, label, is_test, features), kept in memory
    and on executor disks, and rebuilt from the source if executors are lost."""

    source: DataFrame
    prepared: DataFrame
    preparation: Preparation
    key: str
    target: str
    features: tuple[str, ...]
    task: str
    classes: tuple[str, ...]
    positive: int | None
    train_rows: int
    test_rows: int
    dropped_rows: int
    imbalance: dict | None
    leaky: tuple[tuple[str, float], ...]
    options: Mapping[str, Any]

    @property
    def train_side(self) -> DataFrame:
        return self.prepared.where(~F.col("is_test"))

    def release(self) -> None:
        self.prepared.unpersist()


def training_set(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    task: str,
    key: str,
    test_size: float = 0.2,
    positive_class=None,
    fit_scope: str = "train",
    seed: int = SEED,
    listed_categories: int = LISTED_CATEGORIES,
) -> TrainingSet:
    """Check the table, code the target, split by key, learn the preparation and apply it."""
    require_columns(df, target, key)
    model_features(df, features)
    if key in ("label", "is_test", "features", "prediction"):
        raise ValueError(f"a key cannot be called {key}")
    if task not in ALGORITHMS:
        raise ValueError(f"unknown task: {task}")
    if fit_scope not in ("train", "all"):
        raise ValueError("fit_scope is train or all")
    # Every step below reads this table again, so its few columns are kept until the end.
    # The side of each row is kept too: its hash costs more than reading the row.
    kept = [col(c) for c in dict.fromkeys([key, target, *features])]
    rows = _spread(df.select(*kept), key)
    data = rows.select("*", holdout_flag(col(key), test_size, seed).alias(HELD_OUT)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        return _training_set(df, data, target, features, task, key, test_size, positive_class, fit_scope, seed, listed_categories)
    finally:
        data.unpersist()


def _training_set(
    df: DataFrame,
    data: DataFrame,
    target: str,
    features: Sequence[str],
    task: str,
    key: str,
    test_size: float,
    positive_class,
    fit_scope: str,
    seed: int,
    listed_categories: int,
) -> TrainingSet:
    known = data.where(col(target).isNotNull() if task == "classification" else finite(data, target).isNotNull())
    rows, kept = data.agg(F.count("*"), F.count(F.when(_known_target(data, target, task), 1))).first()
    if kept < 2:
        raise ValueError("the table has fewer than 2 rows with a target")
    classes: tuple[str, ...] = ()
    imbalance, stratify = None, False
    if task == "classification":
        found = learn_classes(known, target)
        if len(found) < 2:
            raise ValueError(f"target has only {len(found)} distinct value(s); classification needs at least 2")
        classes = tuple(c for c, _ in found)
        smallest = round(min(n for _, n in found) / kept * 100, 2)
        if smallest < IMBALANCE_LIMIT:
            stratify = min(n for _, n in found) >= 2
            imbalance = {"class_distribution": dict(found), "minority_pct": smallest, "stratified": stratify}
    if kept < 5:
        raise ValueError("too few rows with a target; at least 5 are needed")
    labelled = known.withColumn(LABEL, _label(known, target, classes))
    if stratify:
        sided = split_stratified(labelled.drop(HELD_OUT), key, LABEL, test_size, seed)
    else:
        sided = both_sides(labelled.withColumn("is_test", F.col(HELD_OUT)).drop(HELD_OUT), key, seed)
    learn_from = sided if fit_scope == "all" else sided.where(~F.col("is_test"))
    preparation = learn_preparation(learn_from, features, listed_categories)
    prepared = preparation.transform(sided).select(col(key), F.col(LABEL).alias("label"), "is_test", "features")
    prepared = _balanced(prepared, key, kept).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    train_rows, test_rows = prepared.agg(F.count_if(~F.col("is_test")), F.count_if("is_test")).first()
    leaky = _leaky_features(prepared, features)
    positive = None
    if positive_class is not None and len(classes) == 2 and _as_class(positive_class, classes) is not None:
        positive = classes.index(_as_class(positive_class, classes))
    return TrainingSet(
        source=df,
        prepared=prepared,
        preparation=preparation,
        key=key,
        target=target,
        features=tuple(features),
        task=task,
        classes=classes,
        positive=positive,
        train_rows=train_rows,
        test_rows=test_rows,
        dropped_rows=rows - kept,
        imbalance=imbalance,
        leaky=leaky,
        options={
            "test_size": test_size,
            "positive_class": positive_class,
            "fit_scope": fit_scope,
            "seed": seed,
            "listed_categories": listed_categories,
        },
    )


def _spread(df: DataFrame, key: str) -> DataFrame:
    """The table dealt to all tasks by its key; a file of few row groups gives its rows to as few tasks,
    and all passes over the kept rows would run there."""
    return df.repartition(col(key))


def _balanced(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The table in as many partitions as its rows deserve, in a fixed row order.

    Iterative training runs a job per step, so one partition too many or too few counts many
    times over. The number follows from the rows alone, as sampling in MLlib depends on it.
    """
    return df.repartition(_partitions(rows), col(key)).sortWithinPartitions(col(key))


def _partitions(rows: int) -> int:
    return max(1, min(math.ceil(rows / PARTITION_ROWS), 8 + rows // LARGE_PARTITION_ROWS))


def _known_target(df: DataFrame, target: str, task: str) -> Column:
    return col(target).isNotNull() if task == "classification" else finite(df, target).isNotNull()


def _label(df: DataFrame, target: str, classes: Sequence[str]) -> Column:
    if not classes:
        return finite(df, target)
    codes = F.array(*[F.lit(c) for c in classes])
    return (F.array_position(codes, col(target).cast("string")) - 1).cast("double")


def _as_class(value, classes: Sequence[str]) -> str | None:
    """The class a given value means; numbers match by value."""
    if str(value) in classes:
        return str(value)
    try:
        return next((c for c in classes if float(c) == float(value)), None)
    except ValueError:
        return None


def _leaky_features(prepared: DataFrame, features: Sequence[str]) -> tuple[tuple[str, float], ...]:
    """Features that go with the label, by the prepared rows, which are kept: codes of texts are not joined again."""
    names = inner_names(features)
    values = prepared.select(F.col("label").alias(LABEL), vector_to_array("features").alias("__values"))
    wide = values.select(LABEL, *[F.col("__values")[i].alias(n) for i, n in enumerate(names)])
    found = pair_correlations(wide, [(n, LABEL) for n in names]).where(F.abs("r") > LEAKAGE_LIMIT).collect()
    strength = {r.col_a: round(r.r, 4) for r in found}
    return tuple((f, strength[n]) for f, n in zip(features, names) if n in strength)


# Fitting ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainResult:
    """A fitted model with its scored rows and quality."""

    data: TrainingSet
    algorithm: str
    hyperparams: Mapping[str, Any]
    estimator_model: Model
    scored: DataFrame
    metrics: Mapping[str, float]
    train_metrics: Mapping[str, float]
    importance: tuple[tuple[str, float], ...]
    cv: Mapping[str, Any] | None = None
    run: str = ""

    @property
    def task(self) -> str:
        return self.data.task

    @property
    def score_name(self) -> str:
        return "accuracy" if self.task == "classification" else "r2"

    @property
    def test_score(self) -> float:
        return self.metrics[self.score_name]

    @property
    def train_score(self) -> float:
        return self.train_metrics[self.score_name]

    @property
    def gap(self) -> float:
        return self.train_score - self.test_score

    @property
    def model(self) -> PipelineModel:
        """Everything from raw features to the decoded prediction."""
        return scoring_pipeline(self.data.preparation, self.estimator_model, self.data.classes)

    @property
    def test_side(self) -> DataFrame:
        return self.scored.where("is_test")

    def confusion(self) -> DataFrame:
        codes = [float(i) for i in range(len(self.data.classes))]
        return M.confusion_matrix(self.test_side, "label", "prediction", codes)

    def class_scores(self) -> Column:
        """One score per class: probabilities, or raw scores where there are none."""
        name = "probability" if "probability" in self.scored.columns else "rawPrediction"
        return vector_to_array(name)

    def roc(self) -> DataFrame:
        """The test curve of the positive class, or one curve per class beyond two."""
        if len(self.data.classes) == 2:
            at = self.data.positive if self.data.positive is not None else 1
            return M.roc_curve(self.test_side, F.col("label") == at, self.class_scores()[at])
        long = self.test_side.select("label", F.posexplode(self.class_scores()).alias("class", "score"))
        return M.roc_curve(long, F.col("label") == F.col("class"), F.col("score"), ["class"])

    def auc(self) -> float | None:
        if len(self.data.classes) == 2:
            at = self.data.positive if self.data.positive is not None else 1
            return M.roc_auc(self.test_side, F.col("label") == at, self.class_scores()[at]).first().auc
        return M.roc_auc_macro(self.test_side.withColumn("scores", self.class_scores()), "label", "scores").first().auc

    def residuals(self, most: int = 500) -> DataFrame:
        return M.residual_sample(self.test_side, "label", "prediction", [self.data.key], most)


def scoring_pipeline(preparation: Preparation, model: Model, classes: Sequence[str]) -> PipelineModel:
    stages = [*preparation.stages, model]
    if classes:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(classes)))
    return PipelineModel(stages)


def fit(data: TrainingSet, algorithm: str = "auto", hyperparams: Mapping[str, Any] | None = None, run: str = "", cv_folds: int | None = None) -> TrainResult:
    """Fit on the training side and rate both sides from one grouping each."""
    ensure_checkpoint_dir(data.prepared.sparkSession)
    if algorithm == "auto":
        texts = sum(is_text(data.source, f) for f in data.features)
        algorithm = choose_algorithm(data.task, data.train_rows + data.test_rows, len(data.features), texts)
    estimator = make_estimator(data.task, algorithm, data.train_rows, max(2, len(data.classes)), **(hyperparams or {}))
    model = learn(estimator, data.train_side, data.task)
    scored = score(model, data.prepared)
    if data.classes:
        scored = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=list(data.classes)).transform(scored)
    sides = rate(scored, data.task, ["is_test"], data.positive)
    cv = cross_validate(data, estimator, cv_folds) if cv_folds else None
    return TrainResult(
        data=data,
        algorithm=algorithm,
        hyperparams=dict(hyperparams or {}),
        estimator_model=model,
        scored=scored,
        metrics=sides.get(True, {}),
        train_metrics=sides.get(False, {}),
        importance=feature_importance(model, data.features),
        cv=cv,
        run=run or algorithm,
    )


def learn(estimator: Estimator, rows: DataFrame, task: str) -> Model:
    """The model of the rows (label, features); boosting and logistic regression learn from few different rows with weights.

    Equal features (and equal classes) count as often as they occur, and for a number their mean is all that squared
    error asks for, so splits, leaves and coefficients are those of the single rows. Trees tell values apart by bins only,
    so of many rows boosting takes those of equal bins as equal. Forests draw single rows.
    """
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    boosted = isinstance(inner, GBTClassifier | GBTRegressor)
    if not boosted and not isinstance(inner, LogisticRegression):
        return estimator.fit(rows)
    values = vector_to_array("features")
    same = [values.alias("values"), *([F.col("label")] if task == "classification" else [])]
    count, about = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*same), 0.02)).first()
    bins = None
    if about > count * GROUPED_PART:
        bins = learn_bins(rows, count) if boosted and count >= BINNED_ROWS else None
        if bins is None:
            return estimator.fit(rows)
        rows, same[0] = bins.apply(rows), F.col("cell")
    mean = [F.avg("label").alias("label")] if task == "regression" else []
    grouped = rows.groupBy(*same).agg(F.count("*").cast("double").alias("weight"), *mean)
    wanted = max(1, math.ceil(about / PARTITION_ROWS))
    if bins is not None:
        grouped, wanted = grouped.withColumn("values", bins.values()), _partitions(bins.cells)
        # MLlib looks for bins in a sample of this number squared, here in all rows; their own number stays.
        inner = inner.copy().setMaxBins(max(TREE_BINS, math.isqrt(count) + 1))
    grouped = grouped.repartition(wanted, "values").sortWithinPartitions("values", "label")
    grouped = grouped.select("label", "weight", array_to_vector("values").alias("features")).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    inner = inner.copy().setWeightCol("weight")
    if boosted:
        # Rows of a leaf are counted by weight; half a row less keeps rounding out of it.
        least = inner.getMinInstancesPerNode()
        inner = inner.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min((least - 0.5) / count, 0.499))
    if isinstance(estimator, OneVsRest):
        inner = estimator.copy().setClassifier(inner).setWeightCol("weight")
    try:
        return inner.fit(grouped)
    finally:
        grouped.unpersist()


@dataclass(frozen=True)
class Bins:
    """Values that stand for all others of each feature, the nearest one for each. A tree learned from
    them splits halfway between two, which is where their bins meet, so it holds for the values themselves.
    """

    centers: tuple[tuple[float, ...], ...]

    @property
    def cells(self) -> int:
        return math.prod(len(c) for c in self.centers)

    def apply(self, rows: DataFrame) -> DataFrame:
        """label and the number of the cell, which tells the bins of all features."""
        values = vector_to_array("features")
        split = [(i, [(a + b) / 2 for a, b in zip(c, c[1:])]) for i, c in enumerate(self.centers) if len(c) > 1]
        placed = rows.select("label", values.alias("__values")).select("label", *[F.col("__values")[i].alias(f"__v{i}") for i, _ in split])
        if split:
            # A value on a border belongs to the bin below, as in a tree.
            borders = [[float("-inf"), *[math.nextafter(m, math.inf) for m in middles], float("inf")] for _, middles in split]
            outputs = [f"__b{i}" for i, _ in split]
            placed = Bucketizer(splitsArray=borders, inputCols=[f"__v{i}" for i, _ in split], outputCols=outputs).transform(placed)
        cell = F.lit(0).cast("bigint")
        for i, _ in split:
            cell = cell * len(self.centers[i]) + F.col(f"__b{i}").cast("bigint")
        return placed.select("label", cell.alias("cell"))

    def values(self) -> Column:
        """The values that stand for a cell's rows."""
        out, step = [], 1
        for c in reversed(self.centers):
            out.append(double_array(c)[F.expr(f"int((cell div {step}) % {len(c)})")])
            step *= len(c)
        return F.array(*reversed(out))


def learn_bins(rows: DataFrame, count: int) -> Bins | None:
    """Bins of the features, at most TREE_BINS each, that leave few different rows; None if there are none for certain.

    A feature of few values has one for each, others have quantiles.
    """
    width = len(rows.select("features").first()[0])
    most = count * GROUPED_PART
    values = rows.select(vector_to_array("features").alias("values")).select(*[F.col("values")[i].alias(f"v{i}") for i in range(width)])
    some = values.limit(PROOF_ROWS).agg(*[F.count_distinct(f"v{i}") for i in range(width)]).first()
    if math.prod(min(n, TREE_BINS) for n in some) > most:
        return None
    rest = [i for i in range(width) if some[i] <= TREE_BINS]
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in rest])
    different = values.select(F.inline(entries)).distinct() if rest else None
    counts = {r.i: r.n for r in different.groupBy("i").agg(F.count("*").alias("n")).collect()} if rest else {}
    few = [i for i in rest if counts[i] <= TREE_BINS]
    if math.prod(counts[i] if i in few else TREE_BINS for i in range(width)) > most:
        return None
    centers: dict[int, list[float]] = {i: [] for i in few}
    for r in different.where(F.col("i").isin(few)).collect() if few else []:
        centers[r.i].append(r.v)
    many = [i for i in range(width) if i not in few]
    if many:
        ranks = [(k + 0.5) / TREE_BINS for k in range(TREE_BINS)]
        found = values.agg(*[F.percentile_approx(f"v{i}", ranks, QUANTILE_ACCURACY) for i in many]).first()
        centers.update({i: found[k] for k, i in enumerate(many)})
    return Bins(tuple(_apart(centers[i]) for i in range(width)))


def _apart(values: Sequence[float]) -> tuple[float, ...]:
    """The values in order, without those that have no number halfway to the one before."""
    kept: list[float] = []
    for v in sorted(values):
        if not kept or kept[-1] < (kept[-1] + v) / 2 < v:
            kept.append(v)
    return tuple(kept)


def score(model: Model, rows: DataFrame) -> DataFrame:
    """The rows with the model's predictions; one model per class is scored without leaving Spark's own functions."""
    if not isinstance(model, OneVsRestModel):
        return model.transform(rows)
    scored, names = rows, [f"__raw{i}" for i in range(len(model.models))]
    for name, one in zip(names, model.models):
        scored = one.copy({one.rawPredictionCol: name, one.probabilityCol: "", one.predictionCol: ""}).transform(scored)
    raw = F.array(*[vector_to_array(n)[1] for n in names])
    first = (F.array_position("__raws", F.array_max("__raws")) - 1).cast("double")
    kept = scored.withColumn("__raws", raw).select(*[col(c) for c in rows.columns], "__raws")
    return kept.select(*[col(c) for c in rows.columns], array_to_vector("__raws").alias("rawPrediction"), first.alias("prediction"))


def rate(scored: DataFrame, task: str, by: Sequence[str], positive: int | None = None) -> dict[Any, dict[str, float]]:
    if task == "classification":
        rows = M.classification_metrics(scored, "label", "prediction", by, positive).collect()
        names = ("accuracy", "precision", "recall", "f1")
    else:
        rows = M.regression_metrics(scored, "label", "prediction", by).collect()
        names = ("r2", "mae", "rmse")
    return {r[by[0]]: {n: r[n] for n in names} for r in rows}


def feature_importance(model: Model, features: Sequence[str]) -> tuple[tuple[str, float], ...]:
    """Tree importances, or absolute coefficients averaged over classes; strongest first."""
    if hasattr(model, "models"):
        each = [dict(feature_importance(m, features)) for m in model.models]
        values = [sum(e[f] for e in each) / len(each) for f in features]
    elif hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        values = [sum(abs(row[j]) for row in matrix) / len(matrix) for j in range(len(features))]
    else:
        values = [abs(c) for c in model.coefficients.toArray()]
    ranked = sorted(zip(features, values), key=lambda p: -p[1])
    return tuple((f, round(float(v), 4)) for f, v in ranked)


def prepared_folds(data: TrainingSet, folds: int) -> list[DataFrame]:
    """For each fold a table (key, label, fold, features), kept, whose preparation was learned without that fold.

    Folds follow from the row keys; should one be empty, rows are dealt in turn in the order of their hashes.
    With fit_scope "all" the folds share the preparation of the training set.
    """
    if folds < 2:
        raise ValueError("need at least 2 folds")
    fold = fold_number(col(data.key), folds)
    if data.options["fit_scope"] == "all":
        labelled = data.prepared
    else:
        rows = _spread(data.source.select(*[col(c) for c in dict.fromkeys((data.key, data.target, *data.features))]), data.key)
        rows = rows.where(_known_target(rows, data.target, data.task))
        labelled = rows.withColumn(LABEL, _label(rows, data.target, data.classes))
    placed = labelled.withColumn("fold", fold).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    if placed.select("fold").distinct().count() < folds:
        placed.unpersist()
        if labelled.count() < folds:
            raise ValueError(f"{folds} folds need at least {folds} rows")
        placed = deal_folds(labelled, data.key, folds).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    if data.options["fit_scope"] == "all":
        return [placed] * folds
    rows, made = data.train_rows + data.test_rows, {}
    try:
        learned = learn_fold_preparations(placed, data.features, "fold", folds, data.options["listed_categories"])
        for preparation in learned:
            if id(preparation) not in made:
                wide = preparation.transform(placed).select(col(data.key), F.col(LABEL).alias("label"), "fold", "features")
                made[id(preparation)] = _balanced(wide, data.key, rows).persist(StorageLevel.MEMORY_AND_DISK_DESER)
                # Laid out now, while the rows they come from are kept.
                made[id(preparation)].count()
    finally:
        placed.unpersist()
    return [made[id(p)] for p in learned]


def cross_validate(
    data: TrainingSet, estimator: Estimator, folds: int = 5, parallelism: int = 2, prepared: Sequence[DataFrame] | None = None
) -> dict[str, Any]:
    """A score per fold over all rows, each with a preparation learned without the fold.

    Every fold has a score; a fold without one (no two rows, or no variance of a number to explain) is an
    error. Plain linear regression over numbers takes its scores from sums per fold, see linear_cv.
    `prepared` are tables of prepared_folds(), for several estimators in turn.
    """
    if folds < 2:
        raise ValueError("need at least 2 folds")
    name = "accuracy" if data.task == "classification" else "r2"
    if prepared is None and _plain_linear(data, estimator):
        rows = linear_fold_scores(data.source, data.target, data.features, data.key, folds)
        return _cv_summary([r["r2"] if r["r2"] is None else round(r["r2"], 4) for r in rows], name, folds)
    tables = prepared if prepared is not None else prepared_folds(data, folds)

    def one(i: int) -> float | None:
        inside, outside = tables[i].where(F.col("fold") != i), tables[i].where(F.col("fold") == i)
        scored = score(learn(estimator.copy(), inside, data.task), outside)
        found = rate(scored, data.task, ["fold"], data.positive)
        return found[i][name] if i in found else None

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            return _cv_summary(list(pool.map(one, range(folds))), name, folds)
    finally:
        if prepared is None:
            release(tables)


def release(tables: Sequence[DataFrame]) -> None:
    for kept in tables:
        kept.unpersist()


def _plain_linear(data: TrainingSet, estimator: Estimator) -> bool:
    if not isinstance(estimator, LinearRegression) or estimator.getRegParam() or data.options["fit_scope"] == "all":
        return False
    return not any(is_text(data.source, f) for f in data.features)


def _cv_summary(scores: list[float | None], name: str, folds: int) -> dict[str, Any]:
    without = [i for i, s in enumerate(scores) if s is None or math.isnan(s)]
    if without:
        raise ValueError(f"no {name} for fold(s) {', '.join(map(str, without))}: too few rows or no variance")
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    return {"scores": scores, "mean": round(mean, 4), "std": round(spread, 4), "metric": name, "folds": folds}


def train(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    task: str,
    key: str,
    algorithm: str = "auto",
    hyperparams: Mapping[str, Any] | None = None,
    cv_folds: int | None = None,
    run: str = "",
    **options,
) -> TrainResult:
    """Prepare, split, fit and rate in one call. ``key`` identifies rows."""
    return fit(training_set(df, target, features, task, key, **options), algorithm, hyperparams, run, cv_folds)


# More than one model ---------------------------------------------------------------------


def compare_all(data: TrainingSet, hyperparams: Mapping[str, Mapping[str, Any]] | None = None) -> tuple[list[TrainResult], dict[str, str]]:
    """Every algorithm of the task on one prepared table. What fails is reported by name."""
    results, failed = [], {}
    for algorithm in ALGORITHMS[data.task]:
        try:
            results.append(fit(data, algorithm, (hyperparams or {}).get(algorithm)))
        except Exception as error:  # noqa: BLE001 - one model must not stop the others
            failed[algorithm] = str(error)
    if not results:
        raise RuntimeError(f"no algorithm could be trained: {failed}")
    return results, failed


RUN_SCHEMA = (
    "run string, task string, algorithm string, train_score double, test_score double, minority_pct double, "
    "leaky_features int, has_cv boolean, features int, low_features int"
)


def run_table(results: Sequence[TrainResult]) -> DataFrame:
    """One row per result, in the form the diagnosis operators take."""
    rows = [
        (
            r.run,
            r.task,
            r.algorithm,
            r.train_score,
            r.test_score,
            r.data.imbalance["minority_pct"] if r.data.imbalance else None,
            len(r.data.leaky),
            r.cv is not None,
            len(r.data.features),
            sum(v < 0.01 for _, v in r.importance),
        )
        for r in results
    ]
    return results[0].scored.sparkSession.createDataFrame(rows, RUN_SCHEMA)


def importance_table(results: Sequence[TrainResult]) -> DataFrame:
    rows = [(r.run, f, float(v)) for r in results for f, v in r.importance]
    return results[0].scored.sparkSession.createDataFrame(rows, "run string, feature string, importance double")


def metric_table(results: Sequence[TrainResult]) -> DataFrame:
    """Test metrics side by side, one row per result."""
    names = list(results[0].metrics)
    rows = [(r.run, *[float(r.metrics[n]) for n in names]) for r in results]
    schema = "run string, " + ", ".join(f"{n} double" for n in names)
    return results[0].scored.sparkSession.createDataFrame(rows, schema)


def retrain(result: TrainResult, run: str = "", **hyperparams) -> TrainResult:
    """The same data and algorithm with some hyperparameters changed."""
    folds = result.cv["folds"] if result.cv else None
    return fit(result.data, result.algorithm, {**result.hyperparams, **hyperparams}, run or f"{result.run} (edited)", folds)


def drop_low_importance(result: TrainResult, limit: float = 0.01, run: str = "") -> TrainResult:
    """Train again without the features of importance below ``limit``."""
    low = {f for f, v in result.importance if v < limit}
    kept = [f for f in result.data.features if f not in low]
    if not low:
        return result
    if not kept:
        raise ValueError("no feature would be left")
    d = result.data
    data = training_set(d.source, d.target, kept, d.task, d.key, **d.options)
    folds = result.cv["folds"] if result.cv else None
    return fit(data, result.algorithm, result.hyperparams, run or f"{result.run} (fewer features)", folds)


# Tuning ----------------------------------------------------------------------------------

# Search spaces. A pair of ints is a half-open range, a pair of floats a start
# and a length, a list a choice.
SEARCH_SPACES: dict[str, dict[str, Any]] = {
    "random_forest": {
        "n_estimators": (50, 300),
        "max_depth": [None, 5, 8, 12, 20],
        "min_samples_split": (2, 20),
    },
    "xgboost": {
        "n_estimators": (50, 300),
        "max_depth": (3, 12),
        "learning_rate": (0.01, 0.3),
    },
    "lightgbm": {
        "n_estimators": (50, 300),
        "max_depth": [-1, 4, 6, 8, 12],
        "learning_rate": (0.01, 0.3),
        "num_leaves": (10, 80),
    },
    "logistic_regression": {
        "C": (0.01, 10.0),
        "max_iter": [500, 1000, 2000],
    },
}
KEPT_TRIALS = 10


def sample_hyperparams(space: Mapping[str, Any], trials: int, seed: int = SEED) -> list[dict[str, Any]]:
    """Different seeded draws from a search space."""
    rng, found = random.Random(seed), []
    for _ in range(50 * trials):
        draw = {name: _draw(choice, rng) for name, choice in space.items()}
        if draw not in found:
            found.append(draw)
        if len(found) == trials:
            break
    return found


def _draw(choice: Any, rng: random.Random) -> Any:
    if isinstance(choice, list):
        return rng.choice(choice)
    low, other = choice
    if isinstance(low, int):
        return rng.randrange(low, other)
    return round(low + rng.random() * other, 6)


@dataclass(frozen=True)
class TuneResult:
    trials: DataFrame
    best: Mapping[str, Any]
    best_score: float
    metric: str


def tune(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    task: str,
    algorithm: str,
    key: str,
    folds: int = 5,
    trials: int | None = None,
    space: Mapping[str, Any] | None = None,
    parallelism: int = 2,
    seed: int = SEED,
) -> TuneResult:
    """Seeded random search rated by cross-validation. Rows with missing numbers are left out."""
    space = SEARCH_SPACES.get(algorithm) if space is None else space
    if not space:
        raise ValueError(f"{algorithm} has no hyperparameters to tune")
    model_features(df, features)
    complete = df
    for f in features:
        if not is_text(df, f):
            complete = complete.where(finite(df, f).isNotNull())
    data = training_set(complete, target, features, task, key, seed=seed)
    rows = data.train_rows + data.test_rows
    if rows < 10:
        raise ValueError("too few complete rows for tuning; at least 10 are needed")
    trials = trials or min(20, max(5, rows // 100))
    folds = min(folds, rows // 2)
    rated, prepared = [], prepared_folds(data, folds)
    try:
        for draw in sample_hyperparams(space, trials, seed):
            estimator = make_estimator(task, algorithm, rows, max(2, len(data.classes)), **draw)
            rated.append((cross_validate(data, estimator, folds, parallelism, prepared)["mean"], draw))
    finally:
        release(prepared)
        data.release()
    rated.sort(key=lambda t: -t[0])
    table = [
        (i + 1, {k: str(v) for k, v in draw.items()}, float(score)) for i, (score, draw) in enumerate(rated[:KEPT_TRIALS])
    ]
    frame = df.sparkSession.createDataFrame(table, "rank int, hyperparams map<string,string>, score double")
    return TuneResult(frame, rated[0][1], rated[0][0], "accuracy" if task == "classification" else "r2")


# Regularizing ----------------------------------------------------------------------------

# Hyperparameters per level, mildest first.
REGULARIZATION_LEVELS: dict[str, list[tuple[str, dict[str, Any]]]] = {
    "random_forest": [
        ("Mild", {"n_estimators": 100, "max_depth": 12, "min_samples_split": 5}),
        ("Moderate", {"n_estimators": 100, "max_depth": 8, "min_samples_split": 10}),
        ("Strong", {"n_estimators": 80, "max_depth": 5, "min_samples_split": 20}),
        ("Very strong", {"n_estimators": 60, "max_depth": 3, "min_samples_split": 30}),
    ],
    "xgboost": [
        ("Mild", {"n_estimators": 200, "max_depth": 5, "learning_rate": 0.08}),
        ("Moderate", {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05}),
        ("Strong", {"n_estimators": 150, "max_depth": 3, "learning_rate": 0.03}),
        ("Very strong", {"n_estimators": 100, "max_depth": 2, "learning_rate": 0.01}),
    ],
    "lightgbm": [
        ("Mild", {"n_estimators": 200, "max_depth": 8, "learning_rate": 0.08, "num_leaves": 25}),
        ("Moderate", {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.05, "num_leaves": 20}),
        ("Strong", {"n_estimators": 150, "max_depth": 4, "learning_rate": 0.03, "num_leaves": 15}),
        ("Very strong", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.01, "num_leaves": 10}),
    ],
    "logistic_regression": [
        ("Mild", {"C": 0.5, "max_iter": 1000}),
        ("Moderate", {"C": 0.1, "max_iter": 1000}),
        ("Strong", {"C": 0.01, "max_iter": 1000}),
    ],
    "linear_regression": [],
}
RESOLVED_GAP = 0.05
WORSE_GAP = 0.02
KEPT_SHARE = 0.95
RESOLVED_FOR_USER = 0.10


@dataclass(frozen=True)
class Regularized:
    attempts: tuple[tuple[str, Any], ...]
    chosen: Any
    improved: bool
    resolved: bool = field(default=False)
    failed: tuple[tuple[str, str], ...] = ()


def walk_levels(test_score: float, gap: float, levels: Sequence[tuple[str, dict]], attempt: Callable[[str, dict], Any]) -> Regularized:
    """Try stronger levels until the train-test gap is resolved or grows again.

    ``attempt`` gives something with ``test_score`` and ``gap``. An attempt is kept when it
    holds 95 % of the best test score so far and narrows the gap; without one, the mildest.
    A level that cannot be fitted is noted in ``failed`` and passed over.
    """
    best, best_score, narrowest, tried, failed = None, test_score, gap, [], []
    for name, hyperparams in levels:
        try:
            result = attempt(name, hyperparams)
        except (ValueError, ArithmeticError, PySparkException, Py4JError) as error:
            failed.append((name, str(error)[:200]))
            continue
        tried.append((name, result))
        if result.test_score >= best_score * KEPT_SHARE and result.gap < narrowest:
            best, best_score, narrowest = result, result.test_score, result.gap
        if result.gap < RESOLVED_GAP or result.gap > narrowest + WORSE_GAP:
            break
    chosen = best if best is not None else (tried[0][1] if tried else None)
    resolved = chosen is not None and chosen.gap < RESOLVED_FOR_USER
    return Regularized(tuple(tried), chosen, best is not None, resolved, tuple(failed))


def auto_regularize(result: TrainResult, levels: Sequence[tuple[str, dict]] | None = None) -> Regularized:
    levels = REGULARIZATION_LEVELS[result.algorithm] if levels is None else levels
    folds = result.cv["folds"] if result.cv else None

    def attempt(name: str, hyperparams: dict) -> TrainResult:
        return fit(result.data, result.algorithm, hyperparams, f"{result.run} ({name.lower()})", folds)

    return walk_levels(result.test_score, result.gap, levels, attempt)


# Export ----------------------------------------------------------------------------------


def refit_on_all(result: TrainResult) -> PipelineModel:
    """The same model learned from all rows, test side included."""
    d = result.data
    known = d.source.where(_known_target(d.source, d.target, d.task))
    preparation = learn_preparation(known, d.features, d.options["listed_categories"])
    labelled = preparation.transform(known.withColumn(LABEL, _label(known, d.target, d.classes)))
    rows = d.train_rows + d.test_rows
    estimator = make_estimator(d.task, result.algorithm, rows, max(2, len(d.classes)), **result.hyperparams)
    labelled = labelled.select(F.col(LABEL).alias("label"), "features")
    if not preparation.has_code_table:
        return scoring_pipeline(preparation, learn(estimator, labelled, d.task), d.classes)
    # Codes are joined once for all passes over the rows.
    labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    try:
        model = without_rows(learn(estimator, labelled, d.task))
    finally:
        labelled.unpersist()
    return scoring_pipeline(preparation, model, d.classes)


def without_rows(model: Model) -> Model:
    """The model without the summary of its training, which would keep the rows and the files of their exchanges."""
    if isinstance(model, LinearRegressionModel | LogisticRegressionModel):
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def only_model(result: TrainResult) -> TrainResult:
    """The result without its rows, which are not kept any longer; enough to save its model."""
    result.data.release()
    data = replace(result.data, prepared=None)
    return replace(result, data=data, scored=None, estimator_model=without_rows(result.estimator_model))


def save_model(result: TrainResult, path: str) -> PipelineModel:
    model = refit_on_all(result)
    model.write().overwrite().save(path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def renamed(result: TrainResult, run: str) -> TrainResult:
    return replace(result, run=run)
