"""Why a model predicts what it predicts: contributions per row and feature."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import as_double, col, double_array, hash_number, long_array, named, require_columns
from .train import TrainResult
from .tree_attribution import FORESTS, tree_shapley

SAMPLES = 5
PERMUTATIONS = 16
BACKGROUND = 16
LISTED = 10
PLACES = 4


def linear_attribution(
    df: DataFrame, key: str, coefficients: Mapping[str, float], means: Mapping[str, float] | None = None
) -> DataFrame:
    """coefficient * (x - mean) per row and feature; means come from the table if not given."""
    features = list(coefficients)
    require_columns(df, key, *features)
    if means is None:
        row = df.agg(*[F.avg(as_double(df, f)) for f in features]).first()
        means = dict(zip(features, row))
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                as_double(df, f).alias("value"),
                ((as_double(df, f) - F.lit(means[f])) * F.lit(float(coefficients[f]))).alias("contribution"),
            )
            for f in features
        ]
    )
    return df.select(col(key), F.inline(entries))


def top_contributions(attributions: DataFrame, key: str, most: int = LISTED, places: int = PLACES) -> DataFrame:
    """The strongest contributions of each row by absolute size, rank from 1."""
    order = Window.partitionBy(col(key)).orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = attributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.withColumn("contribution", F.round("contribution", places))


def push_pull(attributions: DataFrame, key: str, each: int = 2) -> DataFrame:
    """The features that push each row's prediction up and pull it down the most."""
    side = F.when(F.col("contribution") > 0, "push").when(F.col("contribution") < 0, "pull")
    sided = attributions.withColumn("direction", side).where(F.col("direction").isNotNull())
    order = Window.partitionBy(col(key), "direction").orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = sided.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return ranked.select(col(key), "direction", "rank", "feature", "contribution")


def sampled_shapley(
    rows: DataFrame,
    key: str,
    model: Model,
    background: Sequence[Sequence[float]],
    features: Sequence[str],
    output: Column,
    permutations: int = PERMUTATIONS,
    seed: int = 42,
    places: int | None = None,
) -> DataFrame:
    """Shapley values of ``output`` over random feature orders and given background rows.

    Each row is walked from a background row to itself, one feature at a time, along each
    order; a feature gets the average change of the output at its step. The walks are rows
    of one table, scored by the model in one pass and averaged per (row, feature), so the
    contributions of a row add up to its output minus the mean background output. Rows are
    independent of each other: any number of them can be explained.
    """
    d, rng = len(features), random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = list(range(d))
        rng.shuffle(order)
        orders.append(order)
    ranks = [[o.index(j) for j in range(d)] for o in orders]
    walks = F.array(
        *[F.struct(long_array(o).alias("order"), long_array(r).alias("place")) for o, r in zip(orders, ranks)]
    )
    base = rows.select(col(key), vector_to_array("features").alias("__x"))
    base = base.withColumn("__b", F.explode(F.array(*[double_array(b) for b in background])))
    base = base.withColumn("__w", F.explode(walks)).withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = F.transform("__x", lambda x, j: F.when(F.element_at("__w.place", j + 1) < F.col("__step"), x).otherwise(F.element_at("__b", j + 1)))
    scored = model.transform(base.withColumn("features", array_to_vector(mixed)))
    scored = scored.select(col(key), "__x", F.col("__w.order").alias("__order"), "__step", output.cast("double").alias("__y"))
    # Position 0 is outside an array and an error to ask for, so it is avoided for the first step.
    last = F.element_at("__order", F.greatest(F.col("__step"), F.lit(1)))
    coming = F.try_element_at("__order", F.col("__step") + 1)
    gained = F.when(F.col("__step") > 0, F.struct(last.alias("j"), F.col("__y").alias("y")))
    given = F.when(F.col("__step") < d, F.struct(coming.alias("j"), (-F.col("__y")).alias("y")))
    parts = scored.select(col(key), "__x", F.explode(F.array(gained, given)).alias("p")).where("p IS NOT NULL")
    total = float(permutations * len(background))
    names = F.array(*[F.lit(f) for f in features])
    summed = parts.groupBy(col(key), F.col("p.j").alias("__j")).agg(
        (F.sum("p.y") / total).alias("contribution"), F.first(F.element_at("__x", F.col("p.j").cast("int") + 1)).alias("value")
    )
    value = F.col("contribution") if places is None else F.round("contribution", places)
    return summed.select(col(key), F.element_at(names, F.col("__j").cast("int") + 1).alias("feature"), "value", value.alias("contribution"))


def background_rows(result: TrainResult, size: int = BACKGROUND) -> list[list[float]]:
    """Training rows with the smallest key hashes."""
    side = result.data.train_side.orderBy(hash_number(col(result.data.key), "background", 13)).limit(size)
    return [[float(v) for v in r[0]] for r in side.select(vector_to_array("features")).collect()]


def explain(result: TrainResult, n: int | None = SAMPLES, permutations: int = PERMUTATIONS, background: int = BACKGROUND) -> DataFrame:
    """(key, feature, value, contribution) for the first ``n`` test rows, or all of them.

    Linear models have a closed form on the scale of their linear term. For trees the
    output is the prediction, or the probability of class 1; with more classes, of the
    predicted class. Forests and boosted regression are exact for the background rows; other
    probabilities are no sums over trees and are sampled over `permutations` orders.
    """
    data, model = result.data, result.estimator_model
    test = result.test_side
    if n is not None:
        test = test.orderBy(col(data.key)).limit(n)
    coefficients = getattr(model, "coefficients", None) if len(data.classes) <= 2 else None
    if result.algorithm in ("linear_regression", "logistic_regression") and coefficients is not None:
        flat = test.select(col(data.key), *_components("features", data.features))
        train = data.train_side.select(*_components("features", data.features))
        means = dict(zip(data.features, train.agg(*[F.avg(col(f)) for f in data.features]).first()))
        return linear_attribution(flat, data.key, dict(zip(data.features, coefficients.toArray())), means)
    pool = background_rows(result, background)
    if isinstance(model, (*FORESTS, GBTRegressionModel)):
        chosen = None if data.task == "regression" else F.lit(1) if len(data.classes) == 2 else F.col("prediction")
        return tree_shapley(test, data.key, model, pool, data.features, chosen)
    if data.task == "regression":
        return sampled_shapley(test, data.key, model, pool, data.features, F.col("prediction"), permutations)
    scores = vector_to_array("probability" if "probability" in test.columns else "rawPrediction")
    if len(data.classes) == 2:
        return sampled_shapley(test, data.key, model, pool, data.features, scores[1], permutations)
    parts = []
    for code in range(len(data.classes)):
        of_class = test.where(F.col("prediction") == code)
        parts.append(sampled_shapley(of_class, data.key, model, pool, data.features, scores[code], permutations))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _components(vector: str, features: Sequence[str]) -> list[Column]:
    values = vector_to_array(vector)
    return [values[i].alias(f) for i, f in enumerate(features)]


def explained_predictions(result: TrainResult, attributions: DataFrame, most: int = LISTED) -> DataFrame:
    """Top contributions next to the prediction, decoded for classes."""
    key = result.data.key
    shown = F.col("predicted_label") if result.data.classes else F.round("prediction", PLACES).cast("string")
    predictions = result.test_side.select(col(key), shown.alias("predicted"))
    return top_contributions(attributions, key, most).join(predictions, key).select(
        *named([key]), "predicted", "rank", "feature", F.round("value", PLACES).alias("value"), "contribution"
    )
