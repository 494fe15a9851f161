"""Exact Shapley values of forests and boosted trees against given background rows.

A feature of a mixed row comes from the explained row or from a background row. Every tree is walked
once per batch of rows: on the way down, each feature of the path keeps which rows and which background rows
pass all its conditions. At a leaf, features that only the row passes count for it, features that
only the background passes count against it, and the leaf's value is dealt to them by the number of orders.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import col
from ..session import ensure_checkpoint_dir

FORESTS = (RandomForestClassificationModel, RandomForestRegressionModel)
BOOSTED = (GBTClassificationModel, GBTRegressionModel)
# Rows of a batch times background rows that are held against each other at once.
PAIRS = 1 << 14


@dataclass(frozen=True)
class FlatTree:
    """Nodes as arrays; `feature` is -1 for leaves, `groups` holds the left values of splits by category.

    `value` has a column per output, and already the tree's weight in it.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    groups: dict[int, np.ndarray]


def flat_trees(model: Model, spark: SparkSession) -> list[FlatTree]:
    """The trees of a forest or of boosting, read from the table that the model is saved as.

    Outputs are class probabilities of a forest, its prediction, the boosted prediction, or the margin (the raw
    prediction of class 1) of a boosted classifier. They are the sums of the leaves' values.
    """
    if not isinstance(model, FORESTS + BOOSTED):
        raise ValueError(f"{type(model).__name__} has no trees to walk")
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = model.treeWeights if isinstance(model, BOOSTED) else [1.0 / model.getNumTrees] * model.getNumTrees
    nodes: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        nodes.setdefault(row["treeID"], []).append(row["nodeData"])
    shares = isinstance(model, RandomForestClassificationModel)
    return [_flat(sorted(nodes[i], key=lambda n: n["id"]), weight, shares) for i, weight in enumerate(weights)]


def _flat(nodes: Sequence, weight: float, shares: bool) -> FlatTree:
    place = {n["id"]: i for i, n in enumerate(nodes)}
    leaf = np.array([n["leftChild"] < 0 for n in nodes])
    groups = {i: np.array(n["split"]["leftCategoriesOrThreshold"]) for i, n in enumerate(nodes) if not leaf[i] and n["split"]["numCategories"] >= 0}
    if shares:
        stats = np.array([n["impurityStats"] for n in nodes])
        value = stats / stats.sum(axis=1, keepdims=True)
    else:
        value = np.array([[n["prediction"]] for n in nodes])
    return FlatTree(
        np.array([-1 if leaf[i] else n["split"]["featureIndex"] for i, n in enumerate(nodes)]),
        np.array([math.nan if leaf[i] or i in groups else n["split"]["leftCategoriesOrThreshold"][0] for i, n in enumerate(nodes)]),
        np.array([place.get(n["leftChild"], -1) for n in nodes]),
        np.array([place.get(n["rightChild"], -1) for n in nodes]),
        value * weight,
        groups,
    )


def tree_output(tree: FlatTree, x: np.ndarray) -> np.ndarray:
    """The tree's part of the outputs, for each row of x."""
    at = np.zeros(len(x), dtype=int)
    for node in range(len(tree.feature)):  # children come after their parents
        here = np.flatnonzero(at == node) if tree.feature[node] >= 0 else ()
        if len(here):
            at[here] = np.where(_goes_left(tree, node, x[here]), tree.left[node], tree.right[node])
    return tree.value[at]


def _goes_left(tree: FlatTree, node: int, x: np.ndarray) -> np.ndarray:
    values = x[:, tree.feature[node]]
    return np.isin(values, tree.groups[node]) if node in tree.groups else values <= tree.threshold[node]


def _order_shares(most: int) -> np.ndarray:
    """At (p, q): the share of orders in which all of p features but a given one come before it, and q others after."""
    n = np.arange(most + 1)
    whole = np.array([math.factorial(int(i)) for i in range(2 * most + 1)], dtype=object)
    shares = np.zeros((most + 1, most + 1))
    for p in n[1:]:
        shares[p] = [float(whole[p - 1] * whole[q]) / float(whole[p + q]) if p + q < 150 else math.exp(math.lgamma(p) + math.lgamma(q + 1) - math.lgamma(p + q + 1)) for q in n]
    return shares


def shapley_of_tree(tree: FlatTree, x: np.ndarray, background: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Contributions (rows x features) to the output that `pick` names for each row, averaged over the background."""
    out = np.zeros(x.shape)
    shares = _order_shares(len(set(tree.feature.tolist()) - {-1}))

    def walk(node: int, passed: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        if tree.feature[node] < 0:
            if passed:
                deal(tree.value[node][pick], passed)
            return
        f = int(tree.feature[node])
        own, others = _goes_left(tree, node, x), _goes_left(tree, node, background)
        before = passed.get(f, (np.ones(len(x), bool), np.ones(len(background), bool)))
        for child, a, b in ((tree.left[node], own, others), (tree.right[node], ~own, ~others)):
            now = (before[0] & a, before[1] & b)
            if now[0].any() or now[1].any():
                walk(int(child), {**passed, f: now})

    def deal(value: np.ndarray, passed: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        own = {f: a[:, None] & ~b[None, :] for f, (a, b) in passed.items()}
        other = {f: ~a[:, None] & b[None, :] for f, (a, b) in passed.items()}
        reached = np.ones((len(x), len(background)), bool)
        for a, b in passed.values():
            reached &= a[:, None] | b[None, :]
        p, q = sum(m.astype(int) for m in own.values()), sum(m.astype(int) for m in other.values())
        gain, loss = np.where(reached, shares[p, q], 0.0), np.where(reached, shares[q, p], 0.0)
        for f in passed:
            out[:, f] += value * (gain * own[f] - loss * other[f]).mean(axis=1)

    walk(0, {})
    return out


def tree_shapley(
    rows: DataFrame, key: str, model: Model, background: Sequence[Sequence[float]], features: Sequence[str], output: Column | None = None
) -> DataFrame:
    """(key, feature, value, contribution) of every row, for the model output whose number `output` gives (0 if None).

    A row's contributions add up to its output minus the mean output of the background. Rows are independent:
    any number of them can be explained; repeated rows come back each, an empty table gives no rows. The model's
    trees and the background are known to all tasks.
    """
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast((flat_trees(model, spark), np.array(background, dtype=float)))
    names, d = list(features), len(features)
    pick = F.lit(0) if output is None else output.cast("int")
    narrow = rows.select(col(key).alias("row_key"), vector_to_array("features").alias("x"), pick.alias("pick"))

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, pool = known.value
        step = max(1, PAIRS // max(1, len(pool)))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, d)
                found = np.zeros(x.shape)
                for tree in trees:
                    found += shapley_of_tree(tree, x, pool, batch.column(2).to_numpy())
                keys = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), d)))
                yield pa.record_batch([keys, pa.array(names * batch.num_rows, pa.string()), pa.array(x.ravel()), pa.array(found.ravel())], names=["row_key", "feature", "value", "contribution"])

    schema = T.StructType([narrow.schema["row_key"], *T.StructType.fromDDL("feature string, value double, contribution double")])
    return narrow.mapInArrow(attribute, schema).withColumnRenamed("row_key", key)
