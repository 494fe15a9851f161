import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from gristmill.modelling import tree_attribution as A

D = 5


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    columns = [(F.pmod(F.xxhash64(i, F.lit(j)), F.lit(1000)) / 1000).alias(f"f{j}") for j in range(D - 1)]
    kind = F.pmod(F.xxhash64(i, F.lit(99)), F.lit(5)).cast("double").alias(f"f{D - 1}")
    df = spark.range(400).select(i.alias("row.id"), *columns, kind)
    y = F.col("f0") * F.col("f1") + F.when(F.col("f4").isin(1.0, 3.0), F.col("f2")).otherwise(0.3)
    df = df.withColumn("y", y).withColumn("label", (F.floor(y * 2.9) % 3).cast("double"))
    assembled = VectorAssembler(inputCols=[f"f{j}" for j in range(D)], outputCol="raw").transform(df)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=5).fit(assembled).transform(assembled).cache()


def enumerated(trees, x, background, pick):
    """Shapley values from all subsets of features."""

    def worth(chosen):
        mixed = background.copy()
        mixed[:, list(chosen)] = x[list(chosen)]
        return sum(A.tree_output(t, mixed)[:, pick] for t in trees).mean()

    out = np.zeros(D)
    for j in range(D):
        rest = [k for k in range(D) if k != j]
        for r in range(D):
            for s in itertools.combinations(rest, r):
                share = math.factorial(r) * math.factorial(D - r - 1) / math.factorial(D)
                out[j] += share * (worth((*s, j)) - worth(s))
    return out


def models():
    yield RandomForestClassifier(numTrees=4, maxDepth=5, seed=1), "probability"
    yield RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=6, seed=1), "prediction"
    yield GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, seed=1), "prediction"
    yield GBTClassifier(labelCol="two", maxIter=4, maxDepth=3, seed=1), "rawPrediction"


@pytest.mark.parametrize("place", range(4))
def test_equals_enumeration_and_adds_up(spark, table, place):
    estimator, output = list(models())[place]
    df = table.withColumn("two", (F.col("label") > 0).cast("double"))
    model = estimator.fit(df)
    matrix = np.array([r[0] for r in df.select(vector_to_array("features")).collect()])
    background, few = matrix[50:57], df.where("`row.id` < 12")
    scored = {r["row.id"]: r for r in model.transform(few).collect()}
    pick = F.lit(2) if output == "probability" else None
    found = A.tree_shapley(few, "row.id", model, background.tolist(), [f"f{j}" for j in range(D)], pick).collect()
    trees, number = A.flat_trees(model, spark), 2 if output == "probability" else 0
    assert any(t.groups for t in trees)
    base = sum(A.tree_output(t, background)[:, number] for t in trees).mean()
    got = {}
    for r in found:
        got.setdefault(r["row.id"], {})[r["feature"]] = r["contribution"]
    assert len(got) == 12 and len(found) == 12 * D
    for key, parts in got.items():
        x = np.array(scored[key]["features"].toArray())
        assert [parts[f"f{j}"] for j in range(D)] == pytest.approx(enumerated(trees, x, background, number), abs=1e-10)
        given = scored[key][output]
        given = given if output == "prediction" else given[2 if output == "probability" else 1]
        assert sum(parts.values()) == pytest.approx(given - base, abs=1e-9)


def test_empty_tables_repeated_rows_and_other_models(spark, table):
    model = RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=3, seed=1).fit(table)
    names, pool = [f"f{j}" for j in range(D)], [[0.5] * (D - 1) + [2.0]]
    assert A.tree_shapley(table.limit(0), "row.id", model, pool, names).count() == 0
    twice = table.where("`row.id` = 3").union(table.where("`row.id` = 3"))
    rows = A.tree_shapley(twice, "row.id", model, pool, names).collect()
    assert len(rows) == 2 * D and len(set(rows)) == D
    with pytest.raises(ValueError):
        A.flat_trees(VectorAssembler(), spark)
