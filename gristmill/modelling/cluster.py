"""Scaling, K-Means, hierarchical clusters, quality, profiles and a 2-D view."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_double, col, double_array, is_text, named, require_columns
from ..operators.ordering import rows_at
from ..session import cut_lineage
from .prepare import inner_names, learn_preparation, model_features

RESTARTS = 10
# Different points per partition while K-Means runs, and runs at a time.
PARTITION_POINTS = 50_000
RUNS_AT_ONCE = 4
FIRST_SEED = 42
MICRO_CLUSTERS = 256
# So many different points are merged without micro-clusters.
EXACT_POINTS = 2_000
PROFILED_FEATURES = 5
NOTABLE_PERCENT = 10.0
POINTS = "point"
# Clusters whose means travel to the tasks as one value.
RATED_AT_ONCE = 1_000


# Scaling ---------------------------------------------------------------------------------


def scale_columns(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / population deviation; 0 where a column does not vary."""
    require_columns(df, *columns)
    terms = [f(as_double(df, c)) for c in columns for f in (F.avg, F.stddev_pop)]
    row = df.agg(*terms).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, spread = row[2 * i], row[2 * i + 1]
        x = as_double(df, c)
        scaled[c + suffix] = (x - F.lit(mean)) / F.lit(spread) if spread else x * 0.0
    return df.withColumns(scaled)


def scaled_points(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(key, point): encoded, imputed and scaled features as one array."""
    require_columns(df, key)
    model_features(df, features)
    prepared = learn_preparation(df, features).transform(df)
    names = inner_names(features)
    scaled = scale_columns(prepared.select(col(key), *named(names)), names, "")
    return scaled.select(col(key), F.array(*named(names)).alias(POINTS))


# K-Means ---------------------------------------------------------------------------------


def kmeans(points: DataFrame, k: int = 3, restarts: int = RESTARTS, seed: int = FIRST_SEED, max_iter: int = 100) -> KMeansModel:
    """The cheapest of several seeded runs."""
    if k < 2:
        raise ValueError("need at least 2 clusters")
    # Equal points are one with a weight. Their partitions follow from the points alone.
    distinct = points.groupBy(POINTS).agg(F.count("*").cast("double").alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    vectors = None
    try:
        wanted = max(1, math.ceil(distinct.count() / PARTITION_POINTS))
        laid = distinct.repartition(wanted, POINTS).sortWithinPartitions(POINTS)
        vectors = laid.select(array_to_vector(POINTS).alias("features"), "weight").persist(StorageLevel.MEMORY_AND_DISK)
        vectors.count()
        distinct.unpersist()

        def run(i: int) -> KMeansModel:
            return KMeans(k=k, seed=seed + i, maxIter=max_iter, weightCol="weight").fit(vectors)

        with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
            return min(pool.map(run, range(restarts)), key=lambda m: m.summary.trainingCost)
    finally:
        distinct.unpersist()
        if vectors is not None:
            vectors.unpersist()


def squared_distance(point: Column, center: Column) -> Column:
    parts = F.zip_with(point, center, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def assign_nearest(points: DataFrame, centers: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    """The nearest of a few given centers, the first of equally near ones."""
    distances = F.array(*[squared_distance(F.col(POINTS), double_array(c)) for c in centers])
    nearest = F.array_position(distances, F.array_min(distances)) - 1
    return points.withColumn(name, nearest.cast("int"))


# Hierarchical ----------------------------------------------------------------------------


def ward_groups(centers: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Merge weighted centers by Ward's criterion until ``k`` groups are left, numbered by their first member.

    Ward's costs never fall when groups grow, so the merges of chains of nearest neighbours, taken in
    the order of their costs, are those of always merging the cheapest pair (but for equal costs).
    One row of distances is held at a time.
    """
    merges = sorted(_chain_merges(centers, weights), key=lambda m: m[0])[: max(0, len(centers) - k)]
    first = list(range(len(centers)))

    def group(i: int) -> int:
        while first[i] != i:
            first[i] = first[first[i]]
            i = first[i]
        return i

    for _, a, b in merges:
        a, b = sorted((group(a), group(b)))
        first[b] = a
    heads = [group(i) for i in range(len(centers))]
    number = {head: n for n, head in enumerate(sorted(set(heads)))}
    return [number[head] for head in heads]


def _chain_merges(centers: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges as (cost, member, member); a merge comes after those of its parts."""
    at, weight = centers.astype(float), weights.astype(float)
    alive = np.ones(len(at), dtype=bool)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    while len(merges) < len(at) - 1:
        tip = chain[-1] if chain else int(np.argmax(alive))
        chain = chain or [tip]
        cost = ((at - at[tip]) ** 2).sum(1) * (weight * weight[tip] / (weight + weight[tip]))
        cost[~alive] = np.inf
        cost[tip] = np.inf
        nearest = int(np.argmin(cost))
        before = chain[-2] if len(chain) > 1 else None
        if before is None or cost[nearest] < cost[before]:
            chain.append(nearest)
            continue
        merges.append((float(cost[before]), tip, before))
        total = weight[tip] + weight[before]
        at[before] = (at[tip] * weight[tip] + at[before] * weight[before]) / total
        weight[before] = total
        alive[tip] = False
        del chain[-2:]
    return merges


def hierarchical(
    points: DataFrame, k: int = 3, micro: int = MICRO_CLUSTERS, seed: int = FIRST_SEED, exact: int = EXACT_POINTS
) -> DataFrame:
    """Ward clusters. Up to ``exact`` different points (or ``micro``, if more) are merged themselves, weighted by their rows;
    of more, K-Means micro-clusters are, so the rows are only ever assigned."""
    micro = max(micro, 3 * k)
    distinct = points.groupBy(POINTS).agg(F.count("*").alias("__rows"))
    most = max(exact, micro)
    found = distinct.limit(most + 1).collect()
    if len(found) < k:
        raise ValueError(f"fewer than {k} different points")
    if len(found) <= most:
        found = sorted(found, key=lambda r: list(r[POINTS]))
        groups = ward_groups(np.array([r[POINTS] for r in found]), np.array([r["__rows"] for r in found]), k)
        schema = T.StructType([T.StructField("__point", points.schema[POINTS].dataType), T.StructField("cluster", T.IntegerType())])
        labels = points.sparkSession.createDataFrame([(r[POINTS], g) for r, g in zip(found, groups)], schema)
        return points.join(F.broadcast(labels), F.col(POINTS) == F.col("__point")).drop("__point")
    model = kmeans(points, micro, restarts=1, seed=seed)
    scored = model.setFeaturesCol("__v").setPredictionCol("__micro").transform(points.withColumn("__v", array_to_vector(POINTS)))
    sizes = {r["__micro"]: r["count"] for r in scored.groupBy("__micro").count().collect()}
    used = sorted(sizes)
    centers = np.array([model.clusterCenters()[i] for i in used])
    groups = ward_groups(centers, np.array([sizes[i] for i in used]), k)
    labels = points.sparkSession.createDataFrame(list(zip(used, groups)), "__of int, cluster int")
    return scored.join(F.broadcast(labels), F.col("__micro") == F.col("__of")).drop("__v", "__micro", "__of")


# Quality ---------------------------------------------------------------------------------


def cluster_sizes(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows per cluster and the number of clusters, noise (-1) not counted as one."""
    sizes = labels.groupBy(col(cluster).alias("cluster")).agg(F.count("*").alias("size"))
    found = labels.where(col(cluster) != -1).select(col(cluster)).distinct().agg(F.count("*")).scalar()
    return sizes.select("cluster", "size", found.alias("n_clusters"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)


def silhouette_rows(points: DataFrame, cluster: str = "cluster", at_once: int = RATED_AT_ONCE) -> DataFrame:
    """Per row, the silhouette under squared Euclidean distance.

    The mean squared distance from x to a cluster is |x|^2 + mean|y|^2 - 2 x . mean(y), so one
    pass for the cluster means and one projection are exact, without any pair of rows. The
    means travel to the tasks in values of about ``at_once`` clusters each.
    """
    first = points.select(F.size(POINTS)).first()
    if first is None:
        raise ValueError("no points")
    x = F.col(POINTS)
    means = [F.avg(x[j]) for j in range(first[0])]
    stats = points.groupBy(col(cluster).alias("c")).agg(F.count("*").alias("n"), F.avg(_dot(x, x)).alias("q"), F.array(*means).alias("m"))
    stats = cut_lineage(stats)
    clusters = stats.count()
    if clusters < 2:
        raise ValueError("silhouette needs at least 2 clusters")
    entries = F.collect_list(F.struct("c", "n", "q", "m"))
    nothing = F.lit(None).cast("double")
    rated = points.withColumns({"__norm": _dot(x, x), "__a": nothing, "__b": nothing})
    parts = math.ceil(clusters / at_once)
    part = F.pmod(F.xxhash64("c"), F.lit(parts))
    for i in range(parts):
        rated = rated.withColumn("__stats", stats.where(part == i).agg(entries).scalar())
        distance = F.transform("__stats", lambda s: F.greatest(F.col("__norm") + s["q"] - 2 * _dot(x, s["m"]), F.lit(0.0)))
        rated = rated.withColumn("__means", distance)
        rated = rated.withColumn("__at", F.array_position(F.col("__stats.c"), col(cluster)).cast("int"))
        here = F.when(F.col("__at") > 0, F.col("__at"))
        n = F.element_at(F.col("__stats.n"), here).cast("double")
        own = F.when(n > 1, F.element_at("__means", here) * n / (n - 1))
        other = F.array_min(F.filter("__means", lambda m, i: i + 1 != F.col("__at")))
        rated = rated.withColumns({"__a": F.coalesce("__a", own), "__b": F.least("__b", other)})
    value = F.coalesce(F.try_divide(F.col("__b") - F.col("__a"), F.greatest("__a", "__b")), F.lit(0.0))
    value = F.when(F.col("__a").isNull(), F.lit(0.0)).otherwise(value)
    return rated.withColumn("silhouette", value).drop("__stats", "__norm", "__means", "__at", "__a", "__b")


def silhouette_sq(points: DataFrame, cluster: str = "cluster", places: int = 4) -> DataFrame:
    return silhouette_rows(points, cluster).agg(F.round(F.avg("silhouette"), places).alias("silhouette_sq"))


# Description -----------------------------------------------------------------------------


def cluster_profile(df: DataFrame, cluster: str, features: Sequence[str], most: int = PROFILED_FEATURES) -> DataFrame:
    """Per cluster and feature: size, mean and its difference to the global mean in percent,
    or the most frequent text. Noise (-1) is left out, but counts in the global means."""
    features = list(features)[:most]
    require_columns(df, cluster, *features)
    texts = [f for f in features if is_text(df, f)]
    numbers = [f for f in features if f not in texts]
    members = df.where(col(cluster) != -1)
    sizes = members.groupBy(col(cluster).alias("cluster")).agg(
        F.count("*").alias("size"), *[F.avg(as_double(df, f)).alias(f"m{i}") for i, f in enumerate(numbers)]
    )
    parts = []
    if numbers:
        overall = df.agg(*[F.avg(as_double(df, f)) for f in numbers]).first()
        rows = []
        for i, f in enumerate(numbers):
            mean, base = F.col(f"m{i}"), overall[i]
            percent = (mean - F.lit(base)) / F.lit(abs(base)) * 100.0 if base else F.lit(None).cast("double")
            side = F.when(percent >= NOTABLE_PERCENT, "higher").when(percent <= -NOTABLE_PERCENT, "lower")
            rows.append(
                F.struct(F.lit(f).alias("feature"), mean.alias("mean"), percent.alias("percent"), side.alias("side"), F.lit(None).cast("string").alias("mode"))
            )
        parts.append(sizes.select("cluster", "size", F.inline(F.array(*rows))))
    if texts:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), col(f).alias("value")) for f in texts])
        counts = members.select(col(cluster).alias("cluster"), F.inline(pairs)).where("value IS NOT NULL")
        counts = counts.groupBy("cluster", "feature", "value").agg(F.count("*").alias("n"))
        modes = counts.groupBy("cluster", "feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
        blank = F.lit(None).cast("double")
        parts.append(
            sizes.select("cluster", "size")
            .join(modes, "cluster")
            .select("cluster", "size", "feature", blank.alias("mean"), blank.alias("percent"), F.lit(None).cast("string").alias("side"), "mode")
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def describe_clusters(profile: DataFrame) -> DataFrame:
    """Per cluster, which features are clearly higher or lower than overall."""
    def listed(side: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("feature"))))

    return profile.groupBy("cluster", "size").agg(listed("higher").alias("higher"), listed("lower").alias("lower"))


@dataclass(frozen=True)
class Projection:
    points: DataFrame
    explained: tuple[float, float]


def project_2d(points: DataFrame, key: str, most: int = 1_000, extra: Sequence[str] = ()) -> Projection:
    """The first two principal components of scaled points, every k-th row of the key order.

    Signs are fixed so that the largest loading of each component is positive."""
    width = points.select(F.size(POINTS)).first()[0]
    if width < 2:
        raise ValueError("a 2-D view needs at least 2 features")
    vectors = points.withColumn("__v", array_to_vector(POINTS))
    model = PCA(k=2, inputCol="__v", outputCol="__pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] > 0 else -1.0 for j in range(2)]
    picked = rows_at(points.select(col(key), POINTS, *named(extra)), [key], lambda n: range(0, n, max(1, n // most)), "position")
    projected = model.transform(picked.withColumn("__v", array_to_vector(POINTS))).withColumn("__pc", vector_to_array("__pc"))
    x, y = (F.round(F.col("__pc")[j] * signs[j], 4) for j in range(2))
    kept = projected.select(col(key), "position", *named(extra), x.alias("x"), y.alias("y"))
    explained = tuple(round(float(v), 4) for v in model.explainedVariance.toArray())
    return Projection(kept, explained)


@dataclass(frozen=True)
class ClusterResult:
    labels: DataFrame
    n_clusters: int
    silhouette_sq: float | None


def cluster(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    algorithm: str = "kmeans",
    k: int = 3,
    eps: float = 0.5,
    min_samples: int = 5,
) -> ClusterResult:
    """Scale, cluster and rate; ``labels`` has (key, point, cluster)."""
    from .density import dbscan

    points = scaled_points(df, features, key).persist(StorageLevel.MEMORY_AND_DISK)
    if algorithm == "kmeans":
        model = kmeans(points, k)
        scored = model.transform(points.withColumn("features", array_to_vector(POINTS)))
        labels = scored.select(*named(points.columns), F.col("prediction").alias("cluster"))
    elif algorithm == "hierarchical":
        labels = hierarchical(points, k)
    elif algorithm == "dbscan":
        labels = dbscan(points, key, eps, min_samples)
    else:
        raise ValueError(f"unknown algorithm: {algorithm}")
    found = cluster_sizes(labels).first()
    n = found.n_clusters if found else 0
    rated = silhouette_sq(labels).first()[0] if n > 1 else None
    return ClusterResult(labels, n, rated)
