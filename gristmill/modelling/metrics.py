"""Model quality from scored rows. Every metric can be taken per group (``by``), so one
query rates thousands of per-segment models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import as_double, col, is_text, named, require_columns, safe_ratio
from ..operators.ordering import match_groups, rows_at, running_totals

PLACES = 4
CLASS_LIMIT = 1_000


def confusion_cells(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (label, prediction) that occur; everything below is computed from these."""
    require_columns(df, label, prediction, *by)
    keys = [*named(by), col(label).alias("actual"), col(prediction).alias("predicted")]
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def classification_metrics(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), positive=None, places: int = PLACES
) -> DataFrame:
    """Accuracy, precision, recall and F1: of the positive class while at most two classes
    occur among the labels, else weighted by class size. Divisions by zero count as 0.

    Rows without a label are left out; a label without a prediction counts as missed. The positive
    class of text labels is the largest that occurs among the labels."""
    cells = confusion_cells(df.where(col(label).isNotNull()), label, prediction, by)
    n, hit = F.col("count"), F.col("actual").eqNullSafe(F.col("predicted"))
    sides = F.array(
        F.struct(
            F.col("actual").cast("string").alias("class"),
            n.alias("support"),
            F.when(hit, n).otherwise(0).alias("hits"),
            F.lit(0).cast("bigint").alias("claimed"),
        ),
        F.struct(
            F.col("predicted").cast(df.schema[label].dataType).cast("string").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.lit(0).cast("bigint").alias("hits"),
            n.alias("claimed"),
        ),
    )
    per_class = (
        cells.select(*named(by), F.explode(sides).alias("s"))
        .where("s.class IS NOT NULL")
        .groupBy(*named(by), F.col("s.class").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.hits").alias("hits"), F.sum("s.claimed").alias("claimed"))
    )
    precision = F.coalesce(safe_ratio(F.col("hits"), F.col("claimed")), F.lit(0.0))
    recall = F.coalesce(safe_ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(safe_ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    ratings = F.struct("p", "r", "f")
    if positive is None and is_text(df, label):
        occurs = F.when(F.col("support") > 0, F.col("class"))
        chosen = F.max_by(ratings, occurs)
    else:
        wanted = F.lit(1 if positive is None else positive).cast(df.schema[label].dataType).cast("string")
        chosen = F.max(F.when(F.col("class") == wanted, ratings))
    rated = per_class.select("*", precision.alias("p"), recall.alias("r"), f1.alias("f"))
    grouped = rated.groupBy(*named(by)).agg(
        F.sum("support").alias("rows"),
        F.count_if(F.col("support") > 0).alias("classes"),
        F.sum("hits").alias("hits"),
        chosen.alias("positive"),
        *[F.sum(F.col(m) * F.col("support")).alias(f"all_{m}") for m in "prf"],
    )

    def value(m: str) -> Column:
        one = F.coalesce(F.col("positive")[m], F.lit(0.0))
        return F.round(F.when(F.col("classes") > 2, F.col(f"all_{m}") / F.col("rows")).otherwise(one), places)

    return grouped.select(
        *named(by),
        F.col("rows"),
        F.round(F.col("hits") / F.col("rows"), places).alias("accuracy"),
        value("p").alias("precision"),
        value("r").alias("recall"),
        value("f").alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence | None = None) -> DataFrame:
    """One row per (actual, predicted) pair of the class grid, also where the count is 0."""
    cells = confusion_cells(df, label, prediction)
    if classes is None:
        seen = cells.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct().limit(CLASS_LIMIT + 1)
        classes = sorted(r.c for r in seen.collect() if r.c is not None)
        if len(classes) > CLASS_LIMIT:
            raise ValueError(f"more than {CLASS_LIMIT} classes")
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], ["actual", "predicted"])
    kinds = {"actual": df.schema[label].dataType, "predicted": df.schema[prediction].dataType}
    grid = grid.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    return grid.join(F.broadcast(cells), ["actual", "predicted"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), places: int = PLACES) -> DataFrame:
    """R squared, mean absolute error and root mean squared error in one aggregation."""
    y, error = as_double(df, label), as_double(df, label) - as_double(df, prediction)
    sums = df.groupBy(*named(by)).agg(
        F.count(error).alias("rows"),
        F.sum(error * error).alias("left"),
        (F.var_pop(y) * F.count(y)).alias("all"),
        F.avg(F.abs(error)).alias("mae"),
    )
    flat = F.when(F.col("left") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("all") > 0, 1 - F.try_divide(F.col("left"), F.col("all"))).otherwise(flat)
    return sums.select(
        *named(by),
        "rows",
        F.round(r2, places).alias("r2"),
        F.round("mae", places).alias("mae"),
        F.round(F.sqrt(F.col("left") / F.col("rows")), places).alias("rmse"),
    )


def _ranked_scores(df: DataFrame, positive: Column, score: Column, by: Sequence[str], **options) -> DataFrame:
    """Distinct scores from high to low with hits and false alarms up to each, and totals."""
    counts = df.groupBy(*named(by), score.cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    running = running_totals(counts, "score", ["pos", "neg"], by, descending=True, **options)
    totals = counts.groupBy(*named(by)).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("points")
    )
    if by:
        return match_groups(running, totals, by)
    row = totals.first()
    return running.withColumns({c: F.lit(row[c]) for c in ("all_pos", "all_neg", "points")})


def roc_curve(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = (), most: int = 200, **options) -> DataFrame:
    """Points (fpr, tpr) from (0, 0) on, scores falling, every k-th so that about ``most`` remain."""
    ranked = _ranked_scores(df, positive, score, by, **options)
    step = F.greatest(F.lit(1), F.floor((F.col("points") + 1) / most))
    fpr = F.coalesce(safe_ratio(F.col("running_neg"), F.col("all_neg")), F.lit(0.0))
    tpr = F.coalesce(safe_ratio(F.col("running_pos"), F.col("all_pos")), F.lit(0.0))
    ord_ = F.col("position") + 1
    kept = ranked.where(ord_ % step == 0).select(*named(by), ord_.cast("bigint").alias("ord"), fpr.alias("fpr"), tpr.alias("tpr"))
    origin = ranked.where("position = 0").select(*named(by), F.lit(0).cast("bigint").alias("ord"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(kept)


def roc_auc(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = (), places: int = PLACES, **options) -> DataFrame:
    """The trapezoid area under the full curve; NULL where one side has no rows."""
    ranked = _ranked_scores(df, positive, score, by, **options)
    area = F.sum(F.col("neg") * (F.col("running_pos") - F.col("pos") / 2.0))
    total = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return ranked.groupBy(*named(by)).agg(F.round(F.try_divide(area, total), places).alias("auc"))


def roc_auc_by_class(df: DataFrame, label: str, scores: str, places: int = PLACES, **options) -> DataFrame:
    """One-against-rest area per class; ``scores`` is an array with one score per class code."""
    require_columns(df, label, scores)
    long = df.select(col(label).cast("int").alias("__label"), F.posexplode(col(scores)).alias("class", "score"))
    return roc_auc(long, F.col("__label") == F.col("class"), F.col("score"), ["class"], places, **options)


def roc_auc_macro(df: DataFrame, label: str, scores: str, places: int = PLACES, **options) -> DataFrame:
    """The mean of the one-against-rest areas."""
    each = roc_auc_by_class(df, label, scores, 12, **options)
    return each.agg(F.round(F.avg("auc"), places).alias("auc"), F.count("auc").alias("classes"))


def residual_sample(df: DataFrame, label: str, prediction: str, order_by: Sequence[str], most: int = 500, **options) -> DataFrame:
    """Prediction and residual of every k-th row of the order, so that about ``most`` remain."""
    rows = df.select(*named(order_by), as_double(df, label).alias("__y"), as_double(df, prediction).alias("__p"))
    picked = rows_at(rows, order_by, lambda n: range(0, n, max(1, n // most)), "position", **options)
    y, p = F.round("__y", PLACES), F.round("__p", PLACES)
    return picked.select("position", y.alias("actual"), p.alias("prediction"), F.round(F.col("__y") - F.col("__p"), PLACES).alias("residual"))
