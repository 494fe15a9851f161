"""From a table to model input: encoding, imputation, target codes, screens and guards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import as_double, col, is_numeric, is_scalar, is_text, quoted, require_columns, text_literal
from ..operators.charts import pair_correlations
from ..operators.ordering import column_medians, medians_without
from .categories import CategoryCodes, code_table, join_codes

# Fixed value: the category of missing text.
MISSING = "__missing__"
# Code tables of at most this many texts are broadcast as a whole.
BROADCAST_CATEGORIES = 100_000
# Features of at most this many texts are coded from a list in the model, others from a written table.
LISTED_CATEGORIES = 10_000
# An estimated number of texts above the limit by this much is above it for certain (five standard errors).
FEW_MARGIN = 1.1
# Rows for each listed category in which a column may show that it has more.
PROOF_ROWS = 4
MAX_CLASSES = 1_000
LEAKAGE_LIMIT = 0.95
IMBALANCE_LIMIT = 20.0


# Encoding and imputation as table operators ----------------------------------------------


def label_encode(df: DataFrame, column: str, name: str | None = None, broadcast_limit: int = BROADCAST_CATEGORIES) -> DataFrame:
    """Codes 0, 1, 2, ... in sorted text order, missing values being a category of their own.

    Up to ``broadcast_limit`` categories the code table is broadcast; beyond it the codes come
    from the distributed row index, and only those of frequent texts are broadcast.
    """
    require_columns(df, column)
    name = name or f"{column}_code"
    text = F.coalesce(col(column).cast("string"), F.lit(MISSING))
    categories = df.select(text.alias("__text")).distinct()
    if categories.limit(broadcast_limit + 1).count() > broadcast_limit:
        codes, sizes = code_table(df, [text])
        return join_codes(df, text, codes, name, size=sizes[0])
    ranked = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("__text")) - 1
    codes = F.broadcast(categories.withColumn(name, ranked.cast("bigint")))
    return df.withColumn("__text", text).join(codes, "__text").drop("__text")


def finite(df: DataFrame, name: str) -> Column:
    """The column as double with NaN and infinities read as missing."""
    x = as_double(df, name)
    return F.when(F.abs(x) != float("inf"), x)


def impute_median(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Missing, NaN and infinite values become the exact median, or 0 without any value."""
    require_columns(df, *columns)
    clean = df.withColumns({c: finite(df, c) for c in columns})
    medians = column_medians(clean, columns, **options)
    return clean.fillna({c: medians[c] if medians[c] is not None else 0.0 for c in columns})


def prepare_target(df: DataFrame, target: str, null_target: str = "drop", name: str = "label", **options) -> DataFrame:
    """Text targets as sorted codes, numbers as doubles.

    Rows without a target are dropped; with ``null_target='impute'`` missing text is the
    class ``nan`` and missing numbers become the median.
    """
    require_columns(df, target)
    if null_target not in ("drop", "impute"):
        raise ValueError("null_target is drop or impute")
    if is_text(df, target):
        filled = df.withColumn(target, F.coalesce(col(target), F.lit("nan"))) if null_target == "impute" else df
        return label_encode(filled.where(col(target).isNotNull()), target, name)
    kept = df.withColumn(name, finite(df, target))
    if null_target == "drop":
        return kept.where(col(name).isNotNull())
    return impute_median(kept, [name], **options)


# Screens ---------------------------------------------------------------------------------


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows and percent per class, the smallest share, and whether it is below the limit."""
    require_columns(df, target)
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    total, least = counts.agg(F.sum("count")).scalar(), counts.agg(F.min("count")).scalar()
    return counts.select(
        "class",
        "count",
        F.round(F.col("count") / total * 100, 2).alias("percent"),
        F.round(least / total * 100, 2).alias("minority_pct"),
        (F.round(least / total * 100, 2) < IMBALANCE_LIMIT).alias("imbalanced"),
    )


def leakage_check(df: DataFrame, features: Sequence[str], target: str, limit: float = LEAKAGE_LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Numeric features whose correlation with the target is suspiciously high."""
    require_columns(df, target, *features)
    pairs = [(f, target) for f in features if is_numeric(df, f)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, correlation double")
    found = pair_correlations(df, pairs, by)
    return found.where(F.abs("r") > limit).select(
        *[col(b) for b in by], F.col("col_a").alias("feature"), F.round("r", 4).alias("correlation")
    )


def feature_screen(profile: DataFrame) -> DataFrame:
    """Flags per profiled column: looks like an identifier, has one value, is mostly missing."""
    rows, unique = F.col("count"), F.col("unique_count")
    return profile.select(
        "name",
        (unique >= F.least(rows * 0.9, rows - 1.0)).alias("id_like"),
        (unique <= 1).alias("low_variance"),
        (F.col("null_percent") > 50).alias("high_nulls"),
    )


def default_features(profile: DataFrame, target: str | None = None) -> DataFrame:
    """All columns but the target and those that look like identifiers."""
    screened = feature_screen(profile).where(~F.coalesce("id_like", F.lit(False)))
    if target is not None:
        screened = screened.where(F.col("name") != target)
    return screened.select("name", "low_variance", "high_nulls")


def target_suggestions(profile: DataFrame, task: str) -> DataFrame:
    unique = F.col("unique_count")
    if task == "classification":
        fits = unique.between(2, 20)
    elif task == "regression":
        fits = F.col("dtype").isin("f64", "i64", "f32", "i32") & (unique > 10)
    else:
        raise ValueError(f"no targets for task {task}")
    return profile.where(fits).select("name", "dtype", "unique_count")


def choose_algorithm(task: str, rows: int, features: int = 0, text_features: int = 0, clusters: int = 3) -> str:
    """The default algorithm for a table of this shape."""
    if task == "clustering":
        return "dbscan" if clusters == 3 else "kmeans"
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task: {task}")
    if rows >= 10_000:
        return "lightgbm"
    if rows >= 1_000:
        return "random_forest"
    if task == "regression":
        return "linear_regression"
    return "random_forest" if features and text_features > features * 0.5 else "logistic_regression"


# Preparation for MLlib -------------------------------------------------------------------


@dataclass(frozen=True)
class Preparation:
    """Fitted input stages: they clean, encode and assemble ``features`` into a vector."""

    features: tuple[str, ...]
    fills: dict[str, float]
    categories: dict[str, list[str]]
    stages: tuple[Transformer, ...]

    @property
    def has_code_table(self) -> bool:
        return any(isinstance(s, CategoryCodes) for s in self.stages)

    def transform(self, df: DataFrame) -> DataFrame:
        return PipelineModel(list(self.stages)).transform(df)


def model_features(df: DataFrame, features: Sequence[str]) -> None:
    require_columns(df, *features)
    if not features:
        raise ValueError("no features selected")
    wrong = [f for f in features if not is_scalar(df, f)]
    if wrong:
        raise ValueError(f"columns without a scalar type cannot be features: {', '.join(wrong)}")


def learn_preparation(
    df: DataFrame, features: Sequence[str], listed_categories: int = LISTED_CATEGORIES, **options
) -> Preparation:
    """Learn category codes and medians from ``df`` (normally the training side) and build
    persistable stages from them.

    Text features take their codes in sorted order, missing text being a category and unseen text
    having the code after the last. Up to ``listed_categories`` texts are a list in the model; features
    with more have a code table, which is saved with the model and joined.
    """
    model_features(df, features)
    texts = [f for f in features if is_text(df, f)]
    numbers = [f for f in features if f not in texts]
    clean = df.select(*[finite(df, f).alias(f) for f in numbers]) if numbers else df
    medians = column_medians(clean, numbers, **options)
    categories = _categories(df, texts, listed_categories)
    wide = [f for f in texts if f not in categories]
    codes = code_table(df, [F.coalesce(col(f), F.lit(MISSING)) for f in wide]) if wide else None
    return _preparation(df, features, _fills(medians, numbers), categories, codes)


def learn_fold_preparations(
    df: DataFrame, features: Sequence[str], fold: str, folds: int, listed_categories: int = LISTED_CATEGORIES
) -> list[Preparation]:
    """learn_preparation() without each fold in turn, from passes shared by all folds.

    Preparations that treat all rows of ``df`` alike are one object: a median matters only where a value is missing.
    """
    model_features(df, features)
    texts = [f for f in features if is_text(df, f)]
    numbers = [f for f in features if f not in texts]
    held = _fold_categories(df, texts, fold, folds, listed_categories)
    if held is None:
        return [learn_preparation(df.where(col(fold) != k), features, listed_categories) for k in range(folds)]
    names = dict(zip(numbers, inner_names(numbers)))
    clean = df.select(col(fold), *[finite(df, f).alias(names[f]) for f in numbers])
    gaps = clean.agg(F.lit(0), *[F.count_if(col(names[f]).isNull()) for f in numbers]).first()
    medians = medians_without(clean, list(names.values()), fold, folds)
    found: dict[tuple, Preparation] = {}
    out = []
    for k in range(folds):
        fills = _fills({f: medians[k][names[f]] for f in numbers}, numbers)
        alike = (tuple(fills[f] for i, f in enumerate(numbers) if gaps[1 + i]), tuple(tuple(held[k][f]) for f in texts))
        if alike not in found:
            found[alike] = _preparation(df, features, fills, held[k], None)
        out.append(found[alike])
    return out


def _fills(medians: dict[str, float | None], numbers: Sequence[str]) -> dict[str, float]:
    return {f: float(medians[f]) if medians[f] is not None else 0.0 for f in numbers}


def _preparation(
    df: DataFrame, features: Sequence[str], fills: dict[str, float], categories: dict[str, list[str]], codes: tuple[DataFrame, list[int]] | None
) -> Preparation:
    texts = [f for f in features if is_text(df, f)]
    numbers = [f for f in features if f not in texts]
    listed, wide = [f for f in texts if f in categories], [f for f in texts if f not in categories]
    text, place, number = (dict(zip(features, inner_names(features, kind))) for kind in ("txt", "idx", "num"))
    stages: list[Transformer] = [
        _select([f"coalesce({_finite_sql(df, f)}, double('{fills[f]!r}')) AS {quoted(number[f])}" for f in numbers]
                + [f"coalesce({quoted(f)}, {text_literal(MISSING)}) AS {quoted(text[f])}" for f in texts])
    ]
    if listed:
        stages.append(
            StringIndexerModel.from_arrays_of_labels(
                [categories[f] for f in listed],
                inputCols=[text[f] for f in listed],
                outputCols=[place[f] for f in listed],
                handleInvalid="keep",
            )
        )
        # Plain numbers: as nominal columns they would need a tree bin per category.
        stages.append(_select([f"{quoted(place[f])} + double('0') AS {quoted(number[f])}" for f in listed]))
    if wide:
        stages.append(CategoryCodes([text[f] for f in wide], [number[f] for f in wide], codes[1]).over(codes[0]))
    stages.append(VectorAssembler(inputCols=[number[f] for f in features], outputCol="features"))
    return Preparation(tuple(features), fills, categories, tuple(stages))


def inner_names(features: Sequence[str], kind: str = "num") -> list[str]:
    """Names of prepared columns. MLlib reads a dot as a path, so names with one go by their place."""
    return [f"__feature{i}__{kind}" if "." in f or "`" in f else f"{f}__{kind}" for i, f in enumerate(features)]


def _select(expressions: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement="SELECT *, " + ", ".join(expressions) + " FROM __THIS__")


def _finite_sql(df: DataFrame, name: str) -> str:
    c, dtype = quoted(name), df.schema[name].dataType
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        days = f"unix_date(CAST({c} AS DATE)) * double('86400')"
        if isinstance(dtype, T.DateType):
            return days
        return f"{days} + hour({c}) * double('3600') + minute({c}) * double('60') + CAST(date_part('SECOND', {c}) AS DOUBLE)"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({c}) / double('1000000')"
    x = f"CAST({c} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({x}) AND abs({x}) < double('Infinity') THEN {x} END"


def _categories(df: DataFrame, names: Sequence[str], limit: int) -> dict[str, list[str]]:
    """The sorted distinct texts of each column that has at most ``limit``, from one grouping of (column, text) pairs."""
    if not names:
        return {}
    texts = {n: F.coalesce(col(n), F.lit(MISSING)) for n in names}
    # Some rows with more texts than the limit prove a column to have them; only the others are looked at in all rows.
    some = df.select(*[t.alias(f"t{i}") for i, t in enumerate(texts.values())]).limit(PROOF_ROWS * (limit + 1))
    proven = some.agg(*[F.count_distinct(F.col(f"t{i}")) for i in range(len(names))]).first()
    names = [n for i, n in enumerate(names) if proven[i] <= limit]
    if not names:
        return {}
    about = df.agg(*[F.approx_count_distinct(texts[n], 0.02) for n in names]).first()
    # Columns of clearly more texts are not exchanged here; the others' texts are few enough to be counted on the driver.
    few = [n for i, n in enumerate(names) if about[i] <= limit * FEW_MARGIN + 10]
    if not few:
        return {}
    text = [F.struct(F.lit(n).alias("name"), F.coalesce(col(n), F.lit(MISSING)).alias("text")) for n in few]
    found: dict[str, list[str]] = {n: [] for n in few}
    for r in df.select(F.inline(F.array(*text))).distinct().collect():
        found[r.name].append(r.text)
    return {n: sorted(v) for n, v in found.items() if len(v) <= limit}


def _fold_categories(df: DataFrame, names: Sequence[str], fold: str, folds: int, limit: int) -> list[dict[str, list[str]]] | None:
    """Per fold the sorted distinct texts of each column in all other folds; None where a column has more than ``limit`` in all."""
    if not names:
        return [{} for _ in range(folds)]
    text = [F.struct(F.lit(n).alias("name"), F.coalesce(col(n), F.lit(MISSING)).alias("text")) for n in names]
    found = df.select(col(fold).alias("fold"), F.inline(F.array(*text))).distinct()
    if not found.groupBy("name").agg(F.count_distinct("text").alias("n")).where(F.col("n") > limit).isEmpty():
        return None
    inside: dict[tuple[str, str], set[int]] = {}
    for r in found.groupBy("name", "text").agg(F.collect_set("fold").alias("folds")).collect():
        inside[r.name, r.text] = set(r.folds)
    return [{n: sorted(t for (m, t), where in inside.items() if m == n and where - {k}) for n in names} for k in range(folds)]


def learn_classes(df: DataFrame, target: str, limit: int = MAX_CLASSES) -> list[tuple[str, int]]:
    """The classes as text with their rows, in sorted order (by number for numbers)."""
    counts = df.groupBy(col(target).alias("v")).agg(F.count("*").alias("n"), F.first(col(target).cast("string")).alias("t"))
    found = [r for r in counts.where("v IS NOT NULL").limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"column {target} has more than {limit} classes")
    return [(r.t, r.n) for r in sorted(found, key=lambda r: r.v)]
