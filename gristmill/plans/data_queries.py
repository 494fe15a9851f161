"""Registered queries for shaping, cleaning, features, profiles, charts and recipes.

Each entry is ``name: (query, check)``: a function of session and table folder, and the SQL
that gives the same rows in DuckDB, or None where SQL cannot say it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import NUMBER_PATTERN
from ..operators import charts, cleaning, features, frequent, profile_state, profiling, shape
from ..operators.ordering import group_quantiles
from ..operators.recipe import Recipe, steps_from_json, replay
from ..session import ensure_checkpoint_dir
from ..sources import tables as sources
from .tables import events, events_sql, rounded, table

NUMBER_SQL = f"regexp_matches({{}}, '{NUMBER_PATTERN}')"


# Shaping ---------------------------------------------------------------------------------


def drop_column(spark: SparkSession, folder: str) -> DataFrame:
    return shape.drop_column(table(spark, folder, "orders"), "o_orderpriority").drop("o_orderdate")


def rename_column(spark, folder):
    return shape.rename_column(table(spark, folder, "customer"), "c_acctbal", "balance")


def cast_column(spark, folder):
    return shape.cast_column(events(spark, folder, "event_id", "num_text"), "num_text", "f64")


def cast_batch(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "num_text", "flag01", "value")
    return shape.cast_columns(df, {"num_text": "i64", "flag01": "bool", "value": "i64", "user_id": "str"})


def filter_equals(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return shape.filter_rows(df, "l_quantity", " 23 ")


def filter_contains(spark, folder):
    return shape.filter_rows(table(spark, folder, "part"), "p_name", "ring")


def drop_null_rows(spark, folder):
    return shape.drop_null_rows(events(spark, folder, "event_id", "value_n"), "value_n")


def sort_topn(spark, folder):
    df = events(spark, folder, "event_id", "value_n")
    return shape.sort_rows(df, "value_n", True, ["event_id"]).limit(1500)


def table_page(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return shape.table_page(df, ["o_orderkey"], 700, 100)


def table_page_deep(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return shape.table_page(df, ["o_totalprice", "o_orderkey"], 12_000, 100)


def dataset_summary(spark, folder):
    return shape.dataset_summary(table(spark, folder, "customer"))


def load_csv_orders(spark, folder):
    path = _scratch(spark) + "/orders_csv"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.option("header", True).option("sep", "|").csv(path)
    df = sources.load_csv(spark, path)
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# Whole numbers first; fractions, large numbers and words only in the last rows of the file.
LATE_RULES = {
    "o_orderkey": "o_orderkey",
    "fraction": "CASE WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 20 THEN o_orderkey + 5e-1 ELSE o_orderkey END",
    "large": "CASE WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 20 THEN 9999999999 + o_orderkey ELSE o_orderkey END",
    "word": "CASE WHEN o_orderkey > (SELECT max(o_orderkey) FROM orders) - 20 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END",
}


def load_csv_late_types(spark, folder):
    path, orders = _scratch(spark) + "/late_csv", table(spark, folder, "orders")
    latest = orders.agg(F.max("o_orderkey")).first()[0]
    late = orders.selectExpr(*[f"{r.replace('(SELECT max(o_orderkey) FROM orders)', str(latest))} AS {n}" for n, r in LATE_RULES.items()])
    late.orderBy("o_orderkey").write.option("header", True).csv(path)
    return sources.load_csv(spark, path).select("o_orderkey", "fraction", F.col("large").cast("bigint").alias("large"), "word")


def cast_timestamp(spark, folder):
    df = events(spark, folder, "event_id", "ts").withColumn("whole", F.col("ts"))
    cast = shape.cast_columns(df, {"ts": "f64", "whole": "i64"})
    return cast.select("event_id", F.round("ts", 3).alias("ts"), "whole")


def quantiles_by_nullable_group(spark, folder):
    """Exact quartiles per event type, one of them missing, by the way of large groups."""
    df = events(spark, folder, "type_n", "value")
    found = group_quantiles(df, F.col("value"), [0.25, 0.5, 0.75], ["type_n"], in_memory_rows=0)
    return found.select("type_n", "n", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


def _scratch(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def _written(format: str):
    def query(spark, folder):
        """The whole table, written by the export and loaded again."""
        path = f"{_scratch(spark)}/customers.{format}"
        sources.write_table(table(spark, folder, "customer"), path, format)
        back = sources.load(spark, path)
        return rounded(back.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal")))

    return query


# Cleaning --------------------------------------------------------------------------------


def coerce_numeric(spark, folder):
    df = events(spark, folder, "event_id", "num_text", "num_text_low", "event_type")
    return cleaning.coerce_mostly_numeric(df)


def fill_mean(spark, folder):
    return rounded(cleaning.fill_mean(events(spark, folder, "event_id", "value_n"), "value_n"))


def fill_median(spark, folder):
    return rounded(cleaning.fill_median(events(spark, folder, "event_id", "value_n"), "value_n"))


def fill_zero(spark, folder):
    return cleaning.fill_zero(events(spark, folder, "event_id", "value_n"), "value_n")


def fill_forward(spark, folder):
    return cleaning.fill_forward(events(spark, folder, "event_id", "value_half"), "value_half", ["event_id"])


def fill_forward_by_user(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "ts", "value_half")
    return cleaning.fill_forward(df, "value_half", ["ts", "event_id"], ["user_id"]).drop("ts")


def fill_mode(spark, folder):
    return cleaning.fill_mode(events(spark, folder, "event_id", "type_n"), "type_n")


def one_hot(spark, folder):
    return cleaning.one_hot(events(spark, folder, "event_id", "type_n"), "type_n")


def type_recommendations(spark, folder):
    df = events(spark, folder, "event_id", "event_type", "num_text", "num_text_low", "flag01", "flag01_n", "value")
    return cleaning.type_recommendations(df)


def preview_fill_mean(spark, folder):
    df = events(spark, folder, "event_id", "value_n")
    out = profiling.preview(df, lambda d: cleaning.fill_mean(d, "value_n"), "value_n", ["event_id"])
    return rounded(out.withColumn("samples", F.size("samples")))


HINT_COLUMNS = (
    "event_id",
    "event_type",
    "value_n",
    "value_half",
    "type_n",
    "num_text",
    "flag01",
    "const",
)


def column_hints(spark, folder):
    return profiling.column_hints(profiling.profile_columns(events(spark, folder, *HINT_COLUMNS)))


# Features --------------------------------------------------------------------------------


def _combine(op: str):
    def query(spark, folder):
        return rounded(features.combine_columns(events(spark, folder, "event_id", "value_n", "zero_div"), "value_n", "zero_div", op, "result"))

    return query


def _transform(kind: str, column: str):
    def query(spark, folder):
        df = events(spark, folder, "event_id", column)
        return rounded(features.transform_column(df, column, kind, "result"))

    return query


def bin_column(spark, folder):
    df = features.bin_column(events(spark, folder, "event_id", "value_n"), "value_n", 8, "bin")
    return rounded(df.drop("bin"))


# Profiles and charts ---------------------------------------------------------------------


def profile_column(spark, folder):
    return _profile(events(spark, folder, "value_n"))


PROFILE_INPUT = ("event_id", "user_id", "event_type", "value_n", "type_n", "num_text", "flag01_n", "const")


def profile_all(spark, folder):
    return _profile(events(spark, folder, *PROFILE_INPUT))


def profile_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    return rounded(profiling.profile_columns(df).drop("ord"), 7)


def profile_approx(spark, folder):
    df = events(spark, folder, "event_type", "flag01", "const", "value")
    return rounded(profiling.profile_columns(df, approx=True).drop("unique_count", "ord"))


def _profile(df: DataFrame) -> DataFrame:
    return rounded(profiling.profile_columns(df).drop("ord"))


def filled_profile(spark: SparkSession, folder: str) -> DataFrame:
    df = events(spark, folder, "event_id", "event_type", "value_n", "type_n")
    return _profile(cleaning.fill_mean(df, "value_n"))


def histogram(spark, folder):
    return rounded(charts.histogram(events(spark, folder, "value_n"), "value_n").drop("label"))


def histogram_lineitem(spark, folder):
    return rounded(charts.histogram(table(spark, folder, "lineitem").select("l_extendedprice"), "l_extendedprice", 35).drop("label"), 4)


def value_counts_top15(spark, folder):
    return rounded(charts.top_values(table(spark, folder, "lineitem").select("l_suppkey"), "l_suppkey"))


def profile_of_days(spark, folder):
    """States of three batches of days, the last of them with a day that came before in part, merged and rated
    against the exact numbers of distinct values and the ranks of the estimated medians."""
    df = events(spark, folder, "ts", *STATE_COLUMNS)
    day, path = F.to_date("ts"), _scratch(spark) + "/states"
    for batch in (F.dayofmonth("ts") <= 10, F.dayofmonth("ts").between(11, 20) & (F.hour("ts") < 12), F.dayofmonth("ts") > 10):
        profile_state.write_states(profile_state.slice_states(df.where(batch), day, STATE_COLUMNS), path)
    merged = profile_state.profile_of_states(profile_state.read_states(spark, path))
    medians = {r["name"]: r["quantiles"][1] for r in merged.select("name", "quantiles").collect() if r["quantiles"]}
    below = F.array(*[
        F.struct(
            F.lit(c).alias("name"),
            *[(F.count_if(test) / F.count(F.col(c))).alias(side) for side, test in (("under", F.col(c) < m), ("up_to", F.col(c) <= m))],
        )
        for c, m in medians.items()
    ])
    ranks = df.agg(below.alias("r")).select(F.inline("r"))
    exact = profiling.profile_columns(df, STATE_COLUMNS).select("name", F.col("unique_count").alias("exact"))
    rated = merged.drop("ord").join(exact, "name").join(ranks, "name", "left")
    return rounded(
        rated.select(
            *[c for c in profiling.PROFILE_COLUMNS if c not in ("ord", "unique_count")],
            (F.abs(F.col("unique_count") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("distinct_fits"),
            ((F.col("under") <= 0.53) & (F.col("up_to") >= 0.47)).alias("median_fits"),
        )
    )


def most_frequent_parts(spark, folder):
    return frequent.most_frequent(table(spark, folder, "lineitem"), "l_partkey", 15, 256)


def most_frequent_words(spark, folder):
    """Words of all texts: a few are in every line, most are rare."""
    words = table(spark, folder, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("word"))
    return frequent.most_frequent(words.where("word <> ''"), "word", 40, 1024)


def distribution_text(spark, folder):
    return charts.distribution(events(spark, folder, "type_n"), "type_n")


STATE_COLUMNS = ("event_id", "user_id", "event_type", "value", "value_n", "type_n", "num_text", "flag01_n", "const")
CORRELATED = ("value", "value_n", "zero_div", "signed", "leaky", "const", "user_id")


def correlation_matrix(spark, folder):
    return rounded(charts.correlation_matrix(events(spark, folder, *CORRELATED)))


def correlation_embeddings(spark, folder):
    """All pairs of the 64 components."""
    parts = [F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(64)]
    return rounded(charts.correlation_matrix(table(spark, folder, "embeddings").select(*parts)))


def correlation_lineitem(spark, folder):
    df = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(charts.correlation_matrix(df))


def scatter_sample(spark, folder):
    return charts.scatter_sample(events(spark, folder, "event_id", "value_n", "user_id"), "value_n", "user_id", ["event_id"])


def box_plot(spark, folder):
    df = table(spark, folder, "lineitem").select("l_extendedprice", "l_suppkey")
    return rounded(charts.box_plot(df, "l_extendedprice", "l_suppkey"))


def box_outliers(spark, folder):
    return charts.box_outliers(events(spark, folder, "value_n", "event_type"), "value_n", "event_type")


# Recipes ---------------------------------------------------------------------------------


def _recipe(spark, folder) -> Recipe:
    return (
        Recipe(events(spark, folder, "event_id", "value_n", "type_n"))
        .apply("fill_mean", "value_n")
        .apply("fill_mode", "type_n")
        .apply("transform", "value_n", transform="log", name="value_log")
    )


def recipe_undo(spark, folder):
    return rounded(_recipe(spark, folder).undo().df)


def recipe_restore(spark, folder):
    return rounded(_recipe(spark, folder).restore(1).df)


def recipe_apply(spark, folder):
    """Learned on all events, stored as text, replayed on the purchases."""
    steps = steps_from_json(_recipe(spark, folder).to_json())
    other = events(spark, folder, "event_id", "value_n", "type_n", "event_type").where("event_type = 'purchase'")
    return rounded(replay(steps, other.drop("event_type")))


def recipe_log(spark, folder):
    """The log of a recipe, with what each step learned from the table and the rows it left."""
    recipe = Recipe(events(spark, folder, "event_id", "value_n", "type_n"))
    recipe = recipe.apply("fill_mode", "type_n").apply("filter_rows", "type_n", query="purchase").apply("fill_mean", "value_n")
    learned = [(i + 1, str(s.learned.get("value", "")) if s.action == "fill_mode" else None, float(s.learned["value"]) if s.action == "fill_mean" else None) for i, s in enumerate(recipe.steps)]
    left = [(i + 1, recipe.restore(i + 1).df.count()) for i in range(len(recipe.steps))]
    known = spark.createDataFrame(learned, "step int, text string, number double")
    rows = spark.createDataFrame(left, "step int, rows_left long")
    return rounded(recipe.log().drop("detail").join(known, "step").join(rows, "step"))


# Checks ----------------------------------------------------------------------------------

NULL_TEXT = "CAST(NULL AS VARCHAR)"
NULL_DOUBLE = "CAST(NULL AS DOUBLE)"


def _profile_sql(source: str, columns: dict[str, str], places: int = 6) -> str:
    parts = []
    for name, dtype in columns.items():
        numeric = dtype in ("i64", "i32", "f64")
        moments = (
            f"round(avg({name}), {places}) AS mean, round(stddev_samp({name}), {places}) AS std, "
            f"printf('%.4f', CAST(min({name}) AS DOUBLE)) AS min, printf('%.4f', CAST(max({name}) AS DOUBLE)) AS max"
            if numeric
            else f"{NULL_DOUBLE} AS mean, {NULL_DOUBLE} AS std, {NULL_TEXT} AS min, {NULL_TEXT} AS max"
        )
        parts.append(
            f"SELECT '{name}' AS name, '{dtype}' AS dtype, count(*) AS count, count(*) - count({name}) AS null_count, "
            f"round((count(*) - count({name})) * 100.0 / count(*), {places}) AS null_percent, "
            f"count(DISTINCT {name}) + CAST(count(*) > count({name}) AS BIGINT) AS unique_count, {moments} FROM {source}"
        )
    return " UNION ALL ".join(parts)


EVENT_TYPES = {
    "event_id": "i64",
    "user_id": "i64",
    "event_type": "str",
    "value": "f64",
    "value_n": "f64",
    "value_half": "f64",
    "value_rare": "f64",
    "type_n": "str",
    "num_text": "str",
    "flag01": "i32",
    "flag01_n": "i32",
    "const": "f64",
}


def events_profile_sql(*columns: str) -> str:
    return _profile_sql(events_sql(*columns), {c: EVENT_TYPES[c] for c in columns})


def _stats_sql(column: str, aggregate: str) -> str:
    return f"(SELECT {aggregate} FROM {events_sql(column)})"


def _combine_sql(expression: str) -> str:
    return f"SELECT event_id, round(value_n, 6) AS value_n, round(zero_div, 6) AS zero_div, round({expression}, 6) AS result FROM {events_sql('event_id', 'value_n', 'zero_div')}"


def _transform_sql(column: str, expression: str) -> str:
    source = events_sql("event_id", column)
    return f"WITH e AS {source}, s AS (SELECT avg({column}) AS m, stddev_samp({column}) AS d, min({column}) AS lo, max({column}) AS hi FROM e) SELECT event_id, round({column}, 6) AS {column}, round({expression}, 6) AS result FROM e, s"


MODE_SQL = f"(SELECT type_n FROM {events_sql('type_n')} WHERE type_n IS NOT NULL GROUP BY type_n ORDER BY count(*) DESC, type_n LIMIT 1)"
MEAN_SQL = _stats_sql("value_n", "avg(value_n)")

_CUSTOMERS_SQL = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer"

_LOGGED_SQL = f"(SELECT value_n, coalesce(type_n, {MODE_SQL}) AS type_n FROM {events_sql('value_n', 'type_n')})"
RECIPE_LOG_SQL = f"""
WITH e AS {_LOGGED_SQL}, p AS (SELECT * FROM e WHERE type_n = 'purchase')
SELECT 1 AS step, 'fill_mode' AS action, 'type_n' AS column, {MODE_SQL} AS text, {NULL_DOUBLE} AS number, (SELECT count(*) FROM e) AS rows_left
UNION ALL SELECT 2, 'filter_rows', 'type_n', NULL, NULL, (SELECT count(*) FROM p)
UNION ALL SELECT 3, 'fill_mean', 'value_n', NULL, (SELECT round(avg(value_n), 6) FROM p), (SELECT count(*) FROM p)
"""

HINTS_SQL = f"""
WITH p AS ({events_profile_sql(*HINT_COLUMNS)}),
h AS (
  SELECT name, 'high_missing' AS hint, CASE WHEN mean IS NOT NULL THEN 'fill_mean' ELSE 'fill_mode' END AS suggested_action FROM p WHERE null_percent >= 40
  UNION ALL SELECT name, 'moderate_missing', NULL FROM p WHERE null_percent >= 10 AND null_percent < 40
  UNION ALL SELECT name, 'binary', 'cast_bool' FROM p WHERE unique_count = 2 AND dtype <> 'bool'
  UNION ALL SELECT name, 'one_hot', 'one_hot' FROM p WHERE dtype = 'str' AND unique_count BETWEEN 3 AND 10
  UNION ALL SELECT name, 'high_cardinality', NULL FROM p WHERE dtype = 'str' AND unique_count > 50 AND unique_count > count * 0.5
  UNION ALL SELECT name, 'constant', 'drop_column' FROM p WHERE unique_count <= 1
)
SELECT * FROM h
"""

RECOMMEND_SQL = f"""
WITH e AS {events_sql('event_id', 'event_type', 'num_text', 'num_text_low', 'flag01', 'flag01_n', 'value')},
t AS (
  {" UNION ALL ".join(
      f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE {NUMBER_SQL.format(f'trim({c})')}) AS k FROM e"
      for c in ('event_type', 'num_text', 'num_text_low'))}
),
b AS (
  {" UNION ALL ".join(
      f"SELECT '{c}' AS \"column\", '{d}' AS current_type, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS u, min({c}) AS lo, max({c}) AS hi FROM e"
      for c, d in (('event_id', 'i64'), ('flag01', 'i32'), ('flag01_n', 'i32'), ('value', 'f64')))}
)
SELECT "column", 'str' AS current_type, 'f64' AS recommended_type,
       'numeric_text' AS reason, round(CAST(k AS DOUBLE) / n, 4) AS share
FROM t WHERE k * 1.0 / n > 0.8
UNION ALL
SELECT "column", current_type, 'bool', 'only_0_and_1', CAST(1 AS DOUBLE) FROM b WHERE u = 2 AND lo = 0 AND hi = 1
"""

CORRELATION_SQL = "WITH e AS {source} " + "SELECT col_a, col_b, round(r, 6) AS r FROM ({pairs})"


def _correlation_sql(source: str, columns: tuple[str, ...]) -> str:
    parts = [f"SELECT '{c}' AS col_a, '{c}' AS col_b, CAST(1 AS DOUBLE) AS r" for c in columns]
    for a in columns:
        for b in columns:
            if a != b:
                both = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
                scale = f"(stddev_pop({a}) {both} * stddev_pop({b}) {both})"
                parts.append(
                    f"SELECT '{a}', '{b}', coalesce(CASE WHEN {scale} = 0 THEN 0 ELSE greatest(-1, least(1, covar_pop({a}, {b}) {both} / {scale})) END, 0) FROM e"
                )
    return CORRELATION_SQL.format(source=source, pairs=" UNION ALL ".join(parts))


def _histogram_sql(source: str, column: str, bins: int, places: int = 6) -> str:
    return f"""
WITH e AS (SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL),
s AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM e),
c AS (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS ord, count(*) AS n FROM e, s GROUP BY 1)
SELECT CAST(b.ord AS INTEGER) AS ord, round(lo + b.ord * w, {places}) AS low, round(lo + b.ord * w + w, {places}) AS high, coalesce(n, 0) AS count
FROM (SELECT unnest(range({bins})) AS ord) b CROSS JOIN s LEFT JOIN c ON c.ord = b.ord
"""


BOX_SQL = """
WITH v AS (SELECT CAST({group} AS VARCHAR) AS g, {number} AS x FROM {source} WHERE {group} IS NOT NULL AND {number} IS NOT NULL),
top AS (SELECT g FROM v GROUP BY g ORDER BY count(*) DESC, g LIMIT 20),
box AS (SELECT g, count(*) AS n, min(x) AS lo, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS hi
        FROM v WHERE g IN (SELECT g FROM top) GROUP BY g)
"""

BOX_PLOT_SQL = BOX_SQL.format(source="lineitem", group="l_suppkey", number="l_extendedprice") + (
    'SELECT g AS "group", n AS count, round(lo, 6) AS min, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(hi, 6) AS max FROM box'
)
BOX_OUTLIERS_SQL = BOX_SQL.format(source=events_sql("value_n", "event_type"), group="event_type", number="value_n") + (
    'SELECT "group", value, CAST(ord AS INTEGER) AS ord FROM (SELECT v.g AS "group", x AS value, row_number() OVER (PARTITION BY v.g ORDER BY x) AS ord '
    "FROM v JOIN box ON box.g = v.g WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) WHERE ord <= 50"
)

SCATTER_SQL = f"""
WITH p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, value_n AS x, CAST(user_id AS DOUBLE) AS y
           FROM {events_sql('event_id', 'value_n', 'user_id')} WHERE value_n IS NOT NULL),
n AS (SELECT count(*) AS n FROM p),
w AS (SELECT CASE WHEN n <= 2000 THEN i ELSE CAST(floor(i * (n / 2000.0::DOUBLE)) AS BIGINT) END AS position
      FROM n, (SELECT unnest(range(2000)) AS i))
SELECT p.position, x, y FROM p JOIN w USING (position)
"""

PREVIEW_SQL = f"""
WITH a AS ({_profile_sql(events_sql('value_n'), {'value_n': 'f64'})}),
e AS (SELECT coalesce(value_n, {MEAN_SQL}) AS value_n FROM {events_sql('value_n')}),
b AS ({_profile_sql('e', {'value_n': 'f64'})})
SELECT 'before' AS phase, CAST(10 AS INTEGER) AS samples, * FROM a UNION ALL SELECT 'after', 10, * FROM b
"""

_DATASET_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT count(*) AS rows, CAST({i} AS INTEGER) AS ord, '{c}' AS column, '{d}' AS dtype, CAST(5 AS INTEGER) AS columns FROM customer"
    for i, (c, d) in enumerate(
        [("c_custkey", "i64"), ("c_name", "str"), ("c_nationkey", "i32"), ("c_acctbal", "f64"), ("c_mktsegment", "str")]
    )
)

_RECIPE_SQL = f"""
WITH e AS {events_sql('event_id', 'value_n', 'type_n', 'event_type')},
f AS (SELECT event_id, event_type, coalesce(value_n, {MEAN_SQL}) AS value_n, coalesce(type_n, {MODE_SQL}) AS type_n FROM e)
"""

_EVENT_VALUES = ("click", "error", "purchase", "signup", "view")

DATA_QUERIES = {
    "drop_column": (drop_column, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "rename_column": (rename_column, "SELECT c_custkey, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer"),
    "cast_column": (
        cast_column,
        f"SELECT event_id, CASE WHEN {NUMBER_SQL.format('num_text')} THEN TRY_CAST(num_text AS DOUBLE) END AS num_text FROM {events_sql('event_id', 'num_text')}",
    ),
    "cast_batch": (
        cast_batch,
        f"SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, TRY_CAST(num_text AS BIGINT) AS num_text, flag01 <> 0 AS flag01, CAST(trunc(value) AS BIGINT) AS value FROM {events_sql('event_id', 'user_id', 'num_text', 'flag01', 'value')}",
    ),
    "filter_equals": (filter_equals, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity = 23"),
    "filter_contains": (filter_contains, "SELECT * FROM part WHERE contains(p_name, 'ring')"),
    "drop_null_rows": (drop_null_rows, f"SELECT * FROM {events_sql('event_id', 'value_n')} WHERE value_n IS NOT NULL"),
    "sort_topn": (
        sort_topn,
        f"SELECT event_id, value_n FROM {events_sql('event_id', 'value_n')} ORDER BY value_n DESC NULLS FIRST, event_id LIMIT 1500",
    ),
    "table_page": (table_page, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 700"),
    "table_page_deep": (
        table_page_deep,
        "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 12000",
    ),
    "dataset_summary": (dataset_summary, _DATASET_SUMMARY_SQL),
    "load_csv_orders": (
        load_csv_orders,
        "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    ),
    "load_csv_late_types": (
        load_csv_late_types,
        "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(fraction AS DOUBLE) AS fraction, CAST(large AS BIGINT) AS large, word FROM (SELECT "
        + ", ".join(f"{rule} AS {name}" for name, rule in LATE_RULES.items())
        + " FROM orders)",
    ),
    "cast_timestamp": (
        cast_timestamp,
        "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS ts, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS whole FROM events",
    ),
    "quantiles_by_nullable_group": (
        quantiles_by_nullable_group,
        "SELECT type_n, count(value) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, "
        f"round(quantile_cont(value, 0.75), 6) AS q3 FROM {events_sql('type_n', 'value')} GROUP BY type_n",
    ),
    "coerce_numeric": (
        coerce_numeric,
        f"SELECT event_id, TRY_CAST(num_text AS DOUBLE) AS num_text, num_text_low, event_type FROM {events_sql('event_id', 'num_text', 'num_text_low', 'event_type')}",
    ),
    "fill_mean": (fill_mean, f"SELECT event_id, round(coalesce(value_n, {MEAN_SQL}), 6) AS value_n FROM {events_sql('event_id', 'value_n')}"),
    "fill_median": (
        fill_median,
        f"SELECT event_id, round(coalesce(value_n, {_stats_sql('value_n', 'quantile_cont(value_n, 0.5)')}), 6) AS value_n FROM {events_sql('event_id', 'value_n')}",
    ),
    "fill_zero": (fill_zero, f"SELECT event_id, coalesce(value_n, 0) AS value_n FROM {events_sql('event_id', 'value_n')}"),
    "fill_forward": (
        fill_forward,
        f"SELECT event_id, last_value(value_half IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS value_half FROM {events_sql('event_id', 'value_half')}",
    ),
    "fill_forward_by_user": (
        fill_forward_by_user,
        f"SELECT event_id, user_id, last_value(value_half IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_half FROM {events_sql('event_id', 'user_id', 'ts', 'value_half')}",
    ),
    "fill_mode": (fill_mode, f"SELECT event_id, coalesce(type_n, {MODE_SQL}) AS type_n FROM {events_sql('event_id', 'type_n')}"),
    "one_hot": (
        one_hot,
        "SELECT event_id, "
        + ", ".join(f"CAST(type_n = '{v}' AS TINYINT) AS type_n_{v}" for v in _EVENT_VALUES)
        + f" FROM {events_sql('event_id', 'type_n')}",
    ),
    "type_recommendations": (type_recommendations, RECOMMEND_SQL),
    "preview_fill_mean": (preview_fill_mean, PREVIEW_SQL),
    "column_hints": (column_hints, HINTS_SQL),
    "combine_add": (_combine("add"), _combine_sql("value_n + zero_div")),
    "combine_subtract": (_combine("subtract"), _combine_sql("value_n - zero_div")),
    "combine_multiply": (_combine("multiply"), _combine_sql("value_n * zero_div")),
    "combine_divide": (_combine("divide"), _combine_sql("CASE WHEN zero_div <> 0 THEN value_n / zero_div END")),
    "transform_log": (_transform("log", "signed"), _transform_sql("signed", "CASE WHEN signed > 0 THEN ln(signed) END")),
    "transform_log10": (_transform("log10", "signed"), _transform_sql("signed", "CASE WHEN signed > 0 THEN log10(signed) END")),
    "transform_sqrt": (_transform("sqrt", "signed"), _transform_sql("signed", "CASE WHEN signed >= 0 THEN sqrt(signed) END")),
    "transform_square": (_transform("square", "signed"), _transform_sql("signed", "signed * signed")),
    "transform_abs": (_transform("abs", "signed"), _transform_sql("signed", "abs(signed)")),
    "transform_standardize": (_transform("standardize", "value_n"), _transform_sql("value_n", "(value_n - m) / d")),
    "transform_normalize": (_transform("normalize", "value_n"), _transform_sql("value_n", "(value_n - lo) / (hi - lo)")),
    "bin_column": (
        bin_column,
        f"WITH e AS {events_sql('event_id', 'value_n')}, s AS (SELECT min(value_n) AS lo, (max(value_n) - min(value_n)) / 8 AS w FROM e), "
        "b AS (SELECT event_id, value_n, lo, w, CASE WHEN value_n IS NOT NULL THEN CAST(least(floor((value_n - lo) / w), 7) AS INTEGER) END AS i FROM e, s) "
        "SELECT event_id, value_n, i AS bin_index, round(lo + i * w, 6) AS bin_low, round(lo + i * w + w, 6) AS bin_high FROM b",
    ),
    "profile_column": (profile_column, events_profile_sql("value_n")),
    "profile_all": (profile_all, events_profile_sql(*PROFILE_INPUT)),
    "profile_lineitem": (
        profile_lineitem,
        _profile_sql(
            "lineitem",
            {"l_partkey": "i64", "l_quantity": "f64", "l_discount": "f64", "l_returnflag": "str", "l_linestatus": "str"},
            7,
        ),
    ),
    "profile_approx": (
        profile_approx,
        f"SELECT * EXCLUDE (unique_count) FROM ({events_profile_sql('event_type', 'flag01', 'const', 'value')})",
    ),
    "filled_profile": (
        filled_profile,
        f"WITH e AS (SELECT event_id, event_type, coalesce(value_n, {MEAN_SQL}) AS value_n, type_n FROM {events_sql('event_id', 'event_type', 'value_n', 'type_n')}) "
        + _profile_sql("e", {"event_id": "i64", "event_type": "str", "value_n": "f64", "type_n": "str"}),
    ),
    "histogram": (histogram, _histogram_sql(events_sql("value_n"), "value_n", 20)),
    "histogram_lineitem": (histogram_lineitem, _histogram_sql("lineitem", "l_extendedprice", 35, 4)),
    "value_counts_top15": (
        value_counts_top15,
        "WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 15) "
        "SELECT CAST(l_suppkey AS VARCHAR) AS label, n AS count, round(n * 100.0 / (SELECT sum(n) FROM t), 6) AS percent FROM t",
    ),
    "distribution_text": (
        distribution_text,
        f"SELECT 'type_n' AS column, 'frequency' AS kind, CAST(row_number() OVER (ORDER BY count(*) DESC, type_n) - 1 AS INTEGER) AS ord, type_n AS label, count(*) AS count FROM {events_sql('type_n')} WHERE type_n IS NOT NULL GROUP BY type_n",
    ),
    "correlation_matrix": (correlation_matrix, _correlation_sql(events_sql(*CORRELATED), CORRELATED)),
    "correlation_embeddings": (
        correlation_embeddings,
        "WITH f AS (SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
        "SELECT 'e' || a.j AS col_a, 'e' || b.j AS col_b, CASE WHEN a.j = b.j THEN 1e0 ELSE round(corr(a.x, b.x), 6) END AS r "
        "FROM f a JOIN f b USING (vec_id) GROUP BY a.j, b.j",
    ),
    "correlation_lineitem": (
        correlation_lineitem,
        _correlation_sql("(SELECT * FROM lineitem)", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    ),
    "scatter_sample": (scatter_sample, SCATTER_SQL),
    "box_plot": (box_plot, BOX_PLOT_SQL),
    "box_outliers": (box_outliers, BOX_OUTLIERS_SQL),
    "recipe_undo": (recipe_undo, _RECIPE_SQL + "SELECT event_id, round(value_n, 6) AS value_n, type_n FROM f"),
    "recipe_restore": (
        recipe_restore,
        f"SELECT event_id, round(coalesce(value_n, {MEAN_SQL}), 6) AS value_n, type_n FROM {events_sql('event_id', 'value_n', 'type_n')}",
    ),
    "recipe_apply": (
        recipe_apply,
        _RECIPE_SQL
        + "SELECT event_id, round(value_n, 6) AS value_n, type_n, round(CASE WHEN value_n > 0 THEN ln(value_n) END, 6) AS value_log FROM f WHERE event_type = 'purchase'",
    ),
    "export_parquet": (_written("parquet"), _CUSTOMERS_SQL),
    "export_csv": (_written("csv"), _CUSTOMERS_SQL),
    "recipe_log": (recipe_log, RECIPE_LOG_SQL),
    "profile_of_days": (
        profile_of_days,
        "SELECT * EXCLUDE (unique_count), unique_count > 0 AS distinct_fits, "
        f"CASE WHEN mean IS NOT NULL THEN TRUE END AS median_fits FROM ({events_profile_sql(*STATE_COLUMNS)})",
    ),
    "most_frequent_parts": (
        most_frequent_parts,
        "SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, value LIMIT 15",
    ),
    "most_frequent_words": (
        most_frequent_words,
        "WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS value FROM documents) "
        "SELECT value, count(*) AS count FROM w WHERE value <> '' GROUP BY value ORDER BY count DESC, value LIMIT 40",
    ),
}
