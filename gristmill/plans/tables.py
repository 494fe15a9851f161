"""Views of the given tables used by the registered queries.

The tables hold no missing values, so some are planted by fixed rules on the keys. The same
text is the projection in Spark and the subquery in the check SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_RULES = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "value",
    "value_n": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END",
    "value_half": "CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END",
    "value_rare": "CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END",
    "type_n": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END",
    "num_text": "CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END",
    "num_text_low": "CASE WHEN event_id % 4 = 0 THEN 'n/a' ELSE CAST(user_id AS STRING) END",
    "flag01": "CAST(event_id % 2 AS INT)",
    "flag01_n": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 2 AS INT) END",
    "const": "1e0",
    "zero_div": "CASE WHEN event_id % 9 = 0 THEN 0e0 ELSE value END",
    "signed": "value - 35e0",
    "leaky": "2e0 * value + 1e-3 * (event_id % 3)",
    "score": "value / 500e0",
    "inf_v": "CASE WHEN event_id % 50 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The events table with planted columns; only the ones asked for."""
    wanted = columns or EVENT_RULES
    return table(spark, folder, "events").selectExpr(*[f"{EVENT_RULES[c]} AS {c}" for c in wanted])


def events_sql(*columns: str) -> str:
    wanted = columns or EVENT_RULES
    return "(SELECT " + ", ".join(f"{EVENT_RULES[c]} AS {c}" for c in wanted) + " FROM events)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All double columns rounded, for comparison with another engine."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in doubles})
