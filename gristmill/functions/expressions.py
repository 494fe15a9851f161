"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text that counts as a number (no words such as inf or nan, no type suffixes).
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Short type names shown in profiles.
TYPE_NAMES = {
    "string": "str",
    "double": "f64",
    "float": "f32",
    "bigint": "i64",
    "int": "i32",
    "smallint": "i16",
    "tinyint": "i8",
    "boolean": "bool",
    "date": "date",
    "timestamp": "datetime",
    "timestamp_ntz": "datetime",
}


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """The text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column not found: {', '.join(missing)}")


def data_type(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, name)
    return df.schema[name].dataType


def type_name(dtype: T.DataType) -> str:
    text = dtype.simpleString()
    return TYPE_NAMES.get(text, text)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.StringType)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_scalar(df: DataFrame, name: str) -> bool:
    kinds = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(data_type(df, name), kinds)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_numeric(df: DataFrame, name: str) -> None:
    if not is_numeric(df, name):
        raise ValueError(f"column {name} is not numeric")


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = col(name)
    if isinstance(data_type(df, name), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def text_to_double(text: Column) -> Column:
    """Number text as double; anything else as NULL."""
    return F.when(looks_numeric(text), text.try_cast("double"))


def as_double(df: DataFrame, name: str) -> Column:
    """Any scalar column as double: numbers as they are, number text parsed, times as epoch
    seconds, booleans as 0 and 1; NaN and unreadable values as NULL."""
    dtype = data_type(df, name)
    if isinstance(dtype, T.StringType):
        return text_to_double(col(name))
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return epoch_seconds(df, name)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return without_nan(df, name).cast("double")
    raise ValueError(f"column {name} of type {dtype.simpleString()} has no numeric form")


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Seconds since 1970 as double, free of time-zone rules for zone-less timestamps."""
    c = col(name)
    dtype = data_type(df, name)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c) / F.lit(1e6)
    days = F.unix_date(c.cast("date")).cast("double") * 86400.0
    if isinstance(dtype, T.DateType):
        return days
    second = F.date_part(F.lit("SECOND"), c).cast("double")
    return days + F.hour(c) * 3600.0 + F.minute(c) * 60.0 + second


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and NULL where bottom is zero or missing."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def hash_number(key: Column, seed: int | str = 42, digits: int = 8) -> Column:
    """A whole number read from the leading hex digits of md5(seed|key).

    It depends on the key alone, so every assignment made from it is the same for any
    partitioning, retry or cluster size.
    """
    text = F.concat(F.lit(f"{seed}|"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def long_array(values: Iterable[int]) -> Column:
    """An array literal of whole numbers."""
    return F.expr("array(" + ",".join(f"{int(v)}L" for v in values) + ")")


def double_array(values: Iterable[float]) -> Column:
    """An array literal of doubles, infinities included."""
    return F.expr("array(" + ",".join(f"double('{float(v)!r}')" for v in values) + ")")


def bin_index(value: Column, low: Column, width: Column, bins: int) -> Column:
    """Equal-width bin number, with the top edge counted in the last bin; NULL stays NULL,
    which ``least`` alone would turn into the last bin."""
    place = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    return F.when(value.isNotNull(), F.greatest(place, F.lit(0))).cast("int")


def named(columns: Sequence[str]) -> list[Column]:
    return [col(c) for c in columns]
