"""What the operators of this subpackage share: written intermediate tables and joins without hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, require_columns
from gristmill.session import ensure_checkpoint_dir

# Fixed value: Spark's setting for the bytes of an Arrow batch, and what it is lowered to.
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

# Rows that a task turns into Python objects at a time; an Arrow batch may hold many thousand texts.
ROWS_AT_ONCE = 256

# Ids that are handed to all tasks (8 bytes each, with as much again for a second id); more are joined by an exchange.
FEW_IDS = 1_000_000

# At most this many keys can each hold 1/HOT_KEYS of all rows, so a list of them is small for any input.
HOT_KEYS = 256

# Of glibc only; elsewhere freed memory stays with the process.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text under fixed names, whatever other columns there are; a missing text counts as empty."""
    require_columns(docs, key, text)
    small_arrow_batches(docs.sparkSession)
    return docs.select(
        col(key).cast("long").alias("doc_id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text")
    )


def small_arrow_batches(spark: SparkSession) -> None:
    """Let no more text travel to Python at once than a few documents or BATCH_BYTES."""
    if int(spark.conf.get(BATCH_KEY).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS_AT_ONCE, without copying them."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def row_tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in small_batches(batches):
        yield from zip(*[column.to_pylist() for column in batch.columns])


def give_back() -> None:
    """Return to the system what this process has freed; else each of an executor's processes keeps the most it ever held."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares for checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    Later steps read the files, so the rows are not computed again when executors are lost, and
    values that depend on the task that made them stay the same.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(ids: DataFrame, name: str) -> DataFrame:
    """A table of ids, written, and marked for broadcast if it has at most FEW_IDS rows."""
    kept = written(ids, name)
    return F.broadcast(kept) if kept.count() <= FEW_IDS else kept


def join_without_hot_keys(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of many rows with a table that has one row per key, for keys of any frequency.

    Keys that hold at least 1/HOT_KEYS of the rows (there can be no more than HOT_KEYS of them) are
    spread over as many slices as they fill such shares; their table rows are repeated per slice.
    Missing keys match nothing and are spread over all slices.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") * HOT_KEYS >= total).select(
        F.col(key).alias("_hot"), F.ceil(F.col("_n") * HOT_KEYS / F.lit(max(total, 1))).cast("int").alias("_slices")
    )
    hot = F.broadcast(hot)
    left = rows.join(hot, F.col(key) == F.col("_hot"), "left").drop("_hot")
    slices = F.when(F.col(key).isNull(), F.lit(HOT_KEYS)).otherwise(F.coalesce("_slices", F.lit(1)))
    left = left.withColumn("_slice", (F.rand(7) * slices).cast("int")).drop("_slices")
    right = table.join(hot, F.col(key) == F.col("_hot"), "left").drop("_hot")
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
    return left.join(right.drop("_slices"), [key, "_slice"], "left").drop("_slice")
