"""Codes of text features with any number of values, kept as a table and joined to the rows.

The table holds one row per feature and value: the feature's place, the text, its code in sorted
order, and whether the value is frequent. Frequent values are few whatever the table's size, so
they are broadcast; rows that hold one are spread over the exchange of the others by a hash of
the whole row. Values that are frequent only in a table scored later are left to Spark's own
splitting of skewed joins.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import col, is_scalar, long_array, require_columns
from ..session import cut_lineage, ensure_checkpoint_dir, free_files

# A value with at least this part of a feature's rows is frequent, so at most this many are.
HOT_PART = 1_024
# Bits of monotonically_increasing_id() that number the rows of a task.
ID_BITS = 33
# Bits of a row's hash that spread the rows of a frequent value.
SLOT_BITS = 16
# Codes up to this number in each partition of a join are hashed, more are sorted.
HASHED_CODES = 1_000_000
CODES_SCHEMA = "text string, code bigint, feature int, hot boolean"


def code_table(df: DataFrame, texts: Sequence[Column], path: str | None = None) -> tuple[DataFrame, list[int]]:
    """The codes 0, 1, 2, ... of the sorted distinct values of each text, and the number of values of each.

    The table is written as Parquet, to the checkpoint folder unless a path is given. An empty table
    has no values; NULL is no value.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    sizes = _write_numbered(df, texts, path)
    free_files(spark)
    return read_codes(spark, path), sizes


def _write_numbered(df: DataFrame, texts: Sequence[Column], path: str) -> list[int]:
    spark = df.sparkSession
    entries = [F.struct(F.lit(i).alias("feature"), t.alias("text")) for i, t in enumerate(texts)]
    values = df.select(F.inline(F.array(*entries))).where("text IS NOT NULL")
    counts = cut_lineage(values.groupBy("feature", "text").agg(F.count("*").alias("rows")))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = counts.repartitionByRange(tasks, "feature", "text").sortWithinPartitions("feature", "text")
    # The id is the number of the row's task, in order, and of the row in it; another run might cut the tasks elsewhere.
    placed = cut_lineage(ordered.withColumn("place", F.monotonically_increasing_id()))
    task = F.shiftright("place", ID_BITS)
    found = placed.groupBy(task.alias("task"), "feature").agg(F.count("*").alias("values"), F.sum("rows").alias("rows")).collect()
    sizes, rows, inside = [0] * len(texts), [0] * len(texts), [0] * (1 + max((r.task for r in found), default=0))
    for r in found:
        sizes[r.feature] += r["values"]
        rows[r.feature] += r.rows
        inside[r.task] += r["values"]
    starts = long_array([0, *itertools.accumulate(inside)][:-1])
    place = starts[task.cast("int")] + F.col("place").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    first = long_array([0, *itertools.accumulate(sizes)][:-1])
    least = F.array(*[F.lit(n / HOT_PART) for n in rows])
    write_codes(
        placed.select(
            "text",
            (place - first[F.col("feature")]).cast("bigint").alias("code"),
            "feature",
            (F.col("rows") >= least[F.col("feature")]).alias("hot"),
        ),
        path,
    )
    return sizes


def write_codes(codes: DataFrame, path: str) -> None:
    codes.write.partitionBy("feature", "hot").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CODES_SCHEMA).parquet(path)


def row_slot(df: DataFrame) -> Column:
    """A number of a few bits from a hash of all columns of a row."""
    return F.shiftrightunsigned(F.xxhash64(*[col(c) for c in df.columns if is_scalar(df, c)]), 64 - SLOT_BITS).cast("int")


def join_codes(
    df: DataFrame, text: Column, codes: DataFrame, name: str, unknown: Column | None = None, size: int | None = None, slot: Column | None = None
) -> DataFrame:
    """Add the code of a text that is never NULL; a text without one gets `unknown`. `size` is the number of codes, if known.

    `slot` is the row's row_slot(), if it was taken before; then no column has to be exchanged for it alone.
    """
    hot = codes.where("hot").select(F.col("text").alias("__hot_text"), F.col("code").alias("__hot_code"))
    cold = codes.where("NOT hot").select(F.col("text").alias("__cold_text"), F.col("code").alias("__cold_code"))
    if size is not None and size <= HASHED_CODES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        # Spares sorting all rows. Each text has one code, so the codes are dealt evenly.
        cold = cold.hint("shuffle_hash")
    slot = row_slot(df) if slot is None else slot
    marked = df.withColumn("__text", text).join(F.broadcast(hot), F.col("__text") == F.col("__hot_text"), "left")
    # A frequent value has its code already; should its row's slot be some other text, that code comes second.
    sought = F.when(F.col("__hot_code").isNull(), F.col("__text")).otherwise(F.hex(slot))
    joined = marked.withColumn("__sought", sought).join(cold, F.col("__sought") == F.col("__cold_text"), "left")
    code = F.coalesce("__hot_code", "__cold_code", *([] if unknown is None else [unknown]))
    return joined.select(*[col(c) for c in df.columns if c != name], code.alias(name))


@dataclass(frozen=True)
class OneHotVectors:
    """A learned one-hot encoding into sparse vectors, for columns with any number of values.

    Slot i stands for the i-th value in text order. A value that was not learned gives a vector of zeros,
    NULL gives NULL, and so does every row where nothing was learned.
    """

    column: str
    codes: DataFrame
    size: int

    def apply(self, df: DataFrame) -> DataFrame:
        """The table with the column replaced by its vectors, in the column's place."""
        require_columns(df, self.column)
        if not self.size:
            return df.select(*[F.lit(None).cast(VectorUDT()).alias(c) if c == self.column else col(c) for c in df.columns])
        row = F.xxhash64(*[col(c) for c in df.columns if is_scalar(df, c)])
        text = F.coalesce(col(self.column).cast("string"), F.hex(row))
        coded = join_codes(df, text, self.codes, "__code", F.lit(self.size).cast("bigint"), self.size)
        coded = coded.withColumn("__code", F.when(col(self.column).isNotNull(), F.col("__code").cast("double")))
        known = self.codes.sparkSession.range(self.size - 1, self.size).select(F.col("id").cast("double").alias("__code"))
        # The slot for unknown values comes last and is left out, so they have no slot.
        encoder = OneHotEncoder(inputCols=["__code"], outputCols=["__vector"], handleInvalid="keep", dropLast=True).fit(known)
        # The encoder takes no NULL, so such rows go through it as unknown ones.
        filled = coded.select(*[col(c) for c in df.columns], F.coalesce("__code", F.lit(float(self.size))).alias("__code"))
        vector = F.when(col(self.column).isNotNull(), F.col("__vector"))
        return encoder.transform(filled).select(*[vector.alias(c) if c == self.column else col(c) for c in df.columns])


def learn_one_hot_vectors(df: DataFrame, column: str) -> OneHotVectors:
    """Index the values of a column; the index is a written table, never a list on the driver."""
    require_columns(df, column)
    codes, sizes = code_table(df, [col(column).cast("string")])
    return OneHotVectors(column, codes, sizes[0])


class CategoryCodes(Transformer, MLWritable, MLReadable):
    """Adds each feature's code as a number; unseen values get the number of known ones."""

    inputs = Param(Params._dummy(), "inputs", "text columns without NULL", TypeConverters.toListString)
    outputs = Param(Params._dummy(), "outputs", "columns for the codes", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "known values of each column", TypeConverters.toList)

    def __init__(self, inputs: Sequence[str] = (), outputs: Sequence[str] = (), sizes: Sequence[int] = ()):
        super().__init__()
        self._set(inputs=list(inputs), outputs=list(outputs), sizes=list(sizes))
        self.codes: DataFrame | None = None

    def over(self, codes: DataFrame) -> CategoryCodes:
        self.codes = codes
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wanted = zip(self.getOrDefault(self.inputs), self.getOrDefault(self.outputs), self.getOrDefault(self.sizes))
        # Taken once, before the first exchange: columns that nothing else needs stay behind.
        dataset = dataset.withColumn("__slot", row_slot(dataset))
        for i, (text, name, size) in enumerate(wanted):
            codes = self.codes.where(F.col("feature") == i)
            dataset = join_codes(dataset, col(text), codes, name, F.lit(size).cast("bigint"), size, F.col("__slot"))
            dataset = dataset.withColumn(name, col(name).cast("double"))
        return dataset.drop("__slot")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: CategoryCodes):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        write_codes(self.stage.codes, f"{path}/codes")


class _Reader(MLReader):
    def load(self, path: str) -> CategoryCodes:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = CategoryCodes()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage.over(read_codes(self.sparkSession, f"{path}/codes"))
