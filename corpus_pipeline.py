"""A corpus pipeline: judge quality, keep one of near copies, drop leaks, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.expressions import col, named
from gristmill.llm import decontaminate, jaccard_join, packing, quality_model, secret_scan
from gristmill.llm.common import bounded, join_without_hot_keys, read_table, small_arrow_batches, small_batches, written
from gristmill.llm.encoding import tokenizer_path

# Findings of up to so many bytes are handed to all tasks; more are joined by an exchange.
FEW_BYTES = 32 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts; it learns from the labels of documents in docs.

    Every row is judged by its text, missing ones as empty texts.
    """
    return quality_model.accepted(docs, quality_model.learn(docs, read_table(spark, sf_dir, "labels")))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Of rows that are given several times one stays. Rows without an id cannot be named and stay.
    """
    found = jaccard_join.near_duplicates(docs).where("doc_id IS NOT NULL").withColumn("is_copy", F.expr("doc_id <> component_id"))
    ids = found.groupBy("doc_id").agg(F.max("is_copy").alias("some"), F.min("is_copy").alias("every"))
    ids = written(ids.where("some"), "ids-of-copies")
    copies = bounded(ids.where("every").select("doc_id"), "copies")
    left = docs.join(copies, "doc_id", "left_anti").select(*named(docs.columns))
    mixed = bounded(ids.where("NOT every").select("doc_id"), "mixed-ids")
    if not mixed.isEmpty():
        # Ids of several texts, some of them copies: these are told apart by their sets.
        gone = found.where("is_copy").join(mixed, "doc_id", "left_semi").select("doc_id", "set_key").distinct()
        own = jaccard_join.with_set_keys(left.join(mixed, "doc_id", "left_semi").select(*named(docs.columns)))
        own = own.join(gone, (F.col("row.doc_id") == gone["doc_id"]) & (own["set_key"] == gone["set_key"]), "left_anti")
        left = left.join(mixed, "doc_id", "left_anti").select(*named(docs.columns)).union(own.select("row.*"))
    repeated = bounded(left.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    single = left.join(repeated, "doc_id", "left_anti").select(*named(docs.columns))
    return single.union(left.join(repeated, "doc_id", "left_semi").select(*named(docs.columns)).dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; rows without an id stay."""
    return decontaminate.without_leaks(docs, decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted anew."""
    small_arrow_batches(spark)
    ledger = spark.createDataFrame([], secret_scan.LEDGER_SCHEMA)
    fresh = written(secret_scan.scan_unseen(docs, ledger), "secret-ledger")
    found = fresh.where("spans <> ''").select("blob", F.col("spans").alias("found_spans"))
    # The text decides, so rows without an id and ids of several texts get the spans of their own.
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), secret_scan.blob_of("text").alias("blob"))
    if (found.agg(F.sum(F.length("found_spans") + 64)).first()[0] or 0) <= FEW_BYTES:
        joined = rows.join(F.broadcast(found), "blob", "left")
    else:
        joined = join_without_hot_keys(rows, found, "blob")
    schema = T.StructType([T.StructField("row", docs.select(F.struct(*named(docs.columns)).alias("row")).schema["row"].dataType)])
    masked = joined.select("row", "found_spans").mapInArrow(_mask, schema).select("row.*")
    counted = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return masked.select(*[counted if c == "n_chars" else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

# The classifier and the tokenizer cannot be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = batch.column(0)
        at = rows.type.get_field_index("text")
        texts = [
            t if t is None or not s else secret_scan.masked(t, s)
            for t, s in zip(rows.field(at).to_pylist(), batch.column(1).to_pylist())
        ]
        fields = [pa.array(texts, rows.type[i].type) if i == at else rows.field(i) for i in range(rows.type.num_fields)]
        yield pa.record_batch([pa.StructArray.from_arrays(fields, fields=list(rows.type))], names=["row"])
