"""Token ids in Parquet files that can be read selectively.

One row per document in ascending doc_id order, over files that follow each other in that order.
Ids are dictionary-encoded lists, keys and positions delta-encoded; row groups and pages are small
enough that the page index leads a reader of some documents to their pages, and metadata can be
read without the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_texts, row_tuples
from .encoding import ID_TYPE, encoder

FILE_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
WRITER_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
END_ID = 0
_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("shard", pa.int32()),
        ("shard_start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
# Words of each of the encoder's two generations.
REMEMBERED = 600_000
# Ids held before a batch of rows is handed to the writer.
BATCH_IDS = 1 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text, append end_id, and write the ids under path in ascending doc_id order.

    Rows without doc_id come first; rows with the same doc_id follow each other, ordered by a hash
    of their text. A missing text counts as empty, so its document has only the end id. An empty
    table gives files without rows. Other columns are left out.
    """
    texts = keyed_texts(docs).withColumn("tie", F.xxhash64("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(_encoder(tokenizer, end_id), FILE_SCHEMA)
    rows.write.options(**WRITER_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    # One row per file, at most as many as there are shuffle partitions.
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "shard")
    return joined.select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_checksum(tokens: DataFrame) -> DataFrame:
    """The same rows with ids_crc32 (over little-endian unsigned 32-bit ids) in place of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def _encoder(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(tokenizer, REMEMBERED)
        end = np.array([end_id], dtype=ID_TYPE).tobytes()
        shard, start = TaskContext.get().partitionId(), 0
        keys, held, sizes, size = [], [], [], 0
        for doc_id, text in row_tuples(batches):
            ids = texts.encode(text) + end
            keys.append(doc_id)
            held.append(ids)
            sizes.append(len(ids) // ID_TYPE.itemsize)
            size += sizes[-1]
            if size > BATCH_IDS:
                yield _rows(keys, shard, start, sizes, held)
                start += size
                keys, held, sizes, size = [], [], [], 0
        if keys:
            yield _rows(keys, shard, start, sizes, held)

    return encode


def _rows(keys, shard, start, sizes, held) -> pa.RecordBatch:
    ends = np.cumsum([0, *sizes])
    values = pa.array(np.frombuffer(b"".join(held), dtype="<i4"))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    columns = [
        pa.array(keys, pa.int64()),
        pa.array(np.full(len(keys), shard, dtype=np.int32)),
        pa.array(ends[:-1] + start, pa.int64()),
        pa.array(sizes, pa.int64()),
        lists,
    ]
    return pa.record_batch(columns, schema=_ROWS)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy().astype("<i4")
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
