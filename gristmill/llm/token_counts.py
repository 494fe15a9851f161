"""Token counts without ids: count each distinct pre-token once, then add up.

SentencePiece BPE merges within words only when no piece holds the word mark anywhere but at its
front, so a text's count is the sum over its pre-tokens. A pre-token is a run of spaces and the
word behind it; it is keyed here by its text without the first space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, row_tuples, small_batches, written

WORD_MARK = "▁"
# This many pre-tokens at most, the most frequent ones, are added up inside the tasks that read the
# texts. All others are joined, so the number decides only how many rows are exchanged.
HEAD = 1 << 18
# Distinct pre-tokens that a task holds before it passes its sums on.
HELD = 250_000

_SEEN = pa.schema([("pre", pa.string()), ("seen", pa.int64())])
_PIECES = pa.schema([("pre", pa.string()), ("seen", pa.int64()), ("pieces", pa.int64())])
_PARTS = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("pre", pa.string()),
        ("times", pa.int64()),
        ("known", pa.int64()),
    ]
)


def pre_tokens(text: str) -> list[str]:
    """Keys of the text's pre-tokens in order; the empty key is a lone space at the end."""
    if not text:
        return []
    parts = text.replace(WORD_MARK, " ").split(" ")
    if "" not in parts:
        return parts
    keys, spaces = [], 0
    for part in parts:
        if part:
            keys.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        keys.append(" " * (spaces - 1))
    return keys


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    One row per input row, repeated rows and ids included. A missing text counts as empty: 0 bytes,
    0 tokens. Texts of any length are counted whole; other columns are left out.
    """
    texts = keyed_texts(docs)
    seen = texts.select("text").mapInArrow(_tally, "pre string, seen long")
    distinct = seen.groupBy("pre").agg(F.sum("seen").alias("seen"))
    pieces = written(
        distinct.mapInArrow(_piece_counter(model_path), "pre string, seen long, pieces long"), "piece-counts"
    )

    is_head = F.col("seen") >= _head_threshold(pieces)
    head = pieces.where(is_head).select("pre", "pieces").toArrow()
    known = texts.sparkSession.sparkContext.broadcast(dict(zip(*[c.to_pylist() for c in head.columns])))

    parts = texts.mapInArrow(
        _part_maker(known), "row long, doc_id long, n_bytes long, pre string, times long, known long"
    )
    rest = pieces.where(~is_head).select("pre", "pieces")
    counted = parts.join(rest, "pre", "left").groupBy("row", "doc_id", "n_bytes")
    counted = counted.agg(F.sum(F.col("known") + F.col("times") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _head_threshold(pieces: DataFrame) -> int:
    """The least number of occurrences that at most HEAD pre-tokens reach, to the next step of a tenth."""
    step = F.floor(F.log(F.col("seen").cast("double")) / F.log(F.lit(1.1))).cast("int")
    # A few hundred rows: one per step.
    steps = pieces.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("least"))
    reached, threshold = 0, 1 << 62
    for row in steps.orderBy(F.desc("step")).collect():
        reached += row["n"]
        if reached > HEAD:
            break
        threshold = row["least"]
    return threshold


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for (text,) in row_tuples(batches):
        counts.update(pre_tokens(text))
        if len(counts) > HELD:
            yield pa.record_batch([list(counts), list(counts.values())], schema=_SEEN)
            counts = Counter()
    yield pa.record_batch([list(counts), list(counts.values())], schema=_SEEN)


def _piece_counter(model_path: str):
    def count(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        inner = [i for i in range(model.vocab_size()) if WORD_MARK in model.id_to_piece(i).lstrip(WORD_MARK)]
        if inner:
            raise ValueError("pieces of this model reach over word borders; its texts have no separate pre-tokens")
        lone_space = len(model.encode("a ")) - len(model.encode("a"))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            counts = [len(ids) if key else lone_space for key, ids in zip(keys, model.encode(keys, num_threads=1))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=_PIECES)

    return count


def _part_maker(known):
    """Per text: one row with what the frequent pre-tokens sum to, and one row per other pre-token."""

    def parts(batches):
        pieces = known.value
        row = TaskContext.get().partitionId() << 36
        for batch in small_batches(batches):
            rows, ids, sizes, pres, times, sums = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = pre_tokens(text)
                found = list(map(pieces.get, keys))
                rest = Counter()
                if None in found:
                    rest = Counter(k for k, f in zip(keys, found) if f is None)
                    found = [f for f in found if f is not None]
                n = len(rest) + 1
                rows += [row] * n
                ids += [doc_id] * n
                sizes += [len(text.encode())] * n
                # The row of the sum has a key of its own, so these rows meet no common key in the join.
                pres.append(f"\0{row}")
                pres += rest.keys()
                times.append(0)
                times += rest.values()
                sums.append(sum(found))
                sums += [0] * (n - 1)
                row += 1
            yield pa.record_batch([rows, ids, sizes, pres, times, sums], schema=_PARTS)

    return parts
