"""Best-fit decreasing packing of token pieces into sequences of a fixed length.

Best-fit decreasing looks at lengths only, so pieces of one length are interchangeable. The plan is
made from the histogram of lengths (as many numbers as a sequence has tokens): for each length, in
descending order, a segment tree over remaining capacities finds the tightest open sequences in
logarithmic time, and a whole run of equal pieces goes into a run of equal sequences. The
pieces are then numbered within their length by Spark and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_texts, small_batches, written
from .encoding import ID_TYPE, encoder

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenCapacities:
    """A segment tree over remaining capacities 0..capacity, with the runs of sequences that have them."""

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._open = [0] * (2 * self._leaves)
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        self._runs.setdefault(room, []).append((first, count))
        self._change(room, count)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length."""
        node = self._leaves + length
        if self._open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self._open[node + 1]:
                node += 1
                while node < self._leaves:
                    node = 2 * node if self._open[2 * node] else 2 * node + 1
                return node - self._leaves
            node //= 2
        return None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Remove up to `most` sequences of this capacity: first number and count."""
        first, count = self._runs[room].pop()
        if count > most:
            self._runs[room].append((first + most, count - most))
            count = most
        self._change(room, -count)
        return first, count

    def _change(self, room: int, by: int) -> None:
        node = self._leaves + room
        while node:
            self._open[node] += by
            node //= 2


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) of the best-fit decreasing packing.

    Ranks count the pieces of one length from 0; the ranks and the sequences of a run go up together.
    """
    rooms, opened, runs = OpenCapacities(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # A new sequence is the tightest for the next pieces of this length while it has room.
                each = min(capacity // length, left)
                full = left // each
                for i in range(each):
                    runs.append((length, rank, full, opened, i * length))
                    rank += full
                rooms.add(capacity - each * length, opened, full)
                opened += full
                left -= each * full
                continue
            first, count = rooms.take(room, left)
            runs.append((length, rank, count, first, capacity - room))
            rooms.add(room - length, first, count)
            rank += count
            left -= count
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Place every document, encoded and closed with end_id, into sequences of at most `capacity` tokens.

    Longer documents are cut into pieces of `capacity`; the rest, if any, comes first. Returns per
    piece doc_id, piece, start, length, ids_crc32, sequence_id and offset. A missing text counts as
    empty (one token, the end id). Repeated rows and ids are packed once per row. Other columns are
    left out; an empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    # Ranks depend on the task that made a row, so the pieces are written before they are numbered.
    pieces = written(keyed_texts(docs).mapInArrow(_cutter(tokenizer, capacity, end_id), _PIECES), "pieces")
    counts = written(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(bases.hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("rank"))
    places = pieces.sparkSession.sparkContext.broadcast(_by_length(plan(histogram, capacity)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    return ranked.select(*columns).mapInArrow(_placer(places), _PLACED)


def _by_length(runs) -> dict[int, np.ndarray]:
    table: dict[int, list] = {}
    for length, *run in runs:
        table.setdefault(length, []).append(run)
    return {length: np.array(rows, dtype=np.int64) for length, rows in table.items()}


def _cutter(tokenizer: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(tokenizer)
        end = np.array([end_id], dtype=ID_TYPE).tobytes()
        task, width = TaskContext.get().partitionId(), ID_TYPE.itemsize
        ranks: dict[int, int] = {}
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = texts.encode(text) + end
                total = len(ids) // width
                edges = list(range(total % capacity, total + 1, capacity))
                edges = edges if edges[0] == 0 else [0, *edges]
                for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    rank = ranks.get(b - a, 0)
                    ranks[b - a] = rank + 1
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[a * width : b * width]), task, rank))
            if rows:
                yield _batch(rows, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return cut


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _placer(places):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                runs = table[int(length)]
                at = np.searchsorted(runs[:, 0], ranks[here], side="right") - 1
                sequence[here] = runs[at, 2] + ranks[here] - runs[at, 0]
                offset[here] = runs[at, 3]
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.record_batch(columns, names=names)

    return place
