"""A quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are grown level by level from histograms of binned statistics, and flattened into arrays, so
that a batch of documents walks down all trees with a few numpy operations per level. Statistics
and scores are computed by Spark over all documents. Learning uses a bounded sample of labelled rows,
which the rows' hashes choose, and takes place in one task.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, named, require_columns

from .common import keyed_texts, small_batches
from .quality_rules import STOP_WORDS

# About this many labelled rows are learned from; more do not move the split points of so few statistics.
SAMPLE_ROWS = 20_000
BINS = 64
KEEP_SCORE = 0.7

STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_spread", "longest_word", "words_per_line", "short_words",
    "letters", "upper", "digits", "spaces", "symbols", "marks", "pipes", "exclamations", "sentence_ends", "other_bytes",
    "stop_words", "upper_words", "marked_words", "distinct_words", "top_word", "repeated_pairs", "distinct_lines",
    "ended_lines", "bullet_lines", "squeezed",
)

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_CLASSES = ("letters", "upper", "digits", "spaces", "symbols", "marks", "pipes", "exclamations", "sentence_ends", "other_bytes")


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.intp)
    table[:] = _CLASSES.index("letters")
    table[128:] = _CLASSES.index("other_bytes")
    groups = {
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "digits": b"0123456789",
        "spaces": bytes(range(33)),
        "symbols": b"#*$%&<>@^_~=+/\\",
        "marks": b",;:'\"()[]{}-`",
        "pipes": b"|",
        "exclamations": b"!",
        "sentence_ends": b".?",
    }
    for name, group in groups.items():
        table[list(group)] = _CLASSES.index(name)
    return table


_BYTE_CLASS = _byte_classes()


def statistics(text: str) -> list[float]:
    """The statistics of one text, all 0 for an empty one."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    classes = np.bincount(_BYTE_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_CLASSES)) / len(raw)
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,"
    frequent = sum(c for w, c in counts.items() if w.lower() in _STOP)
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in counts.items() if w.isascii() and w[-1] not in letters)
    start = [x.lstrip()[:1] for x in lines]
    end = [x.rstrip()[-1:] for x in lines]
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        np.log1p(n / len(lines)), (lengths <= 3).mean(), *classes, frequent / n, upper / n, marked / n,
        len(counts) / n, max(counts.values()) / n, sum(c for c in pairs.values() if c > 1) / n,
        len(set(lines)) / len(lines), sum(e in (b".", b"?", b"!") for e in end) / len(lines),
        sum(s in (b"-", b"*", b"|") for s in start) / len(lines), len(zlib.compress(raw, 1)) / len(raw),
    ]


@dataclass(frozen=True)
class FlatTrees:
    """Complete trees of one depth as arrays: node i of a tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees × inner nodes
    threshold: np.ndarray  # trees × inner nodes; a value goes right when it is greater
    leaf: np.ndarray  # trees × leaves
    start: float

    def margins(self, values: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, which = np.arange(len(values))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(values), trees), dtype=np.intp)
        for _ in range((inner + 1).bit_length() - 1):
            right = values[rows, self.feature[which, node]] > self.threshold[which, node]
            node = 2 * node + 1 + right
        return self.start + self.leaf[which, node - inner].sum(axis=1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(values)))

    def to_json(self) -> str:
        return json.dumps([self.feature.tolist(), self.threshold.tolist(), self.leaf.tolist(), self.start])

    @staticmethod
    def from_json(text: str) -> FlatTrees:
        feature, threshold, leaf, start = json.loads(text)
        return FlatTrees(np.array(feature, dtype=np.intp), np.array(threshold), np.array(leaf), start)


def grow(
    values: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 1.0, least: int = 10
) -> FlatTrees:
    """Boost trees on the logistic loss from histograms of at most BINS bins per statistic."""
    rows, width = values.shape
    inner = (1 << depth) - 1
    positive = labels.mean() if rows else 0.5
    start = float(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
    shape = (trees, inner)
    feature, threshold = np.zeros(shape, dtype=np.intp), np.full(shape, np.inf)
    leaf = np.zeros((trees, inner + 1))
    if rows < 2 * least or labels.min() == labels.max():
        return FlatTrees(feature, threshold, leaf, start)
    edges = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    slots = binned + np.arange(width) * BINS
    margin = np.full(rows, start)
    for tree in range(trees):
        score = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - score, score * (1 - score)
        node = np.zeros(rows, dtype=np.intp)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            keys = (slots + ((node - first) * width * BINS)[:, None]).ravel()
            size = count * width * BINS
            histograms = [
                np.bincount(keys, None if v is None else np.repeat(v, width), size).reshape(count, width, BINS)
                for v in (gradient, weight, None)
            ]
            g, h, n = (x.cumsum(axis=2) for x in histograms)
            g_all, h_all, n_all = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(n < least) | (n_all - n < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i in range(count):
                j, at = divmod(int(best[i]), BINS)
                if gain[i, j, at] > 1e-9 and at < len(edges[j]):
                    feature[tree, first + i], threshold[tree, first + i] = j, edges[j][at]
            right = values[np.arange(rows), feature[tree, node]] > threshold[tree, node]
            node = 2 * node + 1 + right
        at = node - inner
        g, h = (np.bincount(at, v, inner + 1) for v in (gradient, weight))
        leaf[tree] = rate * g / (h + ridge)
        margin += leaf[tree, at]
    return FlatTrees(feature, threshold, leaf, start)


def held_out(doc_id=None):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; they are never learned from."""
    key = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FlatTrees:
    """Trees from the labelled rows that are not held out.

    labels has doc_id and quality (1 or 0; other rows are passed over). Of a larger table about
    sample_rows rows are taken, by a hash of their ids. Without rows of both kinds every score is the
    share of label 1 (1/2 without any).
    """
    require_columns(labels, "doc_id", "quality")
    known = labels.where(col("quality").isin(0, 1)).select(col("doc_id").cast("long").alias("doc_id"), col("quality").cast("int").alias("quality"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * sample_rows / total))
    # At most about sample_rows ids, so the documents are not exchanged for this join.
    rows = keyed_texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    measured = rows.mapInArrow(_measured_labels, "doc_id long, quality int, values array<double>")
    model = measured.dropDuplicates(["doc_id"]).coalesce(1).sortWithinPartitions("doc_id").mapInArrow(_fit, "model string")
    return FlatTrees.from_json(model.first()["model"])


def score(docs: DataFrame, trees: FlatTrees, keep: float = KEEP_SCORE) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 where score >= keep).

    A missing text counts as empty; an empty text has a score like any other. Rows without doc_id are
    not held out. Repeated rows are scored each; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    scored = keyed_texts(docs).mapInArrow(_scorer(shared), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, trees: FlatTrees, keep: float = KEEP_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    # All columns travel as one struct: single ones are looked up by name, and names may hold dots.
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(0).field(batch.column(0).type.get_field_index("text"))
            values = np.array([statistics(t or "") for t in texts.to_pylist()])
            yield batch.filter(pa.array(shared.value.scores(values) >= keep))

    return rows.mapInArrow(choose, rows.schema).select("row.*")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep: float = KEEP_SCORE) -> DataFrame:
    """Learn from the labels and score every document; see learn and score."""
    return score(docs, learn(docs, labels, sample_rows), keep)


def _measured_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        values = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
        yield pa.record_batch([batch.column(0), batch.column(2), values], names=["doc_id", "quality", "values"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values, labels = [np.zeros((0, len(STATISTICS)))], [np.zeros(0)]
    for batch in batches:
        if batch.num_rows:
            labels.append(batch.column(1).to_numpy().astype(float))
            values.append(batch.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS)))
    yield pa.record_batch([[grow(np.concatenate(values), np.concatenate(labels)).to_json()]], names=["model"])


def _scorer(shared):
    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in small_batches(batches):
            values = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), pa.array(trees.scores(values))], names=["doc_id", "score"])

    return score_batches
