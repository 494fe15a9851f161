"""Spelling variants: words that differ by one code point, found with a bidirectional FM-index.

A word within one error of another has one of its halves unchanged. Words are dealt to shards by length
and by the start or the end that such a half covers, so each word is looked for in six shards, however
many there are. A shard indexes its words as one delimited text and searches all its patterns at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, keyed_texts, small_batches, written
from .fm_index import BidirectionalIndex

# Letters of a run in Latin-1, where each is one byte; all else separates runs.
RUN_BYTES = bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)])
MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97
# Distinct runs that a task holds before it passes its counts on.
HELD = 400_000
# Words that the index of a shard holds on average, and words of one key from which on a key is spread.
SHARD_WORDS = 10_000
HOT_WORDS = 100_000

_TABLE = bytes(chr(c).lower().encode()[0] if 65 <= c < 91 else c if c in RUN_BYTES else 32 for c in range(256))


class _Runs(dict):
    """Numbers of runs in order of their first sight."""

    def __missing__(self, run: bytes) -> int:
        self[run] = number = len(self)
        return number


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in Latin-1, with A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def damaged(run: bytes, checksum: int) -> bytes:
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


class Tally:
    """Counts of words over texts, where a run loses a code point if 97 divides the CRC-32 of its id and itself.

    The checksum of a text after a prefix is the exclusive or of its own checksum and one that depends on the
    prefix and the length alone, so runs are checked by table look-ups.
    """

    def __init__(self, min_length: int = MIN_LENGTH):
        self._min = min_length
        self._zeros: list[int] = [0]
        self.clear()

    def clear(self) -> None:
        self.runs, self._checksums, self._lengths = _Runs(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._counts, self._damaged = np.zeros(0, np.int64), Counter()

    def add(self, ids: list, texts: list[str]) -> None:
        """Count a batch of texts."""
        numbers = [np.array(list(map(self.runs.__getitem__, runs_of(t))), dtype=np.int64) for t in texts]
        names = list(self.runs)
        fresh = [n.decode("latin-1").encode() for n in names[len(self._checksums) :]]
        self._checksums = np.concatenate([self._checksums, np.array([zlib.crc32(f) for f in fresh], dtype=np.int64)])
        self._lengths = np.concatenate([self._lengths, np.array([len(f) for f in fresh], dtype=np.int64)])
        while len(self._zeros) <= self._lengths.max(initial=0):
            self._zeros.append(zlib.crc32(b"\0", self._zeros[-1]))
        seen = [np.zeros(0, np.int64)]
        for doc_id, own in zip(ids, numbers):
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            distinct, times = np.unique(own, return_counts=True)
            lengths = self._lengths[distinct]
            shifted = np.zeros(lengths.max(initial=0) + 1, dtype=np.int64)
            moved, reached = prefix, 0
            for length in np.unique(lengths).tolist():
                moved, reached = zlib.crc32(bytes(length - reached), moved), length
                shifted[length] = moved ^ self._zeros[length]
            checksums = shifted[lengths] ^ self._checksums[distinct]
            hits = np.flatnonzero(checksums % DAMAGE == 0)
            for i in hits.tolist():
                word = damaged(names[distinct[i]], int(checksums[i]))
                if len(word) >= self._min:
                    self._damaged[word] += int(times[i])
            if len(hits):
                own = own[~np.isin(own, distinct[hits])]
            seen.append(own)
        counts = np.bincount(np.concatenate(seen), minlength=len(names))
        counts[: len(self._counts)] += self._counts
        self._counts = counts

    def rows(self) -> pa.RecordBatch:
        """word and n of all words of the wanted length so far; a word may have two rows."""
        words = [(r, n) for r, n in zip(self.runs, self._counts.tolist()) if n and len(r) >= self._min]
        words += self._damaged.items()
        self.clear()
        return pa.record_batch([pa.array([w.decode("latin-1") for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n, the words of the texts after damage that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(min_length)
        for batch in small_batches(batches):
            tally.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(tally.runs) > HELD:
                yield tally.rows()
        yield tally.rows()

    counted = keyed_texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """word and near, each pair in both directions: one code point replaced, inserted or left out.

    words: distinct words in `word`. A word of n code points is indexed under its first and its last
    (n-1)/2 code points; these are within the unchanged half of every word of n-1 to n+1 code points that
    it is near to. Keys of very many words are spread over slices, in all of which their patterns are searched.
    """
    size = F.length("word")

    def keys(length, kind):
        half = F.floor((length - 1) / 2).cast("int")
        ends = (F.substr("word", F.lit(1), half), F.substr("word", size - half + 1, half))
        return [
            F.struct(F.lit(kind).alias("indexed"), F.lit(i == 0).alias("start"), F.xxhash64(F.lit(i), length, end).alias("key"))
            for i, end in enumerate(ends)
        ]

    posted = words.select("word", F.inline(F.array(*keys(size, True))))
    asked = words.select("word", F.inline(F.array(*keys(size - 1, False), *keys(size, False), *keys(size + 1, False))))
    hot = posted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT_WORDS).cast("int").alias("slices")).where("slices > 1")
    hot = bounded(hot, "hot-keys")
    slices = F.coalesce("slices", F.lit(1))
    posted = posted.join(hot, "key", "left").withColumn("slice", F.pmod(F.xxhash64("word"), slices).cast("int"))
    asked = asked.join(hot, "key", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    shards = -(-2 * words.count() // SHARD_WORDS) or 1
    dealt = posted.unionByName(asked).select("word", "indexed", "start", F.pmod(F.xxhash64("key", "slice"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard", "start").applyInArrow(_search_shard, "word string, near string").distinct()


def _search_shard(group: pa.Table) -> pa.Table:
    indexed = group.column("indexed")
    own, asked = (sorted(set(group.filter(f).column("word").to_pylist())) for f in (indexed, pc.invert(indexed)))
    if not own or not asked:
        return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string())})
    index = BidirectionalIndex([w.encode("latin-1") for w in own])
    patterns, places = index.one_error([w.encode("latin-1") for w in asked], group.column("start")[0].as_py())
    pairs = pa.table({"word": pa.array(asked, pa.string()).take(pa.array(patterns)), "near": pa.array(own, pa.string()).take(pa.array(places))})
    # Leaving out one of two equal code points, or replacing one by way of two schemes, gives a word twice.
    return pairs.group_by(["word", "near"]).aggregate([])


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where each word's chain of forms ends; forms: word and form, without cycles.

    Each round doubles the number of steps that a word has followed. As counts double along a chain,
    a few rounds are enough.
    """
    reached = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Per word: word, form, root, n, n_near and form_n.

    Words are what is left of the texts' runs of Latin letters after damage (see Tally), of at least
    `min_length` code points and `min_count` occurrences. form: the near word that occurs most often (ties:
    the first in code-point order), if at least twice as often as the word; root: where the chain of forms
    ends, the word itself if it has none; n_near: number of near words.

    A missing or empty text has no words, a missing doc_id counts as an empty one, repeated rows count each
    time, and texts and runs of any length are taken whole. No words give no rows; other columns are left out.
    """
    words = written(vocabulary(docs, min_length, min_count), "words")
    pairs = written(near_pairs(words), "near-words")
    best = F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best")
    near = pairs.join(words.select(F.col("word").alias("near"), "n"), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    known = words.join(near, "word", "left")
    often = -F.col("best.less") >= 2 * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    known = written(known, "word-forms")
    ends = roots(known.where("form IS NOT NULL"))
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
