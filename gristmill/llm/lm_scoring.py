"""Language-model scores by deleted interpolation.

P(w | u) = r(u) c(uw)/c(u) + (1 - r(u)) P(w),  P(w) = s c(w)/N + (1 - s)/(V + 1): estimates by counts, mixed
with weights that depend on the bucket of how often the context u occurs. Counts come from the training texts;
the weights are learned by expectation-maximisation on a part of these texts that is held out, against the
counts of the others.

Words and word pairs travel as sorted arrays of whole numbers, one array per task and partition, not as rows.
Pairs of frequent words (a bounded list that all tasks know) are numbered by their words. A pair with one rare
word goes to the partition that holds this word's counts; only pairs of two rare words need a join. A text's
score is what it would be if it had no known pair and no rare word, plus a correction for each of these it
has, added up where it is known. Words and pairs with rare words are told apart by 63-bit hashes or more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keyed_texts, small_batches, written
from .word_hashes import mixed

# Words, and pairs of them, that all tasks know: at most so many, the most frequent ones. The numbers decide
# only how many entries are exchanged.
HEAD_WORDS = 1 << 19
HEAD_PAIRS = 1 << 18
# Tokens that a task gathers before it passes on what it has counted, distinct words after which it forgets
# their numbers, and tokens for each partition of pairs.
HELD = 500_000
# Bytes of packed arrays that a task hands back at a time.
BATCH_BYTES = 1 << 20
WORDS_HELD = 200_000
# Pairs that a task turns from counts into ratios or gains at a time.
PAIRS_AT_ONCE = 1 << 17
PARTITION_TOKENS = 1 << 21
MOST_PARTITIONS = 1 << 20
# One training document in so many is held out for the weights.
HELD_OUT = 8
# Histogram of the ratios of two estimates: steps of an octave.
STEPS = 16
NEVER = -1_000_000
# Weights stay this far from 0 and 1.
MARGIN = 1e-6

# The end token is the empty word, the start of a text a word that no text has.
END_WORD, START_WORD = b"", b"\n"
END = xxhash.xxh64_intdigest(END_WORD)
_SHIFT = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
_ONE = np.uint64(1)
_TAG = np.uint64(1 << 63)

# Kinds of rows, in the order in which a partition needs them.
RARE_WORDS, HEAD_PAIR, RARE_PAIR, TWO_RARE, HISTOGRAM, ASKED, OWN = range(7)

_COUNTED = "p int, kind int, keys binary, other binary, n binary, b binary"
_MODEL = "p int, kind int, keys binary, n binary, nu binary, nw binary, key long, w long, times long, kept long, un long, ua long, bucket int, bin int, weight double, moment double"
_PARTS = "p int, kind int, block long, keys binary, x binary, y binary, z binary"
_SUMS = "block long, kind int, keys binary, x binary, y binary"


@dataclass
class Head:
    """The frequent words, in order of their keys, with START and END behind them."""

    keys: np.ndarray
    n: np.ndarray
    a: np.ndarray

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words that are not in the list."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """Counts, weights and tables that score() needs."""

    tokens: int
    words: int
    unigram: float
    weights: list[float]
    head: Head
    pairs: DataFrame
    two_rare: DataFrame
    partitions: int

    def word_probability(self, n):
        return word_probability(n, self.tokens, self.words, self.unigram)


def word_probability(n, tokens: int, words: int, weight: float):
    return weight * n / max(tokens, 1) + (1 - weight) / (words + 1)


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for contexts that do not occur, else one more than the binary logarithm."""
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)


def learn_weight(counts: np.ndarray, ratios: np.ndarray, rounds: int = 500) -> float:
    """The weight r that makes sum(counts * log(r * ratios + 1 - r)) largest, by expectation-maximisation."""
    total = counts.sum()
    if not total:
        return 0.5
    weight = 0.5
    for _ in range(rounds):
        share = weight * ratios / (weight * ratios + 1 - weight)
        new = float(np.clip((counts * share).sum() / total, MARGIN, 1 - MARGIN))
        if abs(new - weight) < 1e-10:
            break
        weight = new
    return weight


def weights_by_bucket(rows: list) -> list[float]:
    """A weight per bucket from rows (bucket, bin, weight, moment); a bucket without any takes the nearest one's."""
    learned = {}
    for b in {r["bucket"] for r in rows if r["bucket"] > 0}:
        own = [r for r in rows if r["bucket"] == b]
        counts, moments = (np.array([r[c] for r in own], dtype=float) for c in ("weight", "moment"))
        learned[b] = learn_weight(counts, moments / counts)
    nearest = [learned[min(learned, key=lambda k: (abs(k - b), k))] if learned else 0.5 for b in range(1, 65)]
    return [0.0, *nearest]


def held_out(doc_id: Column, of: int = 7, rest: int = 2) -> Column:
    """Whether the CRC-32 of the id's text leaves that rest; a missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def learn(docs: DataFrame) -> Model:
    """A model of the texts of docs.

    A missing or empty text is a single end token. Rows without doc_id and repeated rows count like others;
    the eighth of the documents that teach the weights is chosen by doc_id. No rows give a model for which
    every token has probability 1.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    fold = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7) % HELD_OUT == 0, F.lit(False))
    texts = texts.select("text", fold.alias("aside"))
    counted = texts.mapInArrow(_count_words, "key long, n long, b long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    vocabulary = written(counted.select("key", "n", (F.col("n") - F.col("b")).alias("a")), "words")
    row = vocabulary.agg(F.sum("n"), F.sum("a"), F.count(F.lit(1))).first()
    tokens, kept, words = row[0] or 0, row[1] or 0, row[2]

    ratio = F.col("a") / max(kept, 1) * (words + 1)
    rows = _histogram(vocabulary, F.lit(1), ratio, F.col("n") - F.col("a")).collect() if kept else []
    unigram = weights_by_bucket(rows)[1] if tokens else 0.0

    tail_from = _threshold(vocabulary, "n", HEAD_WORDS)
    table = vocabulary.where(F.col("n") >= tail_from).where(F.col("key") != _signed(END)).toArrow()
    ends = vocabulary.where(F.col("key") == _signed(END)).first()
    keys, n, a = (table.column(c).to_numpy() for c in ("key", "n", "a"))
    order = np.argsort(keys.view(np.uint64))
    last = [[ends[c] if ends else 0] * 2 for c in ("n", "a")]
    head = Head(keys.view(np.uint64)[order], np.concatenate([n[order], last[0]]), np.concatenate([a[order], last[1]]))
    known = spark.sparkContext.broadcast(head)

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PARTITION_TOKENS), 1)
    partitions = min(partitions, MOST_PARTITIONS)
    rare = vocabulary.where(F.col("n") < tail_from).where(F.col("key") != _signed(END))
    rare = rare.select("key", "n", (F.col("n") - F.col("a")).alias("b")).mapInArrow(_pack_words(partitions), _COUNTED)
    entries = rare.union(texts.mapInArrow(_count_pairs(known, partitions), _COUNTED))
    entries = entries.repartition(partitions, "p").sortWithinPartitions("p", "kind")
    base = (kept, words, unigram)
    merged = written(entries.mapInArrow(_merge_pairs(known, base), _MODEL), "pairs")
    # Pairs of two rare words have the counts of the first one; the second one's are joined.
    second = vocabulary.select(F.col("key").alias("w"), F.col("n").alias("wn"), F.col("a").alias("wa"))
    two_rare = written(merged.where(F.col("kind") == TWO_RARE).select("p", "key", "w", "times", "kept", "un", "ua").join(second, "w"), "two-rare")

    estimate = F.col("kept") / F.col("ua") / word_probability(F.col("wa"), kept, words, unigram)
    level = (F.floor(F.log2(F.col("ua").cast("double"))) + 1).cast("int")
    rest = _histogram(two_rare.where("ua > 0 AND times > kept"), level, estimate, F.col("times") - F.col("kept"))
    seen = merged.where(F.col("kind") == HISTOGRAM).select("bucket", "bin", "weight", "moment").union(rest)
    rows = seen.groupBy("bucket", "bin").agg(F.sum("weight").alias("weight"), F.sum("moment").alias("moment")).collect()
    pairs = merged.where(F.col("kind").isin(RARE_WORDS, HEAD_PAIR, RARE_PAIR))
    return Model(tokens, words, unigram, weights_by_bucket(rows), head, pairs, two_rare, partitions)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score (add-one unigrams) and score, in log10 of the whole text.

    Cases: see learn(). Rows come back each; texts of any length are scored whole; other columns are left out.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((model.head, _Values(model), _head_pairs(model)))
    asked = keyed_texts(docs).mapInArrow(_ask(known, model.partitions), _PARTS)
    none = F.lit(None).cast("long").alias("block")
    pairs = model.pairs.select("p", "kind", none, "keys", F.col("n").alias("x"), F.col("nu").alias("y"), F.col("nw").alias("z"))
    two_rare = model.two_rare.select("p", "key", "times", "un", "wn").mapInArrow(_pack_pairs, _PARTS)
    dealt = pairs.union(two_rare).union(asked).repartition(model.partitions, "p").sortWithinPartitions("p", "kind")
    return dealt.mapInArrow(_answer(known), _SUMS).groupBy("block").applyInArrow(
        _add_up, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def lm_scores(docs: DataFrame, of: int = 7, rest: int = 2) -> DataFrame:
    """Scores of all documents under a model of those that are not held out; see learn() and score().

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"), of, rest)))
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), of, rest).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def _signed(key: int) -> int:
    return int(np.uint64(key).astype(np.int64))


def _histogram(df: DataFrame, level: Column, ratio: Column, weight: Column) -> DataFrame:
    """bucket, bin, weight and moment (weight times ratio): a few thousand rows at most."""
    step = F.when(ratio > 0, F.floor(F.log2(ratio) * STEPS)).otherwise(F.lit(NEVER)).cast("int")
    rows = df.select(level.cast("int").alias("bucket"), step.alias("bin"), weight.cast("double").alias("weight"), ratio.alias("ratio"))
    rows = rows.where("weight > 0").groupBy("bucket", "bin")
    return rows.agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("ratio")).alias("moment"))


def _threshold(df: DataFrame, count: str, most: int) -> int:
    """The least count that at most `most` rows reach, to the next step of a tenth."""
    step = F.floor(F.log(F.col(count).cast("double")) / F.log(F.lit(1.1))).cast("int")
    steps = df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min(count).alias("least"))
    reached, threshold = 0, 1 << 62
    for row in steps.orderBy(F.desc("step")).collect():
        reached += row["n"]
        if reached > most:
            break
        threshold = row["least"]
    return threshold


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of equal weight, so that leading zeros compress to nothing."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pack(keys: np.ndarray) -> bytes:
    """Keys in ascending order, by their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _partition(keys: np.ndarray, partitions: int) -> np.ndarray:
    return ((mixed(keys) >> np.uint64(20)) % np.uint64(partitions)).astype(np.int32)


def _dealt(places: np.ndarray, keys: np.ndarray, *arrays: np.ndarray):
    """For each partition that has keys: its number, its keys in order, and what goes with them."""
    order = np.lexsort((keys, places))
    places, keys, arrays = places[order], keys[order], [a[order] for a in arrays]
    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(keys) else []
    for start, end in zip(starts, [*starts[1:], len(keys)]):
        yield int(places[start]), keys[start:end], *[a[start:end] for a in arrays]


def _summed(keys: np.ndarray, *counts: np.ndarray):
    """Distinct keys in order, the place of one of each, and sums of what goes with them."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ordered[starts], order[starts], *[np.add.reduceat(c[order], starts) if len(starts) else c for c in counts]


def _pair_key(known: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Key of a pair: of a rare word and the other one's place and side, or of two rare words."""
    return mixed(mixed(known) + other) | _TAG


def _word_key(w: np.ndarray) -> np.ndarray:
    return mixed(w ^ np.uint64(0x5851F42D4C957F2D)) | _TAG


def _joined(parts: list[tuple]) -> list[np.ndarray]:
    """The parts' arrays, one after the other; the list is emptied, so that no more than one array is there twice."""
    columns = [list(column) for column in zip(*parts)]
    parts.clear()
    out = []
    for column in columns:
        out.append(np.concatenate(column))
        column.clear()
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Vocabulary:
    """Numbers of the words that a task has seen since it last forgot them, from 0, the end token, on."""

    def __init__(self, head: Head | None = None):
        self._head = head
        self.forget()

    def forget(self) -> None:
        self._numbers = _Numbers()
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self([END_WORD])

    def __len__(self) -> int:
        return len(self._numbers)

    def __call__(self, words: Sequence[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self._numbers.__getitem__, words), np.int32, len(words))
        known = len(self.keys)
        if len(self._numbers) > known:
            fresh = np.array([xxhash.xxh64_intdigest(w) for w in islice(self._numbers, known, None)], dtype=np.uint64)
            self.keys = np.concatenate([self.keys, fresh])
            if self._head is not None:
                self.places = np.concatenate([self.places, self._head.places(fresh)])
                self.places[0] = len(self._head.keys) + 1
        return numbers


def _held(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Texts of about HELD tokens at a time: the column beside the text, the tokens' numbers, lengths of texts."""
    beside, numbers, lengths, size = [], [], [], 0
    for batch in small_batches(batches):
        at = batch.schema.names.index("text")
        beside += batch.column(1 - at).to_pylist()
        words = []
        for text in batch.column(at).to_pylist():
            before = len(words)
            # bytes.lower and bytes.split know A-Z and ASCII white space only, which is what is asked for.
            words += text.encode().lower().split()
            words.append(END_WORD)
            lengths.append(len(words) - before)
        numbers.append(vocabulary(words))
        size += len(words)
        # The words are numbered; only their numbers are kept while a task works on them.
        del words, text
        if size >= HELD or len(vocabulary) > WORDS_HELD:
            numbers = np.concatenate(numbers)
            yield beside, numbers, np.array(lengths, dtype=np.int64)
            beside, numbers, lengths, size = [], [], [], 0
    if beside:
        yield beside, np.concatenate(numbers), np.array(lengths, dtype=np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    n, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows() -> pa.RecordBatch:
        seen = n > 0
        return pa.record_batch([pa.array(x[seen]) for x in (vocabulary.keys.view(np.int64), n, b)], names=["key", "n", "b"])

    for aside, numbers, lengths in _held(batches, vocabulary):
        apart = np.repeat(np.array(aside, dtype=bool), lengths)
        more = [np.bincount(x, minlength=len(vocabulary)) for x in (numbers, numbers[apart])]
        for old, new in zip((n, b), more):
            new[: len(old)] += old
        n, b = more
        if len(vocabulary) > WORDS_HELD:
            yield rows()
            vocabulary.forget()
            n, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(n):
        yield rows()


def _pack_words(partitions: int):
    """Rows of rare words to arrays by partition."""
    names = [c.split()[0] for c in _COUNTED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, b = (c.to_numpy() for c in batch.columns)
            keys = keys.view(np.uint64)
            rows = [(p, RARE_WORDS, _pack(k), None, _planes(n), _planes(b)) for p, k, n, b in _dealt(_partition(_word_key(keys), partitions), keys, n, b)]
            yield from _rows(rows, names)

    return pack


def _numbered(head: Head, vocabulary: Vocabulary, numbers: np.ndarray, lengths: np.ndarray):
    """Places in the head list of tokens and of their contexts (-1: a rare word), and keys of the contexts."""
    starts = np.cumsum(lengths) - lengths
    word = vocabulary.places[numbers]
    context, before = np.roll(word, 1), np.roll(numbers, 1)
    context[starts] = len(head.keys)
    return word, context, before


def _code(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << _SHIFT) | word.astype(np.uint64)


def _rare_parts(vocabulary: Vocabulary, word, context, numbers, before):
    """Pairs with one rare word (where, its key, the other's place and side) and with two (where, both keys)."""
    one = np.flatnonzero((word < 0) != (context < 0))
    first = context[one] < 0
    rare = vocabulary.keys[np.where(first, before[one], numbers[one])]
    other = (np.where(first, word[one], context[one]).astype(np.uint64) << _ONE) | first.astype(np.uint64)
    two = np.flatnonzero((word < 0) & (context < 0))
    return (one, rare, other), (two, vocabulary.keys[before[two]], vocabulary.keys[numbers[two]])


def _count_pairs(known, partitions: int):
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    wide = np.uint64(43)

    def rows_of(head: Head, vocabulary: Vocabulary, aside: list, numbers: np.ndarray, lengths: np.ndarray) -> list[tuple]:
        apart = np.repeat(np.array(aside, dtype=np.uint64), lengths)
        word, context, before = _numbered(head, vocabulary, numbers, lengths)
        rows = []
        frequent = (word >= 0) & (context >= 0)
        code = _code(context[frequent], word[frequent])
        # Partition, pair and fold in one number, so that one plain sort brings all together.
        whole = np.sort((_partition(code, partitions).astype(np.uint64) << wide) | (code << _ONE) | apart[frequent])
        pair = whole >> _ONE
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        n = np.diff(starts, append=len(pair))
        b = np.add.reduceat(whole & _ONE, starts) if len(starts) else n
        place, code = (pair[starts] >> (wide - _ONE)).astype(np.int64), pair[starts] & np.uint64((1 << 42) - 1)
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
        for start, end in zip(cuts, [*cuts[1:], len(place)]):
            rows.append((int(place[start]), HEAD_PAIR, _pack(code[start:end]), None, _planes(n[start:end]), _planes(b[start:end])))
        for kind, (at, rare, other) in zip((RARE_PAIR, TWO_RARE), _rare_parts(vocabulary, word, context, numbers, before)):
            _, one, n, b = _summed(_pair_key(rare, other), np.ones(len(at), np.int64), apart[at].astype(np.int64))
            places = _partition(_word_key(rare[one]), partitions)
            for p, r, o, n, b in _dealt(places, rare[one], other[one], n, b):
                rows.append((p, kind, _pack(r), _planes(o), _planes(n), _planes(b)))
        return rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = known.value
        vocabulary = Vocabulary(head)
        for held in _held(batches, vocabulary):
            yield from _rows(rows_of(head, vocabulary, *held), names)
            if len(vocabulary) > WORDS_HELD:
                vocabulary.forget()
        del vocabulary
        give_back()

    return count


def _rows(rows: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, a kind and binary values, in batches of about BATCH_BYTES; a block goes third if it is among the names."""
    kinds = [pa.int32() if c in ("p", "kind") else pa.int64() if c == "block" else pa.binary() for c in names]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, bytes))
        if size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _merge_pairs(known, base: tuple[int, int, float]):
    """Adds up the counts of a partition's pairs, partition by partition: arrays of keys and counts, rows for
    pairs of two rare words, and a histogram of the ratios that teach the weights."""
    types = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _MODEL.split(", ")])
    limit = 4_000_000

    def batch(rows: int, /, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def compact(parts: list) -> list:
        """The parts as one, added up; the list is emptied on the way."""
        if len(parts) < 2:
            return parts
        keys, n, b, rare, other = _joined(parts)
        keys, one, n, b = _summed(keys, n, b)
        return [(keys, n, b, rare[one] if len(rare) else rare, other[one] if len(other) else other)]

    def histogram(ua, wa, n, b):
        for start in range(0, len(n), PAIRS_AT_ONCE):
            s = slice(start, start + PAIRS_AT_ONCE)
            yield from cells_of(ua[s], wa[s], n[s], b[s])

    def cells_of(ua, wa, n, b):
        levels, ratio = bucket(ua), (n - b) / np.maximum(ua, 1) / word_probability(wa, *base)
        seen = (b > 0) & (levels > 0)
        levels, ratio, times = levels[seen], ratio[seen], b[seen].astype(float)
        if len(times):
            steps = np.where(ratio > 0, np.floor(np.log2(np.where(ratio > 0, ratio, 1)) * STEPS), NEVER).astype(np.int64)
            cells, place = np.unique(levels * np.int64(1 << 32) + steps - NEVER, return_inverse=True)
            sums = [np.bincount(place, weights=x) for x in (times, times * ratio)]
            rows = len(cells)
            yield batch(rows, kind=np.full(rows, HISTOGRAM), bucket=cells >> 32, bin=(cells & ((1 << 32) - 1)) + NEVER, weight=sums[0], moment=sums[1])

    def finished(p: int, held: dict, head: Head):
        for kind in held:
            held[kind] = compact(held[kind])
        rare_keys, rare_n, rare_b = held[RARE_WORDS][0][:3] if held[RARE_WORDS] else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        if len(rare_keys):
            keys = _word_key(rare_keys)
            order = np.argsort(keys)
            yield batch(1, p=[p], kind=[RARE_WORDS], keys=[_pack(keys[order])], n=[_planes(rare_n[order])])
        for keys, n, b, _, _ in held.pop(HEAD_PAIR):
            u, w = (keys >> _SHIFT).astype(np.int64), (keys & _LOW).astype(np.int64)
            yield from histogram(head.a[u], head.a[w], n, b)
            del u, w
            yield batch(1, p=[p], kind=[HEAD_PAIR], keys=[_pack(keys)], n=[_planes(n)])
            del keys, n, b
        for kind in (RARE_PAIR, TWO_RARE):
            for keys, n, b, rare, other in held.pop(kind):
                at = np.searchsorted(rare_keys, rare)
                own_n, own_a = rare_n[at], rare_n[at] - rare_b[at]
                if kind == TWO_RARE:
                    for start in range(0, len(keys), 100_000):
                        s = slice(start, start + 100_000)
                        size = len(keys[s])
                        yield batch(size, p=np.full(size, p), kind=np.full(size, kind), key=keys[s].view(np.int64), w=other[s].view(np.int64), times=n[s], kept=(n - b)[s], un=own_n[s], ua=own_a[s])
                    continue
                place, first = (other >> _ONE).astype(np.int64), (other & _ONE).astype(bool)
                yield from histogram(np.where(first, own_a, head.a[place]), np.where(first, head.a[place], own_a), n, b)
                nu, nw = np.where(first, own_n, head.n[place]), np.where(first, head.n[place], own_n)
                order = np.argsort(keys)
                yield batch(1, p=[p], kind=[kind], keys=[_pack(keys[order])], **{c: [_planes(x[order])] for c, x in (("n", n), ("nu", nu), ("nw", nw))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, current, sizes, held = known.value, None, {}, {}
        for part in batches:
            for p, kind, keys, other, n, b in zip(*[c.to_pylist() for c in part.columns]):
                if p != current:
                    if current is not None:
                        yield from finished(current, held, head)
                    current, sizes = p, {}
                    held = {kind: [] for kind in (RARE_WORDS, HEAD_PAIR, RARE_PAIR, TWO_RARE)}
                    give_back()
                n, b = (_from_planes(x).astype(np.int64) for x in (n, b))
                rare, other = (_unpack(keys), _from_planes(other)) if other is not None else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                keys = _pair_key(rare, other) if len(rare) else _unpack(keys)
                held[kind].append((keys, n, b, rare, other))
                sizes[kind] = sizes.get(kind, 0) + len(n)
                if sizes[kind] > limit:
                    held[kind] = compact(held[kind])
                    # What is left after adding up is the partition's own size, which is bounded by its tokens.
                    sizes[kind] = -len(held[kind][0][0])
        if current is not None:
            yield from finished(current, held, head)
        held = {}
        give_back()

    return merge


class _Values:
    """What frequent words add to scores, by their number."""

    def __init__(self, model: Model):
        n = model.head.n
        self._rates = np.array(model.weights)
        self._rate = self._rates[bucket(n)]
        self._base = (model.tokens, model.words, model.unigram)
        self._p = self._probability(n)
        self.word = np.log10(self._p)
        self.context = np.log10(1 - self._rate)
        self.base = np.log10(n + 1.0)
        self.rare_word = float(np.log10(model.word_probability(0)))
        self.total = float(np.log10(model.tokens + model.words + 1))
        self._n = n

    def _probability(self, n: np.ndarray) -> np.ndarray:
        return word_probability(n.astype(float), *self._base)

    def gain(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How much a known pair of frequent words adds to the score without it."""
        u, w = (codes >> _SHIFT).astype(np.int64), (codes & _LOW).astype(np.int64)
        return np.log10(1 + self._rate[u] / (1 - self._rate[u]) * (counts / np.maximum(self._n[u], 1)) / self._p[w])

    def rare_gain(self, n: np.ndarray, nu: np.ndarray, nw: np.ndarray) -> np.ndarray:
        """The same for other pairs, from the counts of the pair and its words."""
        rate = self._rates[bucket(nu)]
        return np.log10(1 + rate / (1 - rate) * (n / np.maximum(nu, 1)) / self._probability(nw))

    def rare_words(self, n: np.ndarray) -> np.ndarray:
        """How much a known rare word adds, as a token and as the context of the next one."""
        return np.log10(self._probability(n)) - self.rare_word + np.log10(1 - self._rates[bucket(n)])


def _head_pairs(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs of frequent words in order, with their counts."""

    def steps(batches):
        for b in batches:
            n = np.concatenate([np.zeros(0, np.uint64), *[_from_planes(x) for x in b.column(0).to_pylist()]])
            distinct, times = np.unique(n, return_counts=True)
            yield pa.record_batch([pa.array(distinct.astype(np.int64)), pa.array(times.astype(np.int64))], names=["n", "times"])

    own = model.pairs.where(F.col("kind") == HEAD_PAIR)
    numbers = own.select("n").mapInArrow(steps, "n long, times long")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).cast("int")
    reached, threshold = 0, 1 << 62
    for row in numbers.groupBy(step.alias("step")).agg(F.sum("times").alias("times"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        reached += row["times"]
        if reached > HEAD_PAIRS:
            break
        threshold = row["least"]

    def frequent(batches):
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, counts = _unpack(keys), _from_planes(counts).astype(np.int64)
                kept = counts >= threshold
                yield pa.record_batch([pa.array(keys[kept].view(np.int64)), pa.array(counts[kept])], names=["key", "n"])

    table = own.select("keys", "n").mapInArrow(frequent, "key long, n long").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


def _ask(known, partitions: int):
    """Per block of texts: sums of what is known here, and the keys of all else by partition."""
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def rows_of(shared: tuple, gains: np.ndarray, vocabulary: Vocabulary, block: int, ids: list, numbers: np.ndarray, lengths: np.ndarray) -> list[tuple]:
        head, values, (pairs, _) = shared
        n = len(ids)
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        word, context, before = _numbered(head, vocabulary, numbers, lengths)
        rare = word < 0
        known_token = ~rare
        if not head.n[-1]:
            known_token[np.cumsum(lengths) - 1] = False  # without training texts the end is unknown, too
        score = np.where(rare, values.rare_word, values.word[word]) + np.where(context >= 0, values.context[context], 0.0)
        base = np.where(rare, 0.0, values.base[word]) - values.total
        own = np.stack([lengths, np.bincount(doc, weights=known_token, minlength=n), np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=score, minlength=n)])
        del score, base, known_token
        frequent = ~rare & (context >= 0)
        code, owner = _code(context[frequent], word[frequent]), doc[frequent]
        at = np.minimum(np.searchsorted(pairs, code), max(len(pairs) - 1, 0))
        here = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
        own[3] += np.bincount(owner[here], weights=gains[at[here]], minlength=n)
        (one, first, other), (two, u, w) = _rare_parts(vocabulary, word, context, numbers, before)
        single = vocabulary.keys[numbers[rare]]
        parts = [
            (_partition(code[~here], partitions), code[~here], owner[~here]),
            (_partition(_word_key(single), partitions), _word_key(single), doc[rare]),
            (_partition(_word_key(first), partitions), _pair_key(first, other), doc[one]),
            (_partition(_word_key(u), partitions), _pair_key(u, w), doc[two]),
        ]
        rows = [(p, ASKED, block, _pack(k), d.tobytes(), None, None) for p, k, d in _dealt(*[np.concatenate(x) for x in zip(*parts)])]
        missing = np.array([i is None for i in ids], dtype=np.uint8)
        keys = np.array([0 if i is None else i for i in ids], dtype=np.int64)
        rows.append((block % partitions, OWN, block, keys.tobytes(), missing.tobytes(), own.astype(float).tobytes(), None))
        return rows

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = known.value
        head, values, (pairs, counts) = shared
        gains = values.gain(pairs, counts)
        vocabulary = Vocabulary(head)
        block = TaskContext.get().partitionId() << 32
        for held in _held(batches, vocabulary):
            yield from _rows(rows_of(shared, gains, vocabulary, block, *held), names)
            block += 1
            if len(vocabulary) > WORDS_HELD:
                vocabulary.forget()
        del vocabulary
        give_back()

    return ask


def _pack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pairs of two rare words to arrays by partition."""
    names = [c.split()[0] for c in _PARTS.split(", ")]
    for batch in batches:
        places, keys, n, un, wn = (c.to_numpy() for c in batch.columns)
        parts = _dealt(places, keys.view(np.uint64), n, un, wn)
        yield from _rows([(p, TWO_RARE, None, _pack(k), *map(_planes, counts)) for p, k, *counts in parts], names)


def _answer(known):
    """Partitions in order, in each the model's arrays first: sums per block and text of what was asked for."""
    names = [c.split()[0] for c in _SUMS.split(", ")]

    def learned(values: _Values, kind: int, keys: np.ndarray, x: bytes, y: bytes, z: bytes):
        counts = [_from_planes(c).astype(np.int64, copy=False) for c in (x, y, z) if c is not None]
        gains, known = np.empty(len(keys)), np.zeros(len(keys))
        for start in range(0, len(keys), PAIRS_AT_ONCE):
            s = slice(start, start + PAIRS_AT_ONCE)
            if kind == HEAD_PAIR:
                gains[s] = values.gain(keys[s], counts[0][s])
            elif kind == RARE_WORDS:
                gains[s], known[s] = values.rare_words(counts[0][s]), np.log10(counts[0][s] + 1.0)
            else:
                gains[s] = values.rare_gain(*[c[s] for c in counts])
        return keys, gains, known

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, values, _ = known.value
        current, arrays, table = None, [], None
        for b in batches:
            out = []
            for p, kind, block, keys, x, y, z in zip(*[c.to_pylist() for c in b.columns]):
                if p != current:
                    current, arrays, table = p, [], None
                    give_back()
                if kind == OWN:
                    out.append((block, kind, keys, x, y))
                    continue
                keys = _unpack(keys)
                if kind != ASKED:
                    arrays.append(learned(values, kind, keys, x, y, z))
                    continue
                if table is None:
                    table = _joined(arrays) if arrays else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)]
                    order = np.argsort(table[0])
                    for i in range(len(table)):
                        table[i] = table[i][order]
                    del order
                if not len(table[0]):
                    continue
                at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
                hit = table[0][at] == keys
                docs, places = np.unique(np.frombuffer(x, np.int32)[hit], return_inverse=True)
                at = at[hit]
                sums = [np.bincount(places, weights=v, minlength=len(docs)) for v in (table[2][at] > 0, table[2][at], table[1][at])]
                out.append((block, kind, None, docs.tobytes(), np.stack(sums).tobytes()))
            if out:
                yield from _rows(out, names)
        arrays, table = [], None
        give_back()

    return answer


def _add_up(block: pa.Table) -> pa.Table:
    rows = list(zip(*[block.column(c).to_pylist() for c in ("kind", "keys", "x", "y")]))
    ((_, keys, missing, own),) = [r for r in rows if r[0] == OWN]
    ids, missing = np.frombuffer(keys, np.int64), np.frombuffer(missing, np.uint8).astype(bool)
    own = np.frombuffer(own).reshape(4, -1).copy()
    for kind, _, docs, sums in rows:
        if kind == ASKED:
            docs = np.frombuffer(docs, np.int32)
            own[1:, docs] += np.frombuffer(sums).reshape(3, -1)
    columns = [pa.array(ids, mask=missing), pa.array(own[0].astype(np.int64)), pa.array(np.rint(own[1]).astype(np.int64)), pa.array(own[2]), pa.array(own[3])]
    return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
