"""Benchmark decontamination: SimHash over item-sized windows, then an exact comparison.

Every document is covered with windows of the sizes that benchmark items have. A window and an item
of that size are candidates when their 64-bit fingerprints differ in at most RADIUS bits. These are
found by four blocks of 16 bits: two fingerprints within the radius differ in at most
RADIUS // 4 bits in some block, and the index holds every item under all values of a block within that
distance. Candidates are kept if their weighted shingle similarity (each shingle weighs as often
as it occurs: sum of minima over sum of maxima) reaches the threshold at some offset of the window.

Benchmark items are the stated query set: they go to all tasks in blocks of a bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import col, named, require_columns

from .common import bounded, keyed_texts, small_batches
from .word_hashes import mixed, word_hashes

THRESHOLD = 0.75
SHINGLE_WORDS = 5
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
# Window sizes grow by this factor; an item uses the size nearest to its own.
SIZE_STEP = 1.1
# Windows of size s start every s // STRIDE_SHARE words, and at both ends of a document.
STRIDE_SHARE = 12
# Items and bytes of item texts that one pass over the documents looks for.
PASS_ITEMS, PASS_BYTES = 10_000, 64 << 20
# Words that are fingerprinted at once.
CHUNK_WORDS = 1 << 15

_FOUND = "doc_id long, item_id long, start_word long, n_words long, similarity double"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def window_sizes(longest: int) -> list[int]:
    """1, 2, ... and from 10 on growing by SIZE_STEP, up to beyond the longest item."""
    sizes = [1]
    while sizes[-1] < longest:
        sizes.append(max(sizes[-1] + 1, round(sizes[-1] * SIZE_STEP)))
    return sizes


def pair_bits(hashes: np.ndarray) -> np.ndarray:
    """Bits of the hashes of word pairs; the feature at i is of words i and i + 1."""
    pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    return np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)


def sum_kind(size: int):
    """The smallest type whose running sums are right for windows of that many words."""
    return np.uint8 if size <= 255 else np.uint16 if size < 1 << 15 else np.uint32


def sums_of(bits: np.ndarray, kind) -> np.ndarray:
    """Running sums over features, with a first row of zeros.

    They wrap; differences are right where a window has fewer features than `kind` has values.
    """
    sums = np.zeros((len(bits) + 1, 64), dtype=kind)
    np.cumsum(bits, axis=0, dtype=kind, out=sums[1:])
    return sums


def fingerprints(counts: np.ndarray, features) -> np.ndarray:
    """Majority bits of whole counts over that many features, as 64-bit numbers."""
    half = np.asarray(features // 2).astype(counts.dtype)
    return np.packbits(counts > half, axis=1).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray) -> int:
    """Of a whole sequence of word hashes; one word counts as a pair with itself."""
    if len(hashes) == 1:
        hashes = np.repeat(hashes, 2)
    bits = pair_bits(hashes)
    return int(fingerprints(bits.sum(axis=0, dtype=np.int64)[None, :], np.int64(len(bits)))[0])


class FingerprintIndex:
    """Multi-index Hamming search: all stored fingerprints within RADIUS of those asked for."""

    def __init__(self, stored: np.ndarray):
        self._stored = stored
        near = [0]
        for bits in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in chosen) for chosen in combinations(range(BLOCK_BITS), bits)]
        near = np.array(near, dtype=np.uint64)
        self._tables = []
        for block in range(BLOCKS):
            values = (self._block(stored, block)[:, None] ^ near[None, :]).ravel().astype(np.intp)
            owners = np.repeat(np.arange(len(stored)), len(near))[np.argsort(values, kind="stable")]
            counts = np.bincount(values, minlength=1 << BLOCK_BITS)
            self._tables.append((counts > 0, np.concatenate([[0], np.cumsum(counts)]), owners))

    @staticmethod
    def _block(values: np.ndarray, block: int) -> np.ndarray:
        return (values >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)

    def search(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `asked` and in the stored fingerprints of all pairs within the radius."""
        found = []
        # Little-endian, like _block.
        blocks = np.ascontiguousarray(asked.view(np.uint16).reshape(-1, BLOCKS).T)
        for block, (used, offsets, owners) in enumerate(self._tables):
            who = np.flatnonzero(used[blocks[block]])
            at = blocks[block][who].astype(np.intp)
            counts = offsets[at + 1] - offsets[at]
            total = int(counts.sum())
            inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = np.repeat(who, counts)
            items = owners[np.repeat(offsets[at], counts) + inside]
            close = np.bitwise_count(asked[rows] ^ self._stored[items]) <= RADIUS
            found.append(np.stack([rows[close], items[close]], axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        return found[:, 0], found[:, 1]


def shingle_weights(words: list[bytes]) -> Counter:
    if not words:
        return Counter()
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    return Counter(tuple(words[i : i + SHINGLE_WORDS]) for i in range(n))


def weighted_similarity(a: Counter, b: Counter) -> float:
    small = a if len(a) < len(b) else b
    both = sum(min(a[s], b[s]) for s in small)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class ItemIndex:
    """One block of benchmark items, by window size."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, w in ((i, words_of(t or "")) for i, t in items) if w]
        self.weights = [shingle_weights(w) for _, w in self.items]
        sizes = np.array(window_sizes(max((len(w) for _, w in self.items), default=1)))
        by_size: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            nearest = int(sizes[np.abs(np.log(sizes / len(w))).argmin()])
            by_size.setdefault(nearest, []).append(k)
        self.sizes = {
            size: (np.array(own), FingerprintIndex(np.array([fingerprint(word_hashes(self.items[k][1])) for k in own], dtype=np.uint64)))
            for size, own in sorted(by_size.items())
        }
        self.longest = max(self.sizes, default=0)


def leaks(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, pass_items: int = PASS_ITEMS
) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity of items found in documents.

    items has item_id and text. One row per document row and item, for the most similar place (the first of
    several). Missing or empty texts hold nothing, items without words are found nowhere, repeated
    items are reported each under its id, repeated document rows are reported each. Other columns are left out.
    """
    require_columns(items, "item_id", "text")
    queries = items.select(col("item_id").cast("long").alias("item_id"), F.coalesce(col("text"), F.lit("")).alias("text"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // pass_items), -(-size["bytes"] // PASS_BYTES))
    found, texts = None, keyed_texts(docs)
    for number in range(passes):
        block = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        index = texts.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in block]))
        part = texts.mapInArrow(_finder(index, threshold), _FOUND)
        found = part if found is None else found.union(part)
    return found


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents (all columns) in which nothing was found; rows without doc_id stay."""
    ids = bounded(found.select("doc_id").distinct(), "leaking")
    return docs.join(ids, "doc_id", "left_anti").select(*named(docs.columns))


def _finder(shared, threshold: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        rows, chunk, size = [], [], 0
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words or not index.sizes:
                    continue
                best: dict[int, tuple] = {}
                # Long texts go in pieces that overlap by the longest window.
                for start in range(0, max(1, len(words) - index.longest), CHUNK_WORDS):
                    piece = (start, words[start : start + CHUNK_WORDS + index.longest])
                    chunk.append((doc_id, words, best, *piece))
                    size += len(piece[1])
                    if size >= CHUNK_WORDS:
                        _search(index, chunk, threshold)
                        rows += _done(chunk, (doc_id, words, best) if start + CHUNK_WORDS < len(words) - index.longest else None)
                        chunk, size = [], 0
            if rows:
                yield _batch(rows)
                rows = []
        if chunk:
            _search(index, chunk, threshold)
            if rows := _done(chunk, None):
                yield _batch(rows)

    return find


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.float64()]
    names = ["doc_id", "item_id", "start_word", "n_words", "similarity"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _done(chunk, unfinished) -> list[tuple]:
    """Rows of the documents that end in this chunk."""
    rows, seen = [], set()
    for doc_id, _, best, *_ in chunk:
        if id(best) in seen or (unfinished is not None and best is unfinished[2]):
            continue
        seen.add(id(best))
        rows += [(doc_id, item, start, n, similarity) for item, (similarity, start, n) in sorted(best.items())]
    return rows


def _search(index: ItemIndex, chunk, threshold: float) -> None:
    """Fingerprint the windows of all pieces at once and verify the candidates."""
    lengths = np.array([len(p[4]) for p in chunk])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    hashes = word_hashes([w for p in chunk for w in p[4]])
    # The last word has no successor; the feature at a piece's end is never inside a window.
    bits = pair_bits(np.append(hashes, hashes[-1:]))
    kinds = {size: sum_kind(size) for size in index.sizes}
    sums_by_kind = {kind: sums_of(bits, kind) for kind in set(kinds.values())}
    piece_of = np.repeat(np.arange(len(chunk)), lengths)
    total = len(hashes)
    for size, (own, fingerprint_index) in index.sizes.items():
        features = max(1, size - 1)
        stride = max(1, size // STRIDE_SHARE)
        long = np.flatnonzero(lengths >= size)
        sums = sums_by_kind[kinds[size]]
        # Windows on a grid over all pieces; those that reach over the end of a piece are passed over.
        grid = np.arange(0, max(0, total - size + 1), stride)
        across = piece_of[grid] != piece_of[grid + size - 1]
        counts = sums[features : features + len(grid) * stride : stride] - sums[: len(grid) * stride : stride][: len(grid)]
        grid_prints = fingerprints(counts, features)[~across]
        # Both ends of a piece; one that is shorter than the window is a window as a whole.
        short = np.flatnonzero((lengths < size) & (lengths * 2 >= size))
        edges = np.concatenate([begins[long], begins[long + 1] - size, begins[short]]).astype(np.intp)
        count = np.concatenate([np.full(2 * len(long), features), np.maximum(1, lengths[short] - 1)]).astype(np.intp)
        edge_prints = fingerprints(sums[edges + count] - sums[edges], count[:, None])
        first = np.concatenate([grid[~across], edges])
        if not len(first):
            continue
        prints = np.concatenate([grid_prints, edge_prints])
        if size == 1:
            # A lone word is paired with itself, as in `fingerprint`.
            first, prints = np.arange(total), mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + hashes)
        windows, items = fingerprint_index.search(prints)
        for window, item in zip(windows.tolist(), own[items].tolist()):
            _verify(index, chunk[piece_of[first[window]]], int(first[window] - begins[piece_of[first[window]]]), size, stride, item, threshold)


def _verify(index: ItemIndex, piece, at: int, size: int, stride: int, item: int, threshold: float) -> None:
    _, words, best, offset, _ = piece
    item_id, item_words = index.items[item]
    n = len(item_words)
    reach = stride + abs(n - size)
    at += offset
    known = best.get(item_id)
    last = max(0, min(at + reach, len(words) - n))
    for start, similarity in _similarities(words, max(0, at - reach), last, n, index.weights[item]):
        if similarity >= threshold and (known is None or (-similarity, start) < (-known[0], known[1])):
            known = best[item_id] = (similarity, start, min(n, len(words) - start))


def _similarities(words: list[bytes], first: int, last: int, n: int, weights: Counter) -> Iterator[tuple[int, float]]:
    """Start and weighted similarity of the windows of n words from first to last; each differs by two shingles from the one before."""
    if first > last:
        return
    own = shingle_weights(words[first : first + n])
    both = sum(min(k, weights[s]) for s, k in own.items())
    total = sum(own.values()) + sum(weights.values())
    yield first, both / (total - both)
    width = min(SHINGLE_WORDS, n)
    for start in range(first + 1, last + 1):
        gone, new = tuple(words[start - 1 : start - 1 + width]), tuple(words[start + n - width : start + n])
        both -= own[gone] <= weights[gone]
        own[gone] -= 1
        own[new] += 1
        both += own[new] <= weights[new]
        yield start, both / (total - both)
