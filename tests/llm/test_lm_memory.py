"""Tasks of the language model hold no array twice for longer than they need it."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from gristmill.llm import lm_scoring


def rare_pairs(parts, size):
    """Rows of one partition: its rare words, then pairs of two of them, in as many parts."""
    rng = np.random.default_rng(5)
    words = np.unique(rng.integers(1, 1 << 62, size, dtype=np.uint64))
    ones = lm_scoring._planes(np.ones(len(words), np.int64))
    rows = [(0, lm_scoring.RARE_WORDS, lm_scoring._pack(words), None, ones, ones)]
    for _ in range(parts):
        other = lm_scoring._planes(rng.integers(1, 1 << 62, len(words), dtype=np.uint64))
        rows.append((0, lm_scoring.TWO_RARE, lm_scoring._pack(words), other, ones, ones))
    names = [c.split()[0] for c in lm_scoring._COUNTED.split(", ")]
    return list(lm_scoring._rows(rows, names))


def test_merging_needs_little_more_than_the_parts():
    parts, size = 8, 50_000
    head = lm_scoring.Head(np.zeros(0, np.uint64), np.zeros(2, np.int64), np.zeros(2, np.int64))
    given = rare_pairs(parts, size)
    merge = lm_scoring._merge_pairs(SimpleNamespace(value=head), (1, 1, 0.5))
    tracemalloc.start()
    try:
        merged = sum(b.num_rows for b in merge(iter(given)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert merged == parts * size + 1
    # A pair is five numbers; beside the parts there may be one array more at a time, its order and the sums.
    assert peak < 3.2 * parts * size * 5 * 8


def test_parts_are_joined_without_a_second_copy():
    parts = [(np.arange(3) + i, np.full(3, i)) for i in range(2)]
    assert [a.tolist() for a in lm_scoring._joined(parts)] == [[0, 1, 2, 1, 2, 3], [0, 0, 0, 1, 1, 1]]
    assert parts == []
