"""A bidirectional FM-index over a delimited list of words, for many patterns at a time.

The words stand in one cyclic text, each after a delimiter. A pattern is an interval of the sorted
suffixes of the text and one of the reversed text, of the same width; it grows by a symbol to the left
by ranks in the first index, to the right by ranks in the second, and both intervals stay in step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

DELIMITER = b"\0"


class SuffixRanks:
    """Sorted rotations of a cyclic text, and ranks of its symbols in the order of these rotations."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = _sorted_rotations(text)
        self.before = text[self.order - 1]
        n = len(text)
        cells = n // 64 + 1
        padded = np.full(cells * 64, symbols + 1, dtype=np.int16)
        padded[:n] = self.before
        # Row c: where the symbol is less than c, as bits, with the number of such places before each cell.
        self._bits = np.zeros((symbols + 2, cells), dtype=np.uint64)
        for c in range(1, symbols + 2):
            self._bits[c] = np.packbits(padded < c, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self._bits).astype(np.int64)
        self._counts = np.cumsum(counts, axis=1) - counts
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])

    def less(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the first `row` rotations follow a symbol less than the given one."""
        cell = row >> 6
        mask = (np.uint64(1) << (row & 63).astype(np.uint64)) - np.uint64(1)
        return self._counts[symbol, cell] + np.bitwise_count(self._bits[symbol, cell] & mask)


def extend(grow: SuffixRanks, low: np.ndarray, other: np.ndarray, width: np.ndarray, symbol: np.ndarray):
    """Intervals after a symbol is put to that end of the patterns which `grow` is the index of."""
    first, last = grow.less(symbol, low), grow.less(symbol, low + width)
    to_first, to_last = grow.less(symbol + 1, low), grow.less(symbol + 1, low + width)
    return grow.starts[symbol] + to_first - first, other + last - first, (to_last - to_first) - (last - first)


class BidirectionalIndex:
    def __init__(self, words: Sequence[bytes]):
        raw = np.frombuffer(DELIMITER + DELIMITER.join(words), dtype=np.uint8)
        known, text = np.unique(raw, return_inverse=True)
        text = text.astype(np.int16)
        self.symbols = len(known)
        # Symbols that no word has get the code after the last one, which occurs nowhere.
        self._code = np.full(256, self.symbols, dtype=np.int16)
        self._code[known] = np.arange(self.symbols)
        self.left, self.right = SuffixRanks(text, self.symbols), SuffixRanks(text[::-1], self.symbols)
        self.size = len(text)
        self._word_at = np.cumsum(raw == 0) - 1

    def one_error(self, patterns: Sequence[bytes], exact_first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (pattern number, word number) of words with one error against a pattern.

        The error is in the second half of the pattern if `exact_first`, else in the first. The exact half
        is matched from the middle of the pattern outwards, up to the delimiter, then the other half from
        the middle to the other delimiter, where one symbol may be replaced, inserted or left out.
        """
        cut = [len(p) // 2 for p in patterns]
        first = [p[:h][::-1] + DELIMITER for p, h in zip(patterns, cut)]
        second = [p[h:] + DELIMITER for p, h in zip(patterns, cut)]
        if exact_first:
            query, _, low, _ = self._search(first, second, self.left, self.right)
        else:
            query, low, _, _ = self._search(second, first, self.right, self.left)
        return query, self._word_at[self.left.order[low]]

    def _ragged(self, parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        return self._code[np.frombuffer(b"".join(parts), dtype=np.uint8)], np.cumsum(lengths) - lengths, lengths

    def _search(self, exact, other, outward: SuffixRanks, onward: SuffixRanks):
        """Query, low in `onward`, low in `outward` and width of all matches with one error in `other`."""
        flat, starts, lengths = self._ragged(exact)
        n = len(exact)
        query = np.arange(n)
        out_low, on_low, width = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            at = np.flatnonzero((lengths[query] > step) & (width > 0))
            out_low[at], on_low[at], width[at] = extend(outward, out_low[at], on_low[at], width[at], flat[starts[query[at]] + step])
            alive = width > 0
            query, out_low, on_low, width = query[alive], out_low[alive], on_low[alive], width[alive]

        flat, starts, lengths = self._ragged(other)
        lengths = lengths - 1  # without the delimiter
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        right, wrong, found, step = (query, on_low, out_low, width), none, [], 0
        while len(right[0]) or len(wrong[0]):
            query, on_low, out_low, width = right
            within = lengths[query] > step
            wanted = flat[starts[query] + step].astype(np.int64)
            state, symbol = self._branches(onward, right)
            # Another symbol than the wanted one: in its place, or before it; at the end any symbol is one more.
            differs = (symbol != wanted[state]) & (symbol > 0)
            state, symbol = state[differs], symbol[differs]
            low, far, wide = extend(onward, on_low[state], out_low[state], width[state], symbol)
            grown = (query[state], low, far, wide)
            replaced = tuple(x[within[state]] for x in grown)
            skipped = tuple(x[within] for x in right)
            # States with an error go on with the wanted symbol, at the end with the delimiter.
            wrong = tuple(np.concatenate(x) for x in zip(wrong, grown))
            ends = lengths[wrong[0]] == step
            wrong = self._wanted(onward, wrong, flat, starts, step)
            alive = wrong[3] > 0
            found.append(tuple(x[ends & alive] for x in wrong))
            wrong = tuple(np.concatenate(x) for x in zip((y[~ends & alive] for y in wrong), replaced, skipped))
            right = self._wanted(onward, skipped, flat, starts, step)
            right = tuple(x[right[3] > 0] for x in right)
            step += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none

    @staticmethod
    def _wanted(onward, states, flat, starts, step):
        query, low, far, width = states
        return (query, *extend(onward, low, far, width, flat[starts[query] + step].astype(np.int64)))

    def _branches(self, onward: SuffixRanks, states) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (state, symbol) with every symbol that can come next: read off narrow intervals, all tried for wide ones."""
        _, low, _, width = states
        narrow, wide = np.flatnonzero(width <= self.symbols), np.flatnonzero(width > self.symbols)
        sizes = width[narrow]
        state = np.repeat(narrow, sizes)
        row = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[state]
        seen = np.unique(state * np.int64(self.symbols) + onward.before[row])
        every = np.repeat(wide * np.int64(self.symbols), self.symbols) + np.tile(np.arange(self.symbols), len(wide))
        both = np.concatenate([seen, every])
        return both // self.symbols, both % self.symbols


def _sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Start places of the rotations of a cyclic text in order, by doubling the compared length."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    length = 1
    while length < n and rank.max() < n - 1:
        _, rank = np.unique(rank.astype(np.int64) * n + np.roll(rank, -length), return_inverse=True)
        length *= 2
    return np.argsort(rank, kind="stable")
