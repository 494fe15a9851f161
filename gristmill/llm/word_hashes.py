"""64-bit hashes of words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """XXH64 of each word. Hashing a word takes less time than looking it up among remembered ones."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), dtype=">u8").astype(np.uint64)
