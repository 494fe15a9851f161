import numpy as np
import xxhash

from gristmill.llm.word_hashes import word_hashes


def test_words_are_hashed_without_a_memory():
    words = [b"", b"a", b"word", b"\xc3\xb1", b"a"]
    assert word_hashes(words).tolist() == [xxhash.xxh64_intdigest(w) for w in words]
    assert word_hashes([]).dtype == np.uint64 and len(word_hashes([])) == 0
