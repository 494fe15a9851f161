"""Byte-level BPE with the tokenizers library, remembering the ids of frequent words."""

from __future__ import annotations

import os
import re

import numpy as np

from .common import give_back

ID_TYPE = np.dtype("<u4")
# Words of a generation; each process keeps two.
REMEMBERED = 300_000
# Texts without a space before them are remembered if they have fewer characters.
LONG = 64

# A space before a visible character always starts a new pre-token of byte-level BPE.
_WORD_START = re.compile(r" (?=\S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
# Latin letters (of blocks without unassigned places) up to an ASCII mark, white space or the end.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ʯ]+(?=[!-/:-@\[-`{-~\s]|\Z)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself if visible, else the next one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {**{b: chr(b) for b in visible}, **{b: chr(256 + i) for i, b in enumerate(others)}}


_BYTE_LETTERS = _byte_letters()
# A space, and the letters beyond ASCII that _LETTERS knows, as byte-level BPE writes them.
_SPACE = _BYTE_LETTERS[ord(" ")]
_WRITTEN = {c: "".join(_BYTE_LETTERS[b] for b in chr(c).encode()) for c in range(0xC0, 0x2B0)}


class _Memory(dict):
    """Ids of words by word; what is not there is looked up once."""

    def __init__(self, look_up):
        self._look_up = look_up

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._look_up(word)
        return ids


class TextEncoder:
    """Texts to ids, equal to the library's encode(text, add_special_tokens=False).

    Where the tokenizer splits at spaces before it merges, each word is encoded once and
    remembered. Two generations of about `remembered` words bound the memory.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._tokenize = self._library.model.tokenize
        split = repr(self._library.pre_tokenizer)
        added = self._library.get_added_tokens_decoder().values()
        self._by_word = (
            self._library.normalizer is None
            and split.startswith("ByteLevel(")
            and "add_prefix_space=False" in split
            and "use_regex=True" in split
            and type(self._library.model).__name__ == "BPE"
            and not any(" " in t.content or t.lstrip or t.rstrip or t.content[:1].isalpha() for t in added)
        )
        self._remembered = remembered
        self._new, self._old = _Memory(self._word), {}
        self._rests = _Memory(lambda rest: self._encode_all([rest])[0])
        self._id_bytes = [i.to_bytes(ID_TYPE.itemsize, "little") for i in range(self._library.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self._by_word:
            return self._encode_all([text])[0]
        if len(self._new) > self._remembered:
            self._old, self._new = self._new, _Memory(self._word)
        if len(self._rests) > self._remembered // 2:
            self._rests.clear()
        words = _WORD_START.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        # What comes before the first space is split as if it stood alone; it may be long where a text has few spaces.
        first = self._rests[words[0]] if len(words[0]) < LONG else self._encode_all(words[:1])[0]
        del words[0]
        return first + b"".join(map(self._new.__getitem__, words))

    def _word(self, word: str) -> bytes:
        """The ids of a word and the space before it."""
        ids = self._old.get(word)
        if ids is not None:
            return ids
        letters = _LETTERS.match(word)
        if letters is None:
            return self._encode_all([" " + word])[0]
        end = letters.end()
        if end == len(word):
            return self._merge(word)
        # A run of letters ends at an ASCII mark, and what follows is split as if it stood alone.
        return self._new[word[:end]] + self._rests[word[end:]]

    def _merge(self, letters: str) -> bytes:
        """The ids of one pre-token, a space and letters, by the library's model alone."""
        tokens = self._tokenize(_SPACE + (letters if letters.isascii() else letters.translate(_WRITTEN)))
        return b"".join([self._id_bytes[token.id] for token in tokens])

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        encoded = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=ID_TYPE).tobytes() for e in encoded]


_ENCODERS: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """This process's encoder; tasks that run in the same process share what it has learned."""
    give_back()
    key = path, remembered
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]
