"""The memory of words: what it saves, and that forgetting changes no ids."""

from gristmill.llm.encoding import TextEncoder, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_200000_words_are_merged_once():
    texts = TextEncoder(PATH)
    calls = 0

    def counted(word, tokenize=texts._tokenize):
        nonlocal calls
        calls += 1
        return tokenize(word)

    texts._tokenize = counted
    pages = [" " + " ".join(letters(i) for i in range(start, start + 1000)) for start in range(0, 200_000, 1000)]
    once = [texts.encode(p) for p in pages]
    assert [texts.encode(p) for p in pages] == once
    assert calls == 200_000


def test_forgotten_words_have_the_same_ids():
    small, library = TextEncoder(PATH, remembered=3), TextEncoder(PATH)._library
    pages = ["a  b word, word. naïve Ünï", "word x\n\ty ʯa ça! 12 don't", "", " ", "À-ÿ ɐbc end ", "word, naïve zz  "] * 3
    for page in pages:
        ids = b"".join(i.to_bytes(4, "little") for i in library.encode(page, add_special_tokens=False).ids)
        assert small.encode(page) == ids


def test_first_words_are_remembered():
    texts, calls = TextEncoder(PATH), []
    encode_all = texts._encode_all
    texts._encode_all = lambda given: calls.append(given) or encode_all(given)
    assert len({texts.encode("Start of it") for _ in range(50)}) == 1
    assert calls == [["Start"]]
    whole = "x" * 100 + " y"
    ids = b"".join(i.to_bytes(4, "little") for i in texts._library.encode(whole, add_special_tokens=False).ids)
    assert texts.encode(whole) == ids and "x" * 100 not in texts._rests
