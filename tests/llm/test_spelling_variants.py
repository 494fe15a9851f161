"""Spelling variants against plain dictionaries, and the index against comparing all pairs."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from gristmill.llm import common, spelling_variants
from gristmill.llm.fm_index import BidirectionalIndex

LOWER = {i: i + 32 for i in range(65, 91)}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, min_length=5, min_count=3):
    counts = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if row.doc_id is None else row.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    shorter = {}
    for w in words:
        for i in range(len(w)):
            shorter.setdefault(w[:i] + w[i + 1 :], set()).add((w, i))
    near = {w: set() for w in words}
    for rest, holders in shorter.items():
        for w, i in holders:
            near[w] |= {v for v, j in holders if v != w and i == j} | ({rest} & words.keys())
            if rest in words:
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("name", ["documents", "odd_docs", "no_docs"])
def test_equals_plain_version(name, request):
    docs = request.getfixturevalue(name)
    assert found(spelling_variants.spelling_variants(docs)) == expected(docs.collect())


def typing_errors(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcé")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :], word[:at] + letter + word[at:]])


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "z" * 3000, "z" * 2999]
    words = [w for w in base for _ in range(rng.choice((3, 7, 40)))]
    words += [typing_errors(rng, w) for w in words] + [typing_errors(rng, typing_errors(rng, w)) for w in words[::3]]
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[1]), (0, texts[1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_variants(misspelt):
    assert found(spelling_variants.spelling_variants(misspelt)) == expected(misspelt.collect())


def test_small_shards_and_hot_keys(misspelt, monkeypatch):
    monkeypatch.setattr(spelling_variants, "SHARD_WORDS", 40)
    monkeypatch.setattr(spelling_variants, "HOT_WORDS", 3)
    monkeypatch.setattr(common, "FEW_IDS", 0)
    monkeypatch.setattr(spelling_variants, "HELD", 10)
    assert found(spelling_variants.spelling_variants(misspelt)) == expected(misspelt.collect())


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_index_finds_all_pairs(letters):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(400)})
    index = BidirectionalIndex([w.encode() for w in words])
    pairs = set()
    for exact_first in (True, False):
        asked, places = index.one_error([w.encode() for w in words], exact_first)
        pairs |= {(words[a], words[p]) for a, p in zip(asked, places)}
    assert pairs == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_index_of_one_word():
    index = BidirectionalIndex([b"abcde"])
    hits = [[len(index.one_error([q], first)[0]) for first in (True, False)] for q in (b"abcde", b"abxde", b"xbcde", b"abcd", b"zzzzz")]
    assert hits[0] == [0, 0] and hits[1][0] and hits[2][1] and hits[3][0] and hits[4] == [0, 0]


def test_shards_are_searched_in_a_fresh_process():
    """A worker that gets its first rows from Spark has not loaded pyarrow.compute, unless the module asks for it."""
    group = pa.table({"word": ["house", "horse"], "indexed": [True, False], "start": [True, True]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, group.schema) as stream:
        stream.write_table(group)
    code = (
        "import sys, pyarrow as pa\n"
        "from gristmill.llm.spelling_variants import _search_shard\n"
        "group = pa.ipc.open_stream(sys.stdin.buffer.read()).read_all()\n"
        "print(_search_shard(group).to_pylist())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], input=sink.getvalue().to_pybytes(), capture_output=True, timeout=60)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == "[{'word': 'horse', 'near': 'house'}]"
