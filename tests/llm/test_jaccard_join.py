"""The n-gram join against all pairs of a small table."""

import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from gristmill.llm import common, jaccard_join


def expected(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [brute.shingles(r.text) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(find(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("name", ["documents", "odd_docs", "no_docs"])
def test_equals_all_pairs(name, request):
    docs = request.getfixturevalue(name)
    assert found(jaccard_join.near_duplicates(docs)) == expected(docs.collect())


@pytest.fixture(scope="module")
def groups(spark):
    """Near copies at all distances around the threshold, a large group of them, and a shared passage."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for size in (1, 3, 4, 5, 6, 8, 12, 20, 40, 63, 66, 90, 130, 260, 700):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append(" ".join(text + [rng.choice(vocabulary) for _ in range(rng.randint(0, size // 5))]))
    base = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append(" ".join(text))
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]) for _ in range(60)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)


def test_groups(groups):
    assert found(jaccard_join.near_duplicates(groups)) == expected(groups.collect())


def test_small_blocks_and_groups(groups, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(common, "FEW_IDS", 0)
    assert found(jaccard_join.near_duplicates(groups)) == expected(groups.collect())


def test_too_few_partitions(groups, monkeypatch):
    """With far too few partitions the sets go the exact way without signatures."""
    monkeypatch.setattr(jaccard_join, "partitions", lambda top: None if top <= 64 else 32)
    assert found(jaccard_join.near_duplicates(groups)) == expected(groups.collect())


def test_signature_guarantee():
    """Any two sets at the allowed distance share a signature, whatever the levels are."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 5, 10, 31, 47, 48, 63, 64, 95, 96, 100, 127, 128, 200, 400, 900):
        for _ in range(20):
            common = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            spare = int(len(common) / 3)
            cut = rng.integers(0, spare + 1)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (cut, spare - cut)]
            if not jaccard_join.similar(*sets, 75):
                continue
            signed = [jaccard_join.signatures(s, (s % np.uint64(7)).astype(np.uint8), 75) for s in sets]
            assert np.intersect1d(*signed).size


@pytest.mark.parametrize("block", [jaccard_join.BLOCK, 16])
def test_link_counts_of_large_groups(groups, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = groups.collect()
    sets = [brute.shingles(r.text) for r in rows]
    distinct = set(sets)
    links = {s: sum(s != o and 100 * len(s & o) >= 75 * len(s | o) for o in distinct) for s in distinct}
    got = jaccard_join.near_duplicates(groups, link_counts=True).collect()
    assert max(links.values()) > jaccard_join.SMALL_GROUP
    assert {r.doc_id: r.n_links for r in got} == {r.doc_id: links[s] for r, s in zip(rows, sets)}


def test_colliding_keys(groups):
    def few_bits(elements, seed=0):
        """Keys of which many are the same for different sets."""
        key = jaccard_join.set_key(elements, seed)
        return key if seed else key % 40

    rows = groups.limit(150)
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    assert found(jaccard_join.near_duplicates(rows, key=few_bits)) == expected(rows.collect())


def test_forests_stay_small_and_all_pairs_are_whole():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.sort(rng.permutation(base)[: rng.integers(220, 300)]) for _ in range(60)]
    table = {
        "node": range(60), "label": [i // 2 for i in range(60)], "size": [len(s) for s in sets],
        "sketch": [jaccard_join.sketch(s) for s in sets], "visits": [False] * 60, "largest": [i < 2 for i in range(60)],
    }
    table = jaccard_join.pa.table({k: list(v) for k, v in table.items()})
    few, every = (jaccard_join._possible_pairs(75, forest)(table).to_pydict() for forest in (True, False))
    pairs = set(zip(every["a"], every["b"]))
    wanted = {(i, j) for i in range(60) for j in range(i + 1, 60) if i // 2 != j // 2 and jaccard_join.similar(sets[i], sets[j], 75)}
    assert wanted and wanted <= pairs and 0 < len(few["a"]) < 30 < len(pairs)
    assert set(zip(few["a"], few["b"])) <= pairs
