"""The quality classifier on held-out labels, and decontamination against plain search."""

import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gristmill.llm import decontaminate, quality_model


def test_grow_and_walk():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(2000, len(quality_model.STATISTICS)))
    labels = ((values[:, 0] > 0) ^ (values[:, 1] > 0.5)).astype(float)
    trees = quality_model.grow(values[:1500], labels[:1500])
    assert ((trees.scores(values[1500:]) > 0.5) == labels[1500:]).mean() > 0.95
    # The arrays say the same as a walk from node to node.
    for row in values[1500:1520]:
        margin = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        assert trees.margins(row[None, :])[0] == pytest.approx(margin)
    again = quality_model.FlatTrees.from_json(trees.to_json())
    assert np.array_equal(again.scores(values), trees.scores(values))


def test_classifier_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality_model.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    unseen = [r for r in scored if r.held_out]
    assert np.mean([r.predicted == r.quality for r in unseen]) > 0.95


def test_classifier_odd_rows(odd_docs, no_docs, spark):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], schema)
    scored = quality_model.classify(odd_docs, labels)
    assert scored.count() == odd_docs.count()
    assert scored.where("score between 0 and 1").count() == odd_docs.count()
    assert quality_model.classify(no_docs, labels).count() == 0
    flat = quality_model.classify(odd_docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in flat] == [pytest.approx(0.5)]


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    stored = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    index = decontaminate.FingerprintIndex(stored)
    asked = []
    for value in stored:
        for flips in (0, 1, 5, decontaminate.RADIUS, decontaminate.RADIUS + 1):
            for bit in rng.choice(64, flips, replace=False):
                value = value ^ (np.uint64(1) << np.uint64(bit))
            asked.append(value)
    asked = np.array(asked, dtype=np.uint64)
    rows, items = index.search(asked)
    distance = np.bitwise_count(asked[:, None] ^ stored[None, :])
    assert set(zip(rows.tolist(), items.tolist())) == set(map(tuple, np.argwhere(distance <= decontaminate.RADIUS).tolist()))


@pytest.mark.parametrize("pass_items", [10_000, 7])
def test_leaks(spark, pass_items):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    texts = items.collect()
    inside = {(d.doc_id, i.item_id) for d in docs.collect() for i in texts if i.text in d.text}
    found = decontaminate.leaks(docs, items, pass_items=pass_items).collect()
    # An item whose first or last word is glued to another is found with less than full similarity.
    assert inside and inside == {(r.doc_id, r.item_id) for r in found}
    assert {(r.doc_id, r.item_id) for r in found if r.similarity == 1} <= inside


def test_leaks_odd_rows(odd_docs, no_docs, spark):
    rows = [(1, "a b c a b c a b c"), (2, None), (3, ""), (None, "same line here same line here same line here"), (4, "one"), (5, "zz " * 9000)]
    items = spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    found = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd_docs, items).collect())
    assert found[(7, 1)] == 3 and found[(6, 4)] == 1 and found[(11, None)] == 1
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.leaks(odd_docs, items.limit(0)).count() == 0
    left = decontaminate.without_leaks(odd_docs, decontaminate.leaks(odd_docs, items))
    assert left.columns == odd_docs.columns and left.where("doc_id = 7").count() == 0


def test_leaks_very_long_item(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    changed = [w if rng.random() > 0.01 else "other" for w in words]
    around = [f"v{rng.randrange(5000)}" for _ in range(8_000)]
    rows = [(1, " ".join(around[:5_000] + words + around[5_000:])), (2, " ".join(changed)), (3, " ".join(words[:20_000])), (4, "x " + " ".join(words[100:140]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words)), (8, " ".join(words[100:140]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in decontaminate.leaks(docs, items).collect()}
    assert set(found) == {(1, 7), (2, 7), (1, 8), (3, 8), (4, 8)} | ({(2, 8)} & set(found))
    assert found[1, 7] == (5_000, 40_000, 1.0) and found[2, 7][:2] == (0, 40_000)


@pytest.mark.parametrize("n", [1, 3, 5, 20, 80])
def test_similarities_of_moving_windows(n):
    rng = random.Random(n)
    words, item = ([b"%d" % rng.randrange(2) for _ in range(k)] for k in (60, n))
    weights = decontaminate.shingle_weights(item)
    last = max(0, len(words) - n)
    expected = [(i, decontaminate.weighted_similarity(decontaminate.shingle_weights(words[i : i + n]), weights)) for i in range(last + 1)]
    assert list(decontaminate._similarities(words, 0, last, n, weights)) == expected
