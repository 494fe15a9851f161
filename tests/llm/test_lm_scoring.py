"""Language-model scores against plain dictionaries."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from gristmill.llm import lm_scoring


def tokens(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*brute.words(lowered), None]


def checksum(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def is_held_out(doc_id):
    return doc_id is not None and checksum(doc_id) % 7 == 2


class Plain:
    """Counts of all training texts, of those that teach the counts, and of those that teach the weights."""

    def __init__(self, rows):
        parts = {"all": rows, "aside": [r for r in rows if r.doc_id is not None and checksum(r.doc_id) // 7 % 8 == 0]}
        self.words, self.pairs = {}, {}
        for name, own in parts.items():
            self.words[name], self.pairs[name] = Counter(), Counter()
            for r in own:
                t = tokens(r.text)
                self.words[name].update(t)
                self.pairs[name].update(zip(["\n", *t[:-1]], t))
        self.words["kept"] = self.words["all"] - self.words["aside"]
        self.pairs["kept"] = self.pairs["all"] - self.pairs["aside"]
        self.n, self.v = sum(self.words["all"].values()), len(self.words["all"])

    def context(self, part, u):
        return self.words[part][None] if u == "\n" else self.words[part][u]

    def word(self, part, w, weight):
        total = sum(self.words[part].values())
        return weight * self.words[part][w] / max(total, 1) + (1 - weight) / (self.v + 1)

    def learned(self):
        """Weights by expectation-maximisation over every single event."""
        total = sum(self.words["kept"].values())
        events = [(k, self.words["kept"][w] / total * (self.v + 1)) for w, k in self.words["aside"].items()]
        unigram = maximise(events)
        levels = {}
        for (u, w), k in self.pairs["aside"].items():
            c = self.context("kept", u)
            if c:
                ratio = self.pairs["kept"][u, w] / c / self.word("kept", w, unigram)
                levels.setdefault(c.bit_length(), []).append((k, ratio))
        return unigram, {b: maximise(e) for b, e in levels.items()}

    def score(self, text, unigram, weights):
        t, total = tokens(text), 0.0
        for u, w in zip(["\n", *t[:-1]], t):
            c = self.context("all", u)
            rate = weights[c.bit_length()] if c else 0.0
            p = rate * self.pairs["all"][u, w] / c if c else 0.0
            total += math.log10(p + (1 - rate) * self.word("all", w, unigram))
        return total


def maximise(events):
    k, x = (np.array(c, dtype=float) for c in zip(*events))
    rate = 0.5
    for _ in range(3000):
        rate = min(max((k * rate * x / (rate * x + 1 - rate)).sum() / k.sum(), 1e-6), 1 - 1e-6)
    return rate


def check(docs):
    rows = docs.collect()
    plain = Plain([r for r in rows if not is_held_out(r.doc_id)])
    model = lm_scoring.learn(docs.where(~lm_scoring.held_out(docs["doc_id"])))
    assert (model.tokens, model.words) == (plain.n, plain.v)
    got = lm_scoring.lm_scores(docs).collect()
    want = []
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((plain.words["all"][w] + 1) / (plain.n + plain.v + 1)) for w in t)
        known = sum(w in plain.words["all"] for w in t)
        want.append((str(r.doc_id), is_held_out(r.doc_id), len(t), known, plain.n, base, plain.score(r.text, model.unigram, model.weights)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    want = sorted((*w[:5], round(w[5], 6), round(w[6], 6)) for w in want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=2e-6)
    return plain, model


@pytest.mark.parametrize("name", ["documents", "odd_docs", "no_docs"])
def test_equals_plain_version(name, request):
    check(request.getfixturevalue(name))


def test_rare_words_and_pairs(documents, monkeypatch):
    """Most words and nearly all pairs go the way of rare ones, in many blocks."""
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 50)
    monkeypatch.setattr(lm_scoring, "HEAD_PAIRS", 10)
    monkeypatch.setattr(lm_scoring, "HELD", 2000)
    monkeypatch.setattr(lm_scoring, "WORDS_HELD", 500)
    check(documents)


def test_weights(documents):
    plain, model = check(documents)
    unigram, weights = plain.learned()
    assert abs(model.unigram - unigram) < 2e-3
    assert all(abs(model.weights[b] - rate) < 5e-3 for b, rate in weights.items())


def test_better_than_base(documents):
    rows = lm_scoring.lm_scores(documents).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_packing_is_exact():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (lm_scoring._unpack(lm_scoring._pack(keys)) == keys).all()
    assert (lm_scoring._from_planes(lm_scoring._planes(keys)) == keys).all()
    assert len(lm_scoring._unpack(lm_scoring._pack(keys[:0]))) == 0


def test_tasks_hand_back_packed_arrays_in_small_batches():
    """A batch is held by Python and Spark at once, so many partitions' arrays must not be one batch."""
    part = lm_scoring.BATCH_BYTES // 4 + 1
    rows = [(i, lm_scoring.ASKED, i, bytes([i]) * part, None, None, None) for i in range(21)]
    names = [c.split()[0] for c in lm_scoring._PARTS.split(", ")]
    batches = list(lm_scoring._rows(rows, names))
    assert max(b.num_rows for b in batches) == 4
    assert [tuple(r[n] for n in names) for b in batches for r in b.to_pylist()] == rows
    assert not list(lm_scoring._rows([], names))
