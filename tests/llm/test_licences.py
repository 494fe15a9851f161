"""Licence scans against all runs of lines."""

import random
from collections import Counter

import pytest
from gristmill.llm import licence_scan
from gristmill.llm.licence_texts import NOTICES, TEXTS


def brute(text, templates, threshold):
    lines, matches = [licence_scan.normalised(x) for x in (text or "").split("\n")], []
    for first in range(len(lines)):
        for last in range(first, len(lines)):
            run = licence_scan.bigrams([w for x in lines[first : last + 1] for w in x])
            for name, template in templates:
                value = licence_scan.dice(run, licence_scan.bigrams(licence_scan.normalised(template)))
                if value >= threshold:
                    matches.append((-value, last - first + 1, first, name))
    return {(name, round(value, 9)) for name, value, *_ in licence_scan.best_runs(matches)}


def test_dice():
    grams = licence_scan.bigrams
    assert licence_scan.dice(grams(["a", "b", "c"]), grams(["a", "b", "d"])) == pytest.approx(0.5)
    assert licence_scan.dice(grams([]), grams([])) == 0


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_runs_of_lines(threshold):
    rng, templates = random.Random(2), NOTICES + TEXTS
    finder = licence_scan.Templates(templates, threshold)
    for _, text in templates:
        words = text.split()
        for _ in range(3):
            own = [w for w in words if rng.random() > 0.05]
            cuts = sorted(rng.sample(range(len(own)), min(3, len(own))))
            lines = [" ".join(own[a:b]) for a, b in zip([0, *cuts], [*cuts, len(own)])]
            doc = "\n".join(["Some prose before it.", *lines, "", "and more of the prose"])
            found = {(name, round(value, 9)) for name, value, *_ in finder.find(doc)}
            assert found == brute(doc, templates, threshold)


def test_documents(documents):
    found = licence_scan.scan_licences(documents)
    expected = Counter()
    for r in documents.where("n_chars < 3000").collect():
        for name, value in brute(r.text, NOTICES, 0.85):
            expected[(r.doc_id, name)] += 1
    got = Counter((r.doc_id, r.licence) for r in found.join(documents.where("n_chars < 3000").select("doc_id"), "doc_id").collect())
    assert expected and got == expected


def test_odd_rows(odd_docs, no_docs):
    assert licence_scan.scan_licences(odd_docs).count() == 0
    templates = [("one", "one"), ("lines", "same line here same line here same line here")]
    found = licence_scan.scan_licences(odd_docs, templates).collect()
    assert {(r.doc_id, r.licence) for r in found} >= {(6, "one"), (11, "lines")}
    assert licence_scan.scan_licences(no_docs).count() == 0
    assert licence_scan.scan_licences(odd_docs, []).count() == 0


def test_inside_long_lines():
    finder = licence_scan.Templates(NOTICES + TEXTS, 0.85)
    prose = " ".join(f"word{i}" for i in range(400))
    for name, text in NOTICES + TEXTS:
        for line in (f"{prose} {text} {prose}", f"{text} {prose}", f"{prose} {text}", f"Short prose. {text}"):
            found = {f[0]: f[1:] for f in finder.find(f"first\n{line}\nlast")}
            # The whole line may be near enough to be found as a run of lines, words before it and all.
            assert name in found and (found[name] == (1.0, 1, 1) or line.startswith("Short")), (name, line)


def test_gnu_headers_get_their_own_names():
    finder = licence_scan.Templates(NOTICES + TEXTS, 0.85)
    for name, text in TEXTS:
        assert finder.find(text)[0][:2] == (name, 1.0)
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"} <= {name for name, _ in TEXTS}
