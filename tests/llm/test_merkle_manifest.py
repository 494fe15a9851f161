"""The manifest against a plain tree, and its parts on small inputs."""

import hashlib
import zlib

import pytest
from gristmill.llm import merkle_manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, n_chars):
    values = [row.doc_id, row.source, row.lang, n_chars, row.text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root, and per leaf the (left, right) siblings of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            first = i - i % 2
            path.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 2])))
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row.lang, []).append((row.doc_id is not None, row.doc_id or 0, leaf(row, row.n_chars), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {lang: sorted(trees[lang], key=lambda x: x[:3]) for lang in langs}
    subtrees = {lang: plain_tree([x[2] for x in ordered[lang]]) for lang in langs}
    root, above = plain_tree([subtrees[lang][0] for lang in langs])
    out = []
    for lang, upper in zip(langs, above):
        subroot, paths = subtrees[lang]
        for (_, _, own, row), path in zip(ordered[lang], paths):
            now = own
            if row.doc_id is not None and row.n_chars is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0:
                now = leaf(row, row.n_chars + 1)
            for left, right in path + upper:
                now = digest(left + now + right)
            proof = digest("".join(left + right for left, right in path + upper))
            out.append((row.doc_id, own, subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def documents_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def odd_rows():
    langs = ["en", "fr", None, "", "é", "z", "+", "!"]
    rows = [(i, None if i % 5 == 0 else "s", langs[i % 3], None if i % 4 == 0 else i, "é" * (i % 3) if i % 6 else None) for i in range(70)]
    rows += [(None, None, None, None, None), (None, "s", "en", 7, "x"), (3, "twice", "en", 1, "y"), *rows[:4], *[rows[1]] * 9]
    return rows + [(100 + i, "s", lang, 2**63 - 1, "t") for i, lang in enumerate(langs)] + [(7, "s", "solo", 1, "w " * 40_000)]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_equals_plain_tree(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    docs = documents_of(spark, odd_rows()).repartition(4)
    assert found(merkle_manifest.manifest(docs)) == expected(docs.collect())


def test_given_table(documents):
    got = merkle_manifest.manifest(documents)
    assert found(got) == expected(documents.collect())
    assert 0 < got.where("NOT verified").count() < got.count()


def test_one_row_and_none(spark):
    one = documents_of(spark, [(1, "s", "en", 3, "abc")])
    (row,) = merkle_manifest.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == digest("") and row.verified
    assert merkle_manifest.manifest(one.limit(0)).collect() == []


def test_clashing_columns(spark):
    docs = documents_of(spark, odd_rows()[:30])
    more = docs
    for name in ("tree", "node", "own", "at", "place", "copy", "part", "a.b", "members", "path", "_part"):
        more = more.selectExpr("*", f"'x' as `{name}`")
    assert found(merkle_manifest.manifest(more)) == found(merkle_manifest.manifest(docs))
