"""Manifests against a tree built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest

from cladeflow.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, pos long, hash string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(doc, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def tree(leaves):
    """Levels of a tree."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, i, node):
    """(siblings, root) from a node put in place of leaf i."""
    beside = ""
    for level in levels[:-1]:
        begin = i // 8 * 8
        run = level[begin : begin + 8]
        others = [h for k, h in enumerate(run) if begin + k != i]
        beside += "".join(others)
        run[i - begin] = node
        node, i = sha("".join(run)), i // 8
    return beside, node


def brute(rows):
    series, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc, text, lang, source, n_chars)
        other = leaf_of(doc, text.translate(lower), lang, source, n_chars) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else leaf
        series.setdefault((lang is not None, (lang or "").encode()), []).append((doc is not None, doc or 0, leaf, other, doc))
    names = sorted(series)
    trees = [tree([x[2] for x in sorted(series[s])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (*_, leaf, other, doc) in enumerate(sorted(series[s], key=lambda x: x[:4])):
            one, node = way(trees[k], i, other)
            two, root = way(top, k, node)
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], sha(one + two), root, root == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed, langs=("en", "de", None, "", "éa", "Z")):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Aa É", "plain", "LONG words " * 2000, "x" * rng.randint(1, 20)])
    return [(3 * i - 30, text(), rng.choice(langs), rng.choice(["s", None, "ü:"]), rng.choice([None, 5, -1])) for i in range(n)]


def build(spark, rows):
    return merkle.build(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], DOCS).repartition(3))


@pytest.mark.parametrize(("n", "langs"), [(120, ("en", "de", None, "", "éa", "Z")), (1, ("en",)), (9, ("en",)), (64, (None,)), (100, tuple(f"l{k}" for k in range(70)))])
def test_manifest_of_all_rows(spark, n, langs):
    rows = documents(n, n, langs)
    rows += [rows[0], (None, "A", "en", None, 1), (rows[0][0], "other", rows[0][2], None, None)]
    assert sorted(map(tuple, merkle.verify(build(spark, rows)).collect()), key=str) == brute(rows)


def test_several_blocks_and_appends(spark):
    rows = [(i, f"Text {i}", "en" if i % 10 else "de", "s", i) for i in range(9500)]
    want = brute(rows)
    assert sorted(map(tuple, merkle.verify(build(spark, rows)).collect()), key=str) == want
    grown = build(spark, rows[:5000])
    for a, b in ((5000, 5003), (5003, 9500)):
        grown = merkle.extend(grown, spark.createDataFrame([(*r, 1, 1, "x") for r in rows[a:b]], DOCS))
    assert sorted(map(tuple, merkle.verify(grown).collect()), key=str) == want
    with pytest.raises(ValueError, match="greater"):
        merkle.extend(grown, spark.createDataFrame([(7, "late", "en", "s", 1, 1, 1, "x")], DOCS))


def test_no_documents(spark):
    got = merkle.verify(merkle.build(spark.createDataFrame([], DOCS)))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_witness_grows_with_later_siblings():
    tree_ = merkle.OpenTree()
    for k in range(3):
        tree_.append(str(k))
    assert tree_.siblings[0] == [["1", "2"], ["0", "2"], ["0", "1"]]
