"""The n-gram model against dictionaries of all counts, and Elias-Fano sequences against plain ones."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cladeflow.llm import langmodel as L
from cladeflow.llm.elias_fano import Monotone

DOCS = "doc_id long, text string, node long, count long"
BEGIN, END = b"  ", b" "


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 0), (1, 10**15), (1000, 10), (1000, 10**6), (5000, 1 << 45), (700, 700)])
def test_monotone_sequences(n, top):
    rng = np.random.default_rng(n + top)
    values = np.sort(rng.integers(0, top + 1, n))
    m = Monotone(memoryview(b"12345678" + Monotone.dump(values)), 8)
    assert m.n == n and (m.get(np.arange(n)) == values).all()
    asked = np.r_[0, values, values + 1, rng.integers(0, 2 * top + 2, 500), np.maximum(values - 1, 0)]
    assert (m.successor(asked) == np.searchsorted(values, asked)).all()
    assert m.end == 8 + len(Monotone.dump(values))


def tokens(text):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return [*(w.translate(lower) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())), END]


def brute(rows):
    held = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
    count = Counter()
    for doc, text in rows:
        if not held(doc):
            t = [BEGIN, *tokens(text)]
            count[BEGIN,] += 1
            for i in range(1, len(t)):
                for k in range(1, min(L.ORDER, i + 1) + 1):
                    count[tuple(t[i - k + 1 : i + 1])] += 1
    words = [g for g in count if len(g) == 1 and g != (BEGIN,)]
    n, v = sum(count[g] for g in words), len(words)
    out = []
    for doc, text in rows:
        t = [BEGIN, *tokens(text)]
        base = score = 0.0
        for i in range(1, len(t)):
            p = (count[t[i],] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, min(L.ORDER, i + 1) + 1):
                gram, context = count[tuple(t[i - k + 1 : i + 1])], count[tuple(t[i - k + 1 : i])]
                share = 10 ** (-math.ceil(-math.log10(gram / (context + L.MASS[k])) * L.STEPS - 1e-9) / L.STEPS) if gram else 0
                p = share + L.MASS[k] / (context + L.MASS[k]) * p
            score += math.log10(p)
        out.append((doc, held(doc), len(t) - 1, sum(count[w,] > 0 for w in t[1:]), n, base, score))
    return sorted(out, key=str)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 12))) for _ in range(80)] + ["The", "the", "THE"] * 20
    out = [None, "", " \n\t ", "x", "aa " * 300, "a" * 5000, "the very " * 70000 + "end"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return [(5 * i - 40, t) for i, t in enumerate(out)] + [(7, "twice the same"), (7, "twice the same"), (7, "and another"), (None, "no id the")]


def test_scores_of_all_texts(spark):
    rows = texts(120, 3)
    got = sorted((tuple(r) for r in L.fit_and_score(spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS).repartition(3)).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_context_tells_more_than_words(spark):
    """Held-out texts of a language with fixed sequences of words."""
    rng = random.Random(4)
    phrases = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(9)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(30)), 1, 1) for i in range(300)]
    got = [r for r in L.fit_and_score(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_a_model_scores_other_texts(spark):
    rows = texts(40, 5)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS)
    model, got = L.run(df, L.held_out())
    want = {r["row"]: r["score"] for r in [{"row": str(x.doc_id) + str(x.n_tokens), "score": x.score} for x in got.collect()]}
    again = {str(x.doc_id) + str(x.n_tokens): x.score for x in L.score(df.repartition(2), model).collect()}
    assert again == want
    L.forget(model)


def test_split_contexts():
    """A context's successors in several parts keep different numbers, and a level finds what it holds and nothing else."""
    rng = np.random.default_rng(1)
    context, item = np.divmod(np.unique(rng.integers(0, 300 * 1000, 4000)), 1000)
    count, total = rng.integers(1, 9, len(item)), np.full(len(item), 5000)
    level = L.TrieLevel(L.trie_level(context, item, count, total, 4.0, True))
    got = level.find(np.r_[context, context], np.r_[item, item + 1000])
    n = len(item)
    assert (got["place"][:n] == np.arange(n) + 1).all() and (got["count"][:n] == count).all() and not got["place"][n:].any()
    first = np.searchsorted(context, context)
    assert (got["rank"][:n] == np.arange(n) - first).all()
    assert (10.0 ** (-got["share"][:n] / L.STEPS) <= count / (total + 4.0) + 1e-15).all()
    parts, part = L.splits(np.array([10, L.SPLIT * 5]), np.array([3, 4]))
    assert parts.tolist() == [1, 6] and part[0] == 0 and 0 <= part[1] < 6


def test_no_texts_and_none_to_learn_from(spark):
    assert L.fit_and_score(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = L.fit_and_score(spark.createDataFrame([(held, "a b", 1, 1)], DOCS)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
