"""Corpus operators against brute force on small tables with nulls, empty, long, tied and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeflow.llm import chat, components, decontaminate, features, forest, hashing, metric_join, mixing, quality, recompression, suffix_dedup, toxicity
from cladeflow.llm import repeats as R

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    """Invented texts with shared passages, copies, near copies, runs, nulls and blanks."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(70) for _ in range(3)]
    texts = [None, "", "  \n\t ", "x", "aa " * 300, "a" * 700, "ab" * 400]
    for _ in range(n):
        k = rng.random()
        if k < 0.25 and len(texts) > 12:
            t = rng.choice(texts[7:])
            w = t.split(" ")
            if k < 0.15 and w:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        elif k < 0.6:
            texts.append(prose(rng.randint(0, 60)) + " " + rng.choice(passages) + "\n" + prose(rng.randint(0, 60)))
        else:
            texts.append(prose(rng.randint(1, 150)))
    return [(3 * i - 20, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_hot_symbols():
    """Windows of hot symbols meet by their own content; the stretches found are the same."""
    rng = np.random.default_rng(8)
    base = rng.integers(97, 100, 160).astype(np.uint8)
    data = np.concatenate([np.r_[base[k % 7 :], rng.integers(97, 123, 40).astype(np.uint8)] for k in range(30)])
    size = np.array([160 - k % 7 + 40 for k in range(30)])
    start = np.cumsum(size) - size
    e = {"doc": np.arange(30), "pos": np.zeros(30, np.int64), "len": (size - 99).astype(np.int32), "symbol": np.full(30, 5, np.uint64)}
    found = []
    for hot in (np.zeros(30, bool), np.ones(30, bool), np.arange(30) % 1 == 0):
        table = pa.Table.from_batches([R.content_batch(e | {"hot": hot}, start, R.Units(data), 100, 3, 7)])
        s = R.repeated_windows(table, False, 100, True, 7)
        s = R.merged(s["doc"], s["pos"], s["print"])
        found.append({f: v.tolist() for f, v in s.items()})
        assert len({*table.column("bucket").to_pylist()}) == (3 if hot.all() else 1)
    assert found[0] == found[1] == found[2] and len(found[0]["doc"]) >= 23


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_suffix_dedup(spark, docs, batches):
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(docs, batches=batches).collect()}
    seen = set()
    for doc, text, *_ in sorted(corpus()):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        assert (got[doc].n_bytes, got[doc].n_removed, got[doc].n_spans, got[doc].kept_sha256) == (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())


def test_recompression(spark, docs):
    got = {r.doc_id: r for r in recompression.dedup_passages(docs).collect()}
    seen = {}
    for doc, text, *_ in sorted(corpus()):
        w = words_of(text)
        mark = [0] * len(w)
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), doc) < doc:
                mark[p : p + 50] = [1] * 50
        kept = b" ".join(x for x, m in zip(w, mark, strict=True) if not m)
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(w), sum(mark), hashlib.sha256(kept).hexdigest())
        assert got[doc].kept_text == kept.decode()


def test_recompression_symbols():
    """Symbols whose context lies in a stretch that stands in two places are the same in both."""
    rng, names = np.random.default_rng(5), {}
    shared = rng.integers(0, 9, 160)
    shared[60:75] = 4  # a run
    sides = [np.r_[-1, rng.integers(0, 9, n), shared, rng.integers(0, 9, 40), -2] for n in (30, 77)]
    states = [(x, np.arange(len(x)), np.arange(len(x)), np.arange(len(x)) + 1) for x in sides]
    for level in range(recompression.rounds_for(50)):
        found = []
        for k, state in enumerate(states):
            s = recompression.compressed(*state, level)
            ids = [names.setdefault((level, *key), 1000 * (level + 1) + len(names)) for key in zip(*(s[f].tolist() for f in recompression.KEY), strict=True)]
            plain = iter(s["symbol"].tolist())
            symbol = np.array([ids[c - 2] if c > 1 else next(plain) if c else -1 - i for i, c in enumerate(s["code"].tolist())])
            start = np.cumsum(s["step"]) - s["step"]
            assert s["step"].sum() == len(sides[k]) and (np.diff(start - s["before"]) >= 0).all() and (np.diff(start + s["after"]) >= 0).all()
            states[k] = symbol, start, start - s["before"], start + s["after"]
            base = (31, 78)[k]
            inside = (states[k][2] >= base) & (states[k][3] <= base + 160)
            found.append({(a - base, x) for a, x in zip(start[inside].tolist(), symbol[inside].tolist(), strict=True)})
        assert found[0] == found[1] and len(found[0]) > 160 * 0.5 ** (level + 1) - 20


def test_distinct_pieces(monkeypatch):
    data = np.frombuffer(b"one two one three two", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 18]), np.array([3, 7, 11, 17, 21])
    for _ in range(2):
        one, of = recompression.distinct_pieces(data, starts, ends)
        assert len(one) == 3 and of[0] == of[2] and of[1] == of[4] and len({*of.tolist()}) == 3
        keys = {"s1": np.array([1, 2, 1]), "n1": np.array([1, 1, 1], np.int32), "s2": np.array([5, 5, 5]), "n2": np.array([1, 1, 1], np.int32)}
        one, of = recompression.distinct_keys(keys)
        assert len(one) == 2 and of[0] == of[2] != of[1]
        monkeypatch.setattr(recompression, "piece_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        monkeypatch.setattr(recompression, "key_hashes", lambda k: np.zeros(len(k["s1"]), np.uint64))


def test_very_long_texts(spark):
    """Texts of several pieces, against all windows."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = [rng.choice(words) for _ in range(140_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["new"] + long[65_000:66_500] + ["end"] + long[130_900:])), (3, " ".join(long[70_000:70_060] + ["x"] * 70_000)), (4, "x " * 66_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).selectExpr("*", "1 AS bucket", "2 AS spans", "3 AS component_id", "4 AS chunk", "5 AS n_words")
    seen, wanted = {}, {}
    for doc, text in rows:
        w = text.split()
        mark = np.zeros(len(w) + 1, int)
        for p in range(len(w) - 49):
            if seen.setdefault(hash(tuple(w[p : p + 50])), doc) < doc:
                mark[p] += 1
                if p + 50 <= len(w):
                    mark[p + 50] -= 1
        wanted[doc] = int((np.cumsum(mark)[:-1] > 0).sum())
    assert {r.doc_id: r.n_removed for r in recompression.dedup_passages(docs, texts=False).collect()} == wanted
    seen, wanted = set(), {}
    for doc, text in rows:
        b = text.encode()
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            h = hash(b[p : p + 100])
            if h in seen:
                mark[p] += 1
                mark[p + 100] -= 1
            seen.add(h)
        wanted[doc] = int((np.cumsum(mark)[:-1] > 0).sum())
    assert {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(docs, batches=2).collect()} == wanted


def test_segments(monkeypatch):
    """Pieces of very long texts give the same windows as the whole."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets, ids = np.array([0, 20, 4000, 5000]), np.array([1, 2, 3])
    whole = [e for e in suffix_dedup.byte_entries(data, offsets, ids, 100, 32, 7)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 300)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    cut = [e for e in suffix_dedup.byte_entries(data, offsets, ids, 100, 32, 7)]
    n = lambda es: sum(int(e["len"].sum()) for e in es)
    assert n(whole) == n(cut) == (4000 - 20 - 99) + (1000 - 99)
    symbols = lambda es: Counter({(int(d), int(p) + k, int(s)): 1 for e in es for d, p, s, m in zip(e["doc"], e["pos"], e["symbol"], e["len"], strict=True) for k in range(m)})
    assert symbols(whole) == symbols(cut)


def test_merged():
    m = R.merged(np.array([1, 1, 1, 2]), np.array([0, 5, 20, 3]), np.array([10, 12, 30, 4]))
    assert m["doc"].tolist() == [1, 1, 2] and m["pos"].tolist() == [0, 20, 3] and m["print"].tolist() == [12, 30, 4]


def jaccard_classes(rows, k, a, b):
    sets = {}
    for doc, text, *_ in rows:
        w = words_of("".join(c.lower() if c.isascii() else c for c in (text or "")))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}
    for x, y in itertools.combinations(sorted(sets), 2):
        i, u = len(sets[x] & sets[y]), len(sets[x] | sets[y])
        if u and b * i >= a * u:
            p, q = x, y
            while up[p] != p:
                p = up[p]
            while up[q] != q:
                q = up[q]
            up[max(p, q)] = min(p, q)

    def top(x):
        return x if up[x] == x else top(up[x])

    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize(("words", "similarity", "limit", "few"), [(3, (90, 100), 64, 6), (5, (80, 100), 64, 6), (2, (60, 100), 4, 2), (3, (90, 100), 3, 2)])
def test_jaccard(spark, monkeypatch, words, similarity, limit, few):
    rng = random.Random(9)
    rows = corpus(70, 5)
    base = [f"w{i}" for i in range(80)]
    for i in range(14):  # a group of near copies of one text, larger than the limits
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(80)] = f"v{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(w), None, None, 1))
    monkeypatch.setattr(metric_join, "BASE", limit)
    monkeypatch.setattr(metric_join, "BLOCK", limit)
    monkeypatch.setattr(metric_join, "FEW", few)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in metric_join.jaccard_components(docs, words, similarity).collect()}
    assert got == jaccard_classes(rows, words, *similarity)


def test_first_elements_are_shared_by_similar_sets():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 400, n).astype(np.uint64) for n in (1, 2, 7, 30)]
    sets = [np.unique(np.where(rng.random(len(x)) < 0.1, rng.integers(0, 400, len(x)), x)).astype(np.uint64) for x in base for _ in range(25)]
    values, counts = np.concatenate(sets), np.array([len(x) for x in sets])
    element, n = np.unique(values, return_counts=True)
    for similarity in ((80, 100), (90, 100), (1, 2)):
        for known in ((element[n > 3], n[n > 3]), (element[:0], n[:0])):  # whatever is known of their counts
            row, kept = metric_join.first_elements(values, counts, similarity, known)
            first = [set(kept[row == k].tolist()) for k in range(len(sets))]
            for i, j in zip(*np.nonzero(metric_join.linked(sets, sets, similarity)), strict=True):
                assert first[i] & first[j]


@pytest.mark.parametrize(("block", "leaders"), [(3, 2), (7, 4), (1024, 64)])
def test_forest_has_the_components_of_all_links(monkeypatch, block, leaders):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "LEADERS", leaders)
    rng = np.random.default_rng(1)
    for _ in range(10):
        base = rng.integers(0, 60, (3, 12))
        sets = [np.unique(np.where(rng.random(12) < 0.12, rng.integers(0, 60, 12), base[rng.integers(3)])).astype(np.uint64) for _ in range(30)]
        every = np.arange(30)
        for l, r in ((every, every), (every[::2], every[1::2])):
            link = metric_join.linked([sets[k] for k in l], [sets[k] for k in r], (80, 100))
            want = every.copy()
            for x, y in components.spanning(every, *(k[at] for k, at in zip((l, r), np.nonzero(link), strict=True))):
                want[x] = y
            assert metric_join.forest(sets, l, r, (80, 100)).tolist() == want.tolist()


def test_saturated_sets_make_small_families(spark, monkeypatch):
    """Sets that share nothing but empty slices, or a common passage, were one family; a family's blocks copy its members."""
    rng, rows = random.Random(4), []
    for k in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(30)]
        rows += [(2 * k, " ".join(words + ["one", "passage", "of", "all"])), (2 * k + 1, " ".join(words[1:] + ["one", "passage", "of", "all"]))]
    sizes, whole = [], metric_join.region_links
    monkeypatch.setattr(metric_join, "FEW", 0)  # all sets are saturated
    for name, n in (("BASE", 2), ("BLOCK", 4), ("MOST", 2), ("LEADERS", 3), ("SOME", 1)):
        monkeypatch.setattr(metric_join, name, n)
    monkeypatch.setattr(metric_join, "region_links", lambda sets, similarity: sizes.extend(r["count"] for r in sets.groupBy("region").count().collect()) or whole(sets, similarity))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in metric_join.jaccard_components(docs, 3, (80, 100)).collect()}
    assert got == {k: k - k % 2 for k in range(80)} and sizes == [2] * 40
    one = [(0, k, np.unique([zlib.crc32(w.encode()) for w in text.split()]).astype(np.uint64).tobytes()) for k, text in rows]
    links = components.components(metric_join.region_links(spark.createDataFrame(one, "region long, id long, elements binary"), (80, 100)))
    assert {r.id: r.component for r in links.collect()} == {k: k - k % 2 for k in range(80)}


def thue_morse(n, a="a", b="b"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits)


def test_equal_polynomials(spark):
    """Words that share every polynomial hash modulo a power of two are different words."""
    rows = []
    for k in range(9, 14):
        rows += [(2 * k, thue_morse(1 << k)), (2 * k + 1, thue_morse(1 << k, "b", "a"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in metric_join.jaccard_components(docs).collect())
    side = " ".join(f"w{i}" for i in range(25))
    around = spark.createDataFrame([(d, f"{side} {t} {side}") for d, t in rows] + [(99, f"{side} {rows[0][1]} {side}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in recompression.dedup_passages(around).collect()} == {d: 0 for d, _ in rows} | {99: 51}
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_substrings(docs).collect()}
    seen, wanted = set(), {}
    for d, t in rows:
        mark = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                mark[p : p + 100] = b"1" * 100
            seen.add(t[p : p + 100])
        wanted[d] = sum(x == 49 for x in mark)
    assert got == wanted


def test_words_made_to_share_a_fixed_hash(spark):
    """Two words of one hash under the fixed constants, and lanes made to cancel each other: nothing is linked or removed for it."""
    a, b = "xtda514ta4a01006", "3cor9s07rxz6aol9"
    one, two = (np.frombuffer(x.encode(), np.uint8) for x in (a, b))
    assert hashing.piece_hashes(one, np.array([0]), np.array([16])) == hashing.piece_hashes(two, np.array([0]), np.array([16]))
    rows = [(1, a), (2, b), (3, f"p q {a}"), (4, f"p q {b}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.component_id, r.n_shingles) for r in metric_join.jaccard_components(docs).orderBy("doc_id").collect()] == [(k, 1) for k in (1, 2, 3, 4)]
    side = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{a} {side}"), (2, f"{b} {side}"), (3, f"{side} {a}"), (4, f"{side} {b}"), (5, f"{side} {b}")], "doc_id long, text string")
    assert [r.n_removed for r in recompression.dedup_passages(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0, 50]
    docs = spark.createDataFrame([(1, a + "z" * 84), (2, b + "z" * 84), (3, "y" * 40 + a + "x" * 44), (4, "y" * 40 + b + "x" * 44), (5, "y" * 40 + b + "x" * 44)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.dedup_substrings(docs).orderBy("doc_id").collect()] == [0, 0, 0, 0, 100]


def test_windows_are_told_apart_by_bytes(monkeypatch):
    """Should all hashes be one, equal windows are still only those of equal bytes."""
    monkeypatch.setattr(R, "keyed_hashes", lambda data, starts, ends, key: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabcabdab", np.uint8)
    begin = np.array([0, 3, 6, 1, 4, 7, 9])
    end = begin + np.array([3, 3, 3, 2, 2, 2, 2])
    got = R.equal_windows(data, begin, end, np.zeros(7, np.uint64), 1)
    text = [data[x:y].tobytes() for x, y in zip(begin, end)]
    assert all((got[i] == got[j]) == (text[i] == text[j]) for i in range(7) for j in range(7))


def test_keyed_hashes_of_all_lengths():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts, size = rng.integers(0, 2000, 3000), rng.integers(0, 1800, 3000)
    keys = hashing.keyed_hashes(data, starts, starts + size, 5)
    seen = {}
    for k, x, n in zip(keys.tolist(), starts, size):
        assert seen.setdefault(k, data[x : x + n].tobytes()) == data[x : x + n].tobytes()
    assert (hashing.keyed_hashes(data, starts, starts + size, 6) != keys).all()
    assert len({data[i : i + 32].tobytes() for i in range(3969)}) == len(set(hashing.keyed_grams(data, 32, 9).tolist()))


def test_no_table_stays_behind(spark):
    """Neither success nor a failing step leaves tables in the warehouse or a catalog entry."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 3) * 7 + k}" for k in range(60))) for i in range(6)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    recompression.dedup_passages(docs).collect()
    suffix_dedup.dedup_substrings(docs).collect()
    bad = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("text", F.when(F.raise_error("broken").isNull(), F.col("text")))
    with pytest.raises(Exception, match="broken"):
        recompression.dedup_passages(bad).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    warehouse = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    assert not warehouse.exists() or not list(warehouse.iterdir())


def test_poisson_of_large_means(spark):
    """Quantiles near and far from the mean of up to 1e7 against sums in plain Python, quickly; copies in blocks are all there."""
    import time

    def quantile(mean, u):
        m = int(mean)
        reach = int(12 * math.sqrt(mean) + 40)
        log = lambda n: (n - mean) + n * math.log1p((mean - n) / n) - 0.5 * math.log(2 * math.pi * n) - 1 / (12 * n) + 1 / (360 * n**3)
        total, n = 0.0, m - reach - 1
        while total <= u:
            n += 1
            total += math.exp(log(n))
        return n

    df = spark.createDataFrame([(mean, u) for mean in (1001.5, 5e4, 1e6) for u in (1e-9, 0.01, 0.5, 0.99, 1 - 1e-9)] + [(1e7, 0.3)], "mean double, u double")
    began = time.time()
    got = df.select("mean", "u", mixing.large_quantile(F.col("mean"), F.col("u")).alias("n")).collect()
    assert time.time() - began < 20 and all(r.n == quantile(r.mean, r.u) for r in got)
    counted = spark.createDataFrame([(1, 25_001), (2, 3), (3, 0), (4, 10_000), (5, 10_001)], "id long, n_copies int")
    for most in (1.0, 1e6):
        made = mixing.replicated(counted, most).groupBy("id").agg(F.count("*").alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.countDistinct("copy").alias("d")).collect()
        assert {(r.id, r.n, r.a, r.b, r.d) for r in made} == {(i, n, 1, n, n) for i, n in ((1, 25_001), (2, 3), (4, 10_000), (5, 10_001))}


def test_one_document_against_many(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big", 1) for i in range(3000)] + [(9000, "t", "en", "rare", 1)], DOCS)
    n = {r.source: r["count"] for r in mixing.mix_documents(docs).groupBy("source").count().collect()}
    assert abs(n["rare"] - 1500.5) < 6 * math.sqrt(1500) and abs(n["big"] - 1500.5) < 6 * math.sqrt(1500)


def test_keep_one(spark):
    rows = [(5, "a b c d e f", "x", "s", 1), (2, "a b c d e f", "x", "s", 1), (2, "a b c d e f", "x", "s", 1), (9, None, "x", "s", 1), (None, "q", "x", "s", 1)]
    kept = metric_join.keep_one_each(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS region", "2 AS same"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9] and kept.columns[-2:] == ["region", "same"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


def chain(order):
    return list(zip(order[:-1], order[1:], strict=True))


_SHUFFLED = random.Random(2).sample(range(2000), 2000)
GRAPHS = {"ascending": chain(range(2000)), "shuffled": chain(_SHUFFLED), "star": [(1999, i) for i in range(1999)]}


@pytest.mark.parametrize("name", GRAPHS)
def test_component_rounds(spark, monkeypatch, name):
    """Rounds between tasks that each hold a few edges only."""
    rounds = []
    step = components.star_round
    monkeypatch.setattr(components, "star_round", lambda live: rounds.append(1) or step(live))
    edges = GRAPHS[name]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), per_task=250).collect()}
    assert got == dict.fromkeys(range(2000), 0) and len(rounds) <= 12


@pytest.mark.parametrize("block", [2048, 7])
def test_forest(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 16))
    x[40:90] = x[0] + 0.12 * rng.standard_normal((50, 16))
    x[100:110] = x[99]
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)] + [(1001, None), (1003, [0.0] * 16), (1005, [float("nan")] + [1.0] * 15), (1007, [1.0, 2.0]), (1009, []), (None, x[0].tolist()), (0, x[0].tolist()), (1011, [None] + [1.0] * 15), (1013, [float("inf")] + [1.0] * 15)]
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 20)
    got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS tree")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(150, dtype=bool)
    assert len(got) == 150 + 8 - 1 + 0
    found = sum(got[2 * i].n_links for i in range(150))
    assert 0.97 * link.sum() <= found <= link.sum()
    assert all(got[2 * i].n_links <= link[i].sum() for i in range(150))
    assert {got[2 * i].component_id for i in (0, *range(40, 90)) if link[i].any()} == {0}
    for bad in (1001, 1003, 1005, 1007, 1009, 1011, 1013):
        assert (got[bad].n_links, got[bad].component_id, got[bad].kept) == (0, bad, True)
    assert forest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize(("n", "leaf", "sample"), [(300, 20, 20_000), (2500, 40, 20_000), (6000, 25, 300)])
def test_forest_recall(spark, monkeypatch, n, leaf, sample):
    """Of all links, at least nine in ten; the last case has trees far deeper than their sample."""
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "SAMPLE", sample)
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((n // 5, 32))
    x = centres[rng.integers(0, len(centres), n)] + 0.22 * rng.standard_normal((n, 32))
    got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(list(enumerate(x.astype(np.float32).tolist())), "vec_id long, embedding array<float>")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(n)])
    assert links.sum() > n / 2 and (found <= links).all() and found.sum() >= 0.9 * links.sum()


def test_forest_magnitudes(spark):
    rng = np.random.default_rng(7)
    v = rng.standard_normal(6)
    rows = [(v * 1e200).tolist(), (v * 1e-200).tolist(), v.tolist(), (v * 1e-310).tolist(), (-v * 1e300).tolist(), [1.7e308] * 6, [1e-300] * 6, [-0.0] * 6]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_forest_lengths(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 20)
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(16).tolist() for _ in range(30)] + [rng.standard_normal(8).tolist() for _ in range(25)] + [[1.0, 2.0], [1.0, 2.0], [1.0, 2.01], [3.0]]
    vectors += [vectors[3], vectors[31], (np.array(vectors[32]) * 2 + 1e-3).tolist()]
    got = {r.vec_id: r for r in forest.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    for i, v in enumerate(vectors):
        near = [j for j, w in enumerate(vectors) if j != i and len(w) == len(v) and np.dot(v, w) >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert (got[i].n_links, got[i].component_id) == (len(near), min([i, *near])), i


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, text(22)) for i in range(6)] + [(90, None), (91, "too short"), (None, text(20))]
    rows = [(1, None), (2, ""), (None, items[0][1]), (3, text(100)), (4, "X " + items[1][1].upper().replace(" ", " \n ") + " y")]
    for k in range(24):
        t = list(" ".join(items[k % 6][1].split()))
        for _ in range(k // 2):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["z"], [t[at], "z"]])
        rows.append((10 + k, text(30) + " " + "".join(t) + " " + text(10)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS item_id", "1 AS start")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    wanted = set()
    fold = lambda t: " ".join(t.lower().split())
    for (d, t), (i, x) in itertools.product(rows, items):
        if None not in (d, t, i, x) and len(fold(x)) >= 50:
            x = fold(x)
            starts = sorted({*range(0, len(x) - 99, 50), max(0, len(x) - 100)})
            if any(edits(x[s : s + 100], fold(t)) <= len(x[s : s + 100]) // 10 for s in starts):
                wanted.add((d, i))
    assert got == wanted and (4, 1) in got and not any(d == 3 for d, _ in got)
    kept = decontaminate.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in wanted} and kept.columns == docs.columns
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="lemma"):
        decontaminate.find_leaks(docs, bench, q=12)


def test_decontaminate_any_stretch(spark):
    rng = random.Random(18)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).replace("  ", " a").strip()
    item = "q" + prose(197) + "rs"
    items = [(0, item), (1, "Who wrote the first of these, and when?"), (2, "twelve men in a boat at sea"), (3, "zyx 7"), (4, "k")]
    rows, wanted = [], set()

    def put(text, *found):
        rows.append((len(rows), text))
        wanted.update((len(rows) - 1, i) for i in found)

    for at in range(0, len(item) - 99, 5):
        put(prose(60) + "ZZ" + item[at : at + 100] + "ZZ" + prose(40), 0)
    for at in (7, 25, 33):
        t = list(item[at : at + 100])
        for p in range(5, 100, 10):
            t[p] = "Z"
        put(prose(30) + "YY" + "".join(t) + "YY", 0)
        t[50] = "Z"
        put(prose(30) + "YY" + "".join(t) + "YY")
    put(prose(50) + " who WROTE the first of  these, and when? " + prose(50), 1)
    put(prose(50) + " who wrote the frst of these, and wen? " + prose(50), 1)
    put(prose(50) + " twelve men in a goat at see " + prose(50), 2)
    put(prose(50) + " twelve hens in a goat at see " + prose(50))
    put("the code is zyx 7.", 3)
    put("the code is zyx 77 or uzyx 7")
    put("k", 4)
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted
    assert all(r.edits == 0 and r.n_places == 1 and r.end - r.start >= 100 for r in got if r.doc_id < 21)
    for (d, t), (i, x) in itertools.product(rows[21:], items[:3]):
        stretches = [x[s : s + 100].lower() for s in range(max(1, len(x) - 99))]
        assert ((d, i) in wanted) == any(edits(w, " ".join(t.lower().split())) <= len(w) // 10 for w in stretches)


def test_decontaminate_long_and_repeated(spark):
    """Very long texts, repeated rows, ties, blanks at the ends and columns of clashing names."""
    rng = random.Random(28)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(1, prose(25) + " \n "), (2, prose(25)), (2, prose(25)), (3, "  " + prose(6) + "\t")]
    long = prose(150_000) + " " + items[0][1] + prose(150_000) + items[1][1].upper() + " " + prose(10)
    rows = [(5, long), (6, prose(80)), (7, prose(9) + items[2][1] + prose(9)), (7, prose(9) + items[2][1] + prose(9)), (7, None), (8, prose(9) + " " + items[3][1].strip())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS leak", "2 AS item_id", "3 AS edits").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(found) == {(5, 1), (5, 2), (7, 2), (8, 3)} and all(r.edits == 0 for r in found.values())
    at = " ".join(long.lower().split())
    r = found[5, 1]
    assert at[r.start : r.end].startswith(" ".join(items[0][1].split())[:20])
    kept = decontaminate.decontaminate(docs, bench)
    assert [r.doc_id for r in kept.collect()] == [6] and kept.columns == docs.columns


def test_jaccard_long_and_clashing(spark):
    rng = random.Random(29)
    words = [f"w{i}" for i in range(5000)]
    long = [rng.choice(words) for _ in range(120_000)]
    near = list(long)
    near[60_000] = "changed"
    rows = [(4, " ".join(long), "x"), (2, " ".join(near).upper(), "y"), (9, " ".join(long[:60_000]), "z"), (None, " ".join(long), "n"), (6, None, "q"), (7, "same words here now", "q"), (8, "same words here now", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, region string").selectExpr("*", "1 AS component_id", "2 AS n_shingles", "3 AS same", "4 AS cls").repartition(2)
    got = {r.doc_id: r.component_id for r in metric_join.jaccard_components(docs).collect()}
    assert got == {4: 2, 2: 2, 9: 9, 6: 6, 7: 7, 8: 7}
    kept = metric_join.keep_one_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 9] and kept.columns == docs.columns


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 4 else ("small" if i % 8 else None), 2) for i in range(2000)] + [(None, "n", None, "", 1), (5, "again", "en", "big", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix_sources(docs).collect()
    shares = Counter(r.source or "" for r in out)
    assert all(abs(shares[s] - len(rows) / 3) < 5 * math.sqrt(len(rows)) for s in ("big", "small", ""))
    copies = Counter((r.doc_id, r.text) for r in out)
    assert all(copies[r.doc_id, r.text] == r.n_copies for r in out)
    assert sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect())) == sorted(map(str, out))
    assert [r.shuffle_key for r in out] != sorted(r.shuffle_key for r in out) or len(out) < 50
    assert {r.source for r in mixing.mix_sources(docs, {"small": 1.0}).collect()} == {"small"}
    assert mixing.mix_sources(docs, {}).count() == 0 and mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns
    clash = mixing.mix_sources(docs.withColumns({"copy": docs.doc_id, "rate": docs.text, "salt": docs.text, "table": docs.text}))
    assert clash.columns == [*docs.columns, "_copy", "_rate", "salt", "table", "copy", "n_copies", "rate", "shuffle_key"]
    assert all(r._copy == r.doc_id and r._rate == r.table == r.text for r in clash.collect())
    assert mixing.mix_documents(docs.withColumn("n_copies", docs.text)).columns == [*docs.columns, "n_copies"]


def test_mixing_many_sources(spark, monkeypatch):
    """Beyond the bound of the broadcast the result is the same."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 7}", 2) for i in range(300)], DOCS)
    few = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == few


def test_poisson(spark):
    from pyspark.sql import functions as F

    rows = [(m, u) for m in (0.0, 0.1, 1.0, 7.5, 300.0) for u in (0.0, 1e-12, 0.3, 0.9, 0.999999)]
    got = spark.createDataFrame(rows, "m double, u double").withColumn("table", mixing.cumulative(F.col("m"))).withColumn("n", mixing.poisson_quantile(F.col("table"), F.col("u"))).collect()
    for r in got:
        p = total = math.exp(-r.m)
        n = 0
        while total <= r.u:
            n += 1
            p *= r.m / n
            total += p
        assert r.n == n
    big = spark.range(1).select(mixing.cumulative(F.lit(5000.0)).alias("table")).crossJoin(spark.range(400)).select(mixing.poisson_quantile(F.col("table"), mixing.uniform(1, F.col("id"))).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(big[0] - 5000) < 20 and 3500 < big[1] < 7000


def test_chat(spark):
    texts = ["plain", None, "", "\\### Assistant: </turn> ok", "a\nb: c", "\\b\\l\\h\\\\<#<</turn>\n### user: x", "é😀</turn>\n"]
    roles = ["user", "assistant", "we#ird: r\\ole", None, "assistant", "assistant", "assistant"]
    rows = [(c, t, roles[(t + c) % 7], texts[t]) for c in range(7) for t in range(7)] + [(None, 1, "user", "null id"), (50, 3, "user", "twice"), (50, 3, "user", "twice")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS kind")
    formatted = chat.format_chat(chat.events_of_turns(turns))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    digests = {r.conv_id: r for r in chat.digest(formatted).collect()}
    for c in (*range(7), None, 50):
        mine = sorted({(t, r or "", x or "") for k, t, r, x in rows if k == c})
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert "".join(got[c].loss_texts) == loss and digests[c].loss_chars == len(loss)
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert digests[c].formatted_chars == len(got[c].formatted)
    assert chat.digest(chat.format_chat(chat.events_of_turns(turns.limit(0)))).count() == 0


def test_chat_ties(spark):
    rows = [(1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, None, "user", "later"), (1, None, "assistant", "last"), (1, 1, None, "<"), (1, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for made, texts in ((chat.format_chat(chat.events_of_turns(turns)), ["<", "a", "b", "last", "later"]), (chat.render(chat.messages_of_turns(turns)), ["<", "a", "a", "b", "last", "later"])):
        (back,), (found,) = chat.read_back(made).collect(), chat.digest(made).collect()
        assert [t.text for t in back.turns] == texts and back.loss_texts == [t for t in texts if t in ("a", "b", "last")]
        assert found.n_turns == len(texts)


def test_chat_turns_are_folded_as_a_log(spark, monkeypatch, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 1, "assistant", "<"), (1, None, None, "last"), (1, None, None, None), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    same = lambda df: sorted(map(tuple, chat.digest(df).collect()))
    assert same(chat.format_turns(turns)) == same(chat.render(chat.messages_of_turns(turns)))
    assert chat.format_turns(turns.limit(0)).count() == 0
    from cladeflow.llm import queries as llm_queries

    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    logs, fold = [], chat.fold_events
    monkeypatch.setattr(chat, "fold_events", lambda log: logs.append(log) or fold(log))
    assert llm_queries.op10_chat_format(spark, str(tmp_path)).count() == 3 and [log.count() for log in logs] == [len(rows) + 2]


def test_chat_long(spark):
    long = "a\\b<c>#d: é " * 60_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss", "3 AS message")
    made = chat.render(chat.messages_of_turns(turns))
    (back,), (found,) = chat.read_back(made).collect(), chat.digest(made).collect()
    assert [t.text for t in back.turns] == [long, long, ""] and "".join(back.loss_texts) == long and found.loss_chars == len(long)


def test_chat_events(spark):
    log = [
        (1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"), (1, 5, 0, "edit", "user", "Hi!"),
        (1, 6, 1, "regenerate", None, None), (1, 8, 1, "delta", None, "there"), (1, 7, 1, "delta", None, "You "), (2, 1, 5, "delta", "assistant", "x"), (2, 2, 5, "delta", None, "y"),
    ]
    found = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string"))
    assert {(r.conv_id, r.message, r.role, r.text) for r in found.collect()} == {(1, 0, "user", "Hi!"), (1, 1, "assistant", "You there"), (2, 5, "assistant", "xy")}


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 4 != 0, i % 5 == 0
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(rng.randint(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["scumzz", "idiotzz", "trashzzing"]))
        rows.append((i, " ".join(w), "en", f"s{i % 5}" if good else "junk", 10))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows + [(5000, None, None, None, None), (None, "word1", None, None, None), (5001, "", "", "", 0)], DOCS).selectExpr("*", "1 AS label", "2 AS quality")
    known = spark.createDataFrame(labels[:250] + [(7, 0, 0), (300, 5, 5), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score_quality(docs, known).collect()}
    held = labels[250:]
    assert np.mean([out[d].keep == bool(q) for d, q, _ in held]) > 0.95
    assert len(out) == 403 and all(0 <= r.quality <= 1 for r in out.values())
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if r.keep}
    assert {r.quality for r in quality.score_quality(docs, known.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), known).count() == 0


def test_toxicity(spark):
    rows, labels = labelled(seed=4)
    docs = spark.createDataFrame(rows + [(5000, None, None, None, None), (5001, "", "", "", 0)], DOCS).selectExpr("*", "1 AS label", "2 AS grade")
    known = spark.createDataFrame(labels[:250] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert np.mean([out[d].toxic == bool(t) for d, _, t in labels[250:]]) > 0.97
    many = lambda d: sum("zz" in w for w in rows[d][1].split())
    severe = [out[d].expected_severity for d, _, t in labels if t and many(d) >= 5]
    mild = [out[d].expected_severity for d, _, t in labels if t and many(d) == 1]
    assert np.mean(severe) > np.mean(mild) + 0.3 and not out[5000].toxic and not out[5001].toxic
    assert {r.toxic for r in toxicity.score_toxicity(docs, known.limit(0)).collect()} == {False}


def sparse(rows, size, rng, each=6):
    index = np.concatenate([np.sort(rng.choice(size, each, replace=False)) for _ in range(rows)]).astype(np.int32)
    return features.Sparse(index, rng.random(rows * each).astype(np.float32) + 0.5, np.arange(rows + 1) * each)


def dense(x, size):
    out = np.zeros((len(x), size))
    out[np.repeat(np.arange(len(x)), np.diff(x.offsets)), x.index] = x.value
    return out


def test_ordinal_grades():
    """Planted grades: the shared weights and ordered cuts that drew them are found, and the loss is at its least."""
    rng = np.random.default_rng(3)
    x, true, cuts = sparse(4000, 30, rng), rng.standard_normal(30), np.array([-1.0, 1.0, 2.5])
    z = dense(x, 30) @ true
    grade = (z[:, None] + rng.logistic(size=(4000, 1)) > cuts).sum(1)
    w, c = toxicity.fit_ordinal(x, grade, 30, 4, steps=600)
    assert np.corrcoef(w, true)[0, 1] > 0.98 and (np.diff(c) > 0).all() and np.abs(c - cuts).max() < 0.35
    expected = features.sigmoid((dense(x, 30) @ w)[:, None] - c).sum(1)
    means = [expected[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and abs(expected.mean() - grade.mean()) < 0.02

    def loss(w, c):
        above = np.c_[np.ones(4000), features.sigmoid((dense(x, 30) @ w)[:, None] - c), np.zeros(4000)]
        return -np.log(above[np.arange(4000), grade] - above[np.arange(4000), grade + 1]).mean()

    assert all(loss(w, c) < loss(w + d, c) + 1e-4 for d in 0.1 * np.eye(30)) and all(loss(w, c) < loss(w, c + d) + 1e-4 for d in 0.1 * np.r_[np.eye(3), -np.eye(3)])


def test_logistic():
    """Gradient at the fitted weights, computed directly, is next to nothing."""
    rng = np.random.default_rng(4)
    x = sparse(3000, 20, rng)
    d = np.c_[dense(x, 20), np.ones(3000)]
    y = (rng.random(3000) < features.sigmoid(d @ rng.standard_normal(21))).astype(float)
    w = features.fit_logistic(x, y, 20, steps=800)
    assert np.abs(d.T @ (features.sigmoid(d @ w) - y) / 3000).max() < 2e-3
    assert np.allclose(x.dot(w[:-1]), dense(x, 20) @ w[:-1], atol=1e-4) and np.allclose(x.back(y, 20), y @ dense(x, 20), atol=1e-2)


def test_cotraining_exchange():
    """Pseudo-labels pass between the views: a view without any telling label learns from the other's sure ones."""
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 900)
    label = np.where(np.arange(900) < 300, y, -1).astype(np.int32)
    text = [[int(v), 2 + int(rng.integers(50))] for v in y]
    meta = [[int(v) if i >= 300 or i % 2 else 2 + int(rng.integers(50)), 2 + int(rng.integers(50))] for i, v in enumerate(y)]
    table = pa.table({"label": pa.array(label), **{f"{n}_index": pa.array(r, pa.list_(pa.int32())) for n, r in (("text", text), ("meta", meta))}, **{f"{n}_value": pa.array([[1.0, 0.3]] * 900, pa.list_(pa.float32())) for n in ("text", "meta")}})
    alone, together = (quality.co_train(table, rounds, 100) for rounds in (0, 3))
    gap = lambda m: m.weights["meta"][1] - m.weights["meta"][0]
    assert gap(together) > gap(alone)
    for m in (alone, together):
        views = {v: features.gathered(table, v) for v in ("text", "meta")}
        p_text, p_meta, p = quality.score(m, views)
        direct = [1 / (1 + np.exp(-np.clip(m.platt[v][0] * (np.array([[w[i] for i in r] for r in rows]) @ [1.0, 0.3] + w[-1]) + m.platt[v][1], -12, 12))) for v, rows, w in (("text", text, m.weights["text"]), ("meta", meta, m.weights["meta"]))]
        assert np.allclose(p_text, direct[0], atol=1e-4) and np.allclose(p_meta, direct[1], atol=1e-4) and ((p > 0.5) == y)[300:].mean() > 0.97


def test_repeated_labelled_rows(spark):
    """Of several texts of a labelled doc_id one stands, whatever the order of the rows."""
    rows, labels = labelled(120)
    again = rows + [(i, "zz other text " * 5, "en", "s0", 1) for i in range(0, 120, 2)] + rows[:10] + [(7, None, None, None, None), (8, "long " * 60_000, "en", "s1", 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = (sorted(map(str, score(spark.createDataFrame(r, DOCS).repartition(n), known).collect())) for r, n in ((again, 2), (again[::-1], 3)))
        assert a == b and len(a) == len(again)


def test_platt():
    rng = np.random.default_rng(0)
    y = (rng.random(800) < 0.4).astype(float)
    a, b = features.fit_platt(3 * (2 * y - 1) + 4 * rng.standard_normal(800), y)
    assert 0.2 < a < 0.7 and abs(features.sigmoid(np.array([a * 0 + b]))[0] - 0.4) < 0.1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert recompression.dedup_passages(none).count() == 0
    assert metric_join.jaccard_components(none).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_ids(spark):
    rows = [(1, "b" * 300, "x", "s", 1), (1, "a" * 200, "x", "s", 1), (None, "c", "x", "s", 1), (2, "a" * 150, "x", "s", 1)]
    got = {r.doc_id: r for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].n_bytes == 200 and got[2].n_removed == 150 and len(got) == 2
