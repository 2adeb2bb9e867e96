"""Vector codes against plain comparison with all entries."""

import hashlib

import numpy as np
import pytest

from cladeflow.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts, entries, rounds, scale=256):
    kept = sorted((i, [int(np.floor(float(x) * scale)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v))
    dim = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * dim : (p + 1) * dim]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    found = []
    for i, v, label in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
    total = {}
    for _, _, e, label in found:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[label], digest) for i, c, e, label in found)


def vectors(n, dim, seed, ties=False):
    rng = np.random.default_rng(seed)
    base = rng.integers(-2, 3, (n, dim)) / 256 if ties else rng.normal(size=(n, dim))
    out = [(int(7 * i - 50), [float(np.float32(x)) for x in base[i]], None if i % 5 == 0 else i % 3) for i in range(n)]
    out[3:3] = [(5000, None, 1), (5001, [], 1), (5002, [None] * dim, 2), (5003, [float("nan")] * dim, 2), (5004, [float("inf")] + [0.0] * (dim - 1), None), (5005, [0.0] * dim, 9)]
    return out


@pytest.mark.parametrize(("n", "ties"), [(150, False), (150, True), (20, False), (1, False)])
def test_codes_of_all_vectors(spark, n, ties):
    rows = vectors(n, 32, n, ties)
    got = codes.compress(spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows, 16, 64, 2)


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(5)
    for dim, spread in ((4, 3), (4, 1000), (48, 50), (1, 4)):
        book, parts = rng.integers(-spread, spread, (64, dim)), rng.integers(-spread, spread, (700, dim))
        book[40] = book[3]
        far = ((parts[:, None] - book[None]) ** 2).sum(2)
        index, best = codes.nearest(parts, book)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def test_huge_components_stay_whole_numbers(spark):
    rows = [(1, [3e38] * 16, 1, ""), (2, [-3e38] * 16, 1, ""), (3, [0.5] * 16, None, "")]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(rows, VECTORS), entries=2).collect()}
    assert got[2].error == 0 < got[1].error < 1 << 62 and got[3].error == got[3].label_error > 0  # the third goes with the first


def test_no_vectors_other_lengths_and_repeats(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, [0.0] * 15, 1, "")], VECTORS)).count() == 0
    rows = [(1, [0.1] * 16, 1, ""), (1, [0.1] * 16, 1, ""), (2, [0.2] * 32, 1, ""), (3, [0.3] * 7, 1, ""), (None, [0.3] * 16, 1, "")]
    got = codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert [(r.vec_id, r.error, r.label_error) for r in got] == [(1, 0, 0), (1, 0, 0)]


def test_decoding_is_near(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=32) * 0.01], 0, "") for i in range(400)]
    df = spark.createDataFrame(rows, VECTORS)
    books = codes.train(df)
    for r in codes.encode(df, books).where("vec_id < 50").collect():
        assert np.abs(codes.decode(r.code, books) - rows[r.vec_id][1]).mean() < 0.05
