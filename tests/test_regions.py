"""Pieces between gaps, region overlays, ranks of skewed values and greedy groups against plain Python."""

import random

import numpy as np
import pytest

from cladeflow.functions import series as S
from cladeflow.operators import distances, regions, trees

PACKED = "population string, label string, fs array<double>"


def outline(points):
    """Pieces of a list of points by the recursive rule."""
    if len(points) < 3:
        return []
    for i in range(1, len(points)):
        if points[i - 1][1] == 0 and points[i][1] == 0:
            return outline(points[:i]) + outline(points[i:])
    return [points]


@pytest.mark.parametrize("values", [[0, 1, 0, 0, 0.1, 0], [0, 1, 0], [0.1, 0.2, 0.3, 0.4], [0, 0, 0, 0], [0.5], [0.97, 0.0, 0.97, 0, 0, 0.2, 0.1, 0.2, 0, 0, 0, 1, 1]])
def test_pieces(spark, values):
    df = spark.createDataFrame([("p", "x", [float(v) for v in values])], PACKED)
    got = {}
    for r in regions.pieces(regions.vertices(df, raised=False)).orderBy("i").collect():
        got.setdefault((r.piece, r.main), []).append((r.x, r.y))
    points = ([(0, 0)] if values[0] else []) + list(enumerate(values)) + ([(len(values) - 1, 0)] if values[-1] else [])
    want = outline([(float(x), float(y)) for x, y in points])
    assert [v for _, v in sorted(got.items())] == want
    area = [sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:])) for p in want]
    assert [m for (_, m) in sorted(got)] == [k == area.index(max(area)) for k in range(len(area))]


def test_raised_outline_and_bridges(spark):
    df = spark.createDataFrame([("p", "x", [0.0, 1.0, 0.0, 0.0, 0.1, 0.0])], PACKED)
    assert [(r.x, r.y) for r in regions.vertices(df).orderBy("i").collect()] == [(0, 0), (1, 1), (2, S.SLIVER), (3, S.SLIVER), (4, 0.1), (5, 0)]
    df = spark.createDataFrame([("p", "x", [0.97, 0.0, 0.97, 0.97, 0.0, 0.0, 0.97, 0.0])], PACKED)
    assert df.select(regions.bridged(df.fs).alias("b")).first().b == [0.97, 0.001, 0.97, 0.97, 0.0, 0.0, 0.97, 0.0]


def test_overlay_against_fine_sampling(spark):
    rng = np.random.default_rng(2)
    curves = {f"s{i}": [float(x) for x in rng.choice([0.0, 0.3, 0.6, 1.0], 7) + rng.random(7) * 0.01] for i in range(6)} | {"s9": [0.5] * 7, "t9": [0.5] * 7}
    df = spark.createDataFrame([("p", k, v) for k, v in curves.items()], PACKED)
    strips = regions.overlay(df)
    got = {(r.a, r.b): r for r in regions.region_areas(strips).collect()}
    x = np.linspace(0, 6, 600_001)
    for (a, b), r in got.items():
        f, g = (np.interp(x, range(7), curves[k]) for k in (a, b))
        for value, h in ((r.only_a, np.maximum(f - g, 0)), (r.only_b, np.maximum(g - f, 0)), (r.common, np.minimum(f, g)), (r.either, np.maximum(f, g)), (r.symmetric, abs(f - g))):
            assert value == pytest.approx(np.trapezoid(h, x), abs=1e-5)
    assert len(got) == 28 and all(r.upper == "=" and r.low0 == r.high0 for r in strips.where("a = 's9' AND b = 't9'").collect())
    assert all(r.x0 < r.x1 for r in strips.collect())


def test_quantile_with_an_outlier(spark):
    """One value a million times the rest: the bin that holds the ranks is cut until few values are left."""
    rng = random.Random(3)
    values = [rng.random() for _ in range(3000)] + [0.5] * 500 + [1e6, 2e6]
    df = spark.createDataFrame([("p", f"a{i}", "b", v) for i, v in enumerate(values)] + [("q", "a", "b", 1.0), ("q", "a", "c", 2.0), ("q", "b", "c", 3.0)], "population string, a string, b string, distance double")
    inner = sorted([v for v in values if v < 2e6] * 2)
    for quantile in (0.05, 0.5, 0.9):
        got = {r.population: r.cutoff for r in distances.similarity_cutoff(df, quantile, bins=16, few=20).collect()}
        assert got["p"] == pytest.approx(float(np.quantile(inner, quantile)), abs=1e-12) and got["q"] == pytest.approx(float(np.quantile([1, 1, 2, 2], quantile)))


def test_groups_by_rounds(spark):
    rng = random.Random(1)
    notes = {f"c{i:03d}": [" ".join(rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(rng.randint(0, 2)))] for i in range(60)}
    words = {k: {w for x in v for w in x.split(" ") if w} for k, v in notes.items()}
    want, seen = {}, set()
    for k, v in words.items():
        if k not in seen and v:
            want[k] = {o for o, w in words.items() if v & w}
            seen |= want[k]
    rows = [(p, k, i, v) for p in "pq" for i, (k, v) in enumerate(notes.items())]
    got = {}
    for r in trees.group_clades(spark.createDataFrame(rows, "population string, identity string, place int, annotations array<string>")).where("population = 'q'").collect():
        got.setdefault(r.opener, set()).add(r.identity)
    assert got == want


def test_groups_are_not_sorted_by_word(spark, monkeypatch):
    """A frequent word's clades must not come into one task's memory: no sort of all words, and a set number of tasks for the clades."""
    plans, kept = [], trees.settled
    monkeypatch.setattr(trees, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    notes = spark.range(3000).selectExpr("'p' AS population", "'c' || id AS identity", "id AS place", "array('w' || id % 7, 'v' || id % 5) AS annotations")
    found = trees.group_clades(notes)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == found.distinct().count() and {r.opener for r in found.select("opener").distinct().collect()} == {f"c{k}" for k in range(5)}
    assert not any("SortAggregate" in p and "explode" in p for p in plans) and not any("hashpartitioning" in line and "word" in line and "REPARTITION" in line for p in plans for line in p.splitlines())
    assert any("REPARTITION_BY_NUM" in line and "identity" in line for line in plans[-1].splitlines())
