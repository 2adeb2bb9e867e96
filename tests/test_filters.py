"""Genotype filters: pairs by joins against plain loops, and inference again of what lost something."""

import random

import pytest

from cladeflow.model import Options
from cladeflow.operators import detection
from cladeflow.plans import analysis

LONG = "population string, label string, t int, freq double"
D = 0.03


def plain(rows, frequencies, strict):
    """Backgrounds by name, genotypes by name: the first background of each invalid genotype."""
    series = {}
    for p, label, t, f in rows:
        series.setdefault(p, {}).setdefault(label, {})[t] = f
    out = set()
    for p, table in series.items():
        cutoff = next((c for c in sorted(frequencies, reverse=True) if any(max(s.values()) > c for s in table.values())), None)
        if cutoff is None:
            continue
        backgrounds = sorted(k for k, s in table.items() if max(s.values()) > cutoff)
        least = lambda s, c: min((f, t) for t, f in s.items() if f > c)
        for k, s in table.items():
            if k in backgrounds:
                continue
            seen = sorted(t for t, f in s.items() if f > D)
            for b in backgrounds:
                if len(seen) < 2:
                    out.add((p, k, b, "notEnoughTimepoints"))
                    break
                (_, first), (value, fixed) = least(table[b], D), least(table[b], cutoff)
                if seen[0] < first < seen[-1] and seen[0] < fixed < seen[-1] and (strict or (s.get(fixed, 0) > D and s.get(fixed, 0) + value > 1 + D)):
                    out.add((p, k, b, "presentBeforeAndAfterFixedGenotype"))
                    break
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_invalid_genotypes(spark, strict):
    rng = random.Random(7)
    rows = []
    for p in "pqr":
        for i in range(40):
            top = rng.choice([0.02, 0.4, 0.8, 1.0])
            rows += [(p, f"g{i:02d}", t, round(rng.choice([0, rng.random(), 1]) * top, 2)) for t in range(9)]
    rows += [("s", "only", 0, 0.0), ("s", "only", 1, 0.0)]
    got = detection.invalid_genotypes(spark.createDataFrame(rows, LONG), [0.9, 0.6, 0.3, 0.0], D, strict)
    want = plain(rows, [0.9, 0.6, 0.3, 0.0], strict)
    assert {(r.population, r.label, r.background, r.reason) for r in got.collect()} == want and len(want) > 30


def test_only_what_lost_something_is_clustered_again(spark):
    series = {"bg": [0, 0.1, 0.5, 1, 1, 1], "bad": [0.2, 0.3, 0.3, 0.35, 0.3, 0.3], "worse": [0.4, 0.5, 0.6, 0.6, 0.5, 0.5], "fine": [0, 0, 0, 0, 0.1, 0.2], "late": [0, 0, 0.1, 0.2, 0.4, 0.3]}
    rows = [(p, k, t, float(f)) for p, names in (("p", ("bg", "bad", "worse", "fine", "late")), ("q", ("bg", "fine", "late")), ("r", ("bg", "bad", "fine"))) for k in names for t, f in enumerate(series[k])]
    found = analysis.infer_genotypes(spark.createDataFrame(rows, LONG), Options(filter_genotypes=True, similarity_cutoff=0.001))
    left = {(r.population, r.label) for r in found.members.collect()}
    assert left == {("p", "bg"), ("p", "fine"), ("p", "late"), ("q", "bg"), ("q", "fine"), ("q", "late"), ("r", "bg"), ("r", "fine")}
    assert found.again == (2, 1)  # p and r lose one each, then p another; q is done at once
    assert {r.population for r in found.linkage.collect()} == {"p", "q", "r"} and found.ranks.count() == 8
