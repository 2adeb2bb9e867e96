"""Places of labels, and batches that are written once."""

import itertools
import random

import pytest

from cladeflow.functions.labels import number_in
from cladeflow.operators import abundance


@pytest.mark.parametrize("top", [None, 1.5])
def test_no_two_labels_are_near(spark, top):
    rng = random.Random(3)
    rows = [("p", f"g{i:02d}", rng.choice([0.0, 1.0, 2.5, 7.0, 7.5]), round(rng.random(), 2)) for i in range(40)] + [("q", "a", 1.0, 0.3), ("q", "b", 5.0, 0.3)]
    df = spark.createDataFrame(rows, "population string, group_id string, x double, y double")
    got = {(r.population, r.group_id): r for r in abundance.label_places(df, 2.0, 0.05, top).collect()}
    again = {(r.population, r.group_id): r for r in abundance.label_places(df.repartition(5), 2.0, 0.05, top).collect()}
    assert got == again and len(got) == 42
    for a, b in itertools.combinations([r for k, r in got.items() if k[0] == "p"], 2):
        assert abs(a.x - b.x) > 2.0 - 1e-9 or abs(a.y - b.y) > 0.05 - 1e-9
    assert (got["q", "a"].x, got["q", "a"].y, got["q", "a"].moved, got["q", "b"].moved) == (1.0, 0.3, False, False)
    if top is not None:
        assert max(r.y for r in got.values()) <= top + 1e-9


def test_numbers_are_finite(spark):
    texts = {"26.1%": 26.1, "-3e2": -300.0, " .5 ": 0.5, "inf": None, "-Infinity": None, "NaN": None, "5d": 5.0, "1e999": 1.0, "7": 7.0, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", number_in(df.t).alias("n")).collect()} == texts
