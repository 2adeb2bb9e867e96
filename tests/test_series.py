"""Series operators against small known cases."""

import math

import pytest
import numpy as np
from pyspark.sql import functions as F

from cladeflow.functions import labels as L
from cladeflow.functions import matrices as M
from cladeflow.functions import series as S
from cladeflow.model import Options, parse_frequencies
from cladeflow.operators import abundance, annotations, clustering, detection, distances, packing, ranking, scoring, trees
from cladeflow.plans import analysis, cli
from cladeflow.sources import sinks, tables

# fixed values: a measured table of 18 series and the results known for it
TRAVERSE = """
Trajectory,0,30,45,60,90
M1,0.0,0.369,0.3,0.1,0.05
M10,0.0,0.0,0.0,0.0,0.266
M11,0.0,0.0,0.0,0.0,0.247
M12,0.0,0.0,0.0,0.0,0.224
M13,0.0,0.0,0.0,0.0,0.01
M14,0.0,0.01,0.25,0.03,0.045
M15,0.0,0.155,0.0,0.0,0.0
M16,0.0,0.063,0.0,0.0,0.01
M17,0.0,0.123,0.0,0.0,0.0
M18,0.0,0.0,0.23,0.03,0.03
M2,0.0,0.3,0.2625,0.09,0.04
M3,0.0,0.167,0.55,0.91,0.972
M4,0.0,0.11363636,0.45,0.735,0.86
M5,0.0,0.08,0.475,0.625,0.848
M6,0.0,0.02,0.265,0.9,0.97
M7,0.0,0.0,0.15,0.836,0.945
M8,0.0,0.0,0.0,0.0,0.11
M9,0.0,0.0,0.0,0.0,0.315
"""
# genotypes in their order, the members' first values, and the parents, for quantiles 0.10 and 0.05
ORDER_10 = ["genotype-6", "genotype-8", "genotype-7", "genotype-1", "genotype-4", "genotype-2", "genotype-5", "genotype-9", "genotype-3"]
PARENTS_10 = {"genotype-6": "genotype-0", "genotype-8": "genotype-6", "genotype-7": "genotype-6", "genotype-1": "genotype-0", "genotype-4": "genotype-1", "genotype-2": "genotype-8", "genotype-5": "genotype-0", "genotype-9": "genotype-6", "genotype-3": "genotype-0"}
ORDER_05 = [7, 10, 11, 8, 9, 1, 13, 4, 2, 5, 12, 6, 3]
PARENTS_05 = {7: 0, 10: 7, 11: 10, 8: 7, 9: 8, 1: 0, 13: 11, 4: 1, 2: 11, 5: 0, 12: 10, 6: 0, 3: 0}


@pytest.fixture(scope="module")
def traverse(spark):
    return tables.parse_series(tables.text_wide(spark, TRAVERSE))[0].persist()


def pair(spark, left, right):
    return spark.createDataFrame([([float(x) for x in left], [float(x) for x in right])], "l array<double>, r array<double>")


def value(spark, left, right, f):
    return pair(spark, left, right).select(f(F.col("l"), F.col("r")).alias("v")).first().v


def test_distances(spark, traverse):
    found = {(r.a, r.b): r.distance for r in distances.fill_missing(distances.distances(traverse)).collect()}
    assert len(found) == 18 * 17 // 2
    assert found["M1", "M10"] == pytest.approx(1.028616710662193, abs=1e-12)
    assert found["M1", "M2"] == pytest.approx(0.12020846598096009, abs=1e-12)
    assert found["M10", "M11"] == pytest.approx(0.03076482379152546, abs=1e-12)
    assert found["M1", "M6"] == pytest.approx(1.6049723525293458, abs=1e-12)


@pytest.mark.parametrize(("quantile", "cutoff", "n"), [(0.05, 0.1239306, 13), (0.10, 0.2551142, 9)])
def test_clusters(traverse, quantile, cutoff, n):
    found = distances.fill_missing(distances.distances(traverse)).persist()
    limit = distances.similarity_cutoff(found, quantile)
    assert limit.first().cutoff == pytest.approx(cutoff, abs=1e-6)
    assert clustering.cluster(found, limit).select("genotype").distinct().count() == n
    last = clustering.linkage(found).orderBy(F.desc("cluster_id")).first()
    assert (last.left, last.right, last.observations, last.cluster_id) == (31, 33, 18, 34)
    assert last.distance == pytest.approx(4.307956909066134, abs=1e-9)


def test_analysis(traverse):
    for quantile, order, parents in ((0.10, ORDER_10, PARENTS_10), (0.05, [f"genotype-{i}" for i in ORDER_05], {f"genotype-{k}": f"genotype-{v}" for k, v in PARENTS_05.items()})):
        result = analysis.analyse(traverse, Options(quantile=quantile))
        assert [r.label for r in result.genotypes.ranks.orderBy("rank").collect()] == order
        assert {r.identity: r.parent for r in result.edges.collect()} == parents
    rows = {(r.nested, r.unnested): r for r in analysis.analyse(traverse, Options(quantile=0.10)).scores.collect()}
    assert len(rows) == 36
    r = rows["genotype-6", "genotype-8"]
    assert (r.score_area, r.score_derivative, r.score_fixed, r.score_greater, r.total_score) == (2, 2, 1, 1, 6)
    r = rows["genotype-1", "genotype-4"]
    assert (r.score_area, r.score_derivative, r.score_fixed, r.score_greater, r.total_score) == (0, 2, 0, 1, 3)


LANG = """
Genotype,0,140,240,335,415,505,585,665,745,825,910,1000
genotype-red,0,0.11,0.33,0.54,0.38,0.23,0.25,0.43,0.75,0.94,0.95,0.93
genotype-green,0,0,0,0.03,0.29,0.32,0.33,0.48,0.76,0.88,0.93,0.97
genotype-sienna,0,0,0,0,0,0,0.08,0.39,0.75,0.98,0.91,0.96
genotype-aqua,0,0,0.01,0.11,0.41,0.56,0.49,0.29,0.19,0.06,0.04,0.04
genotype-gold,0,0,0,0,0,0,0,0.03,0.1,0.21,0.39,0.56
genotype-orange,0,0.02,0.17,0.33,0.11,0.02,0.05,0.04,0.06,0,0,0
"""


def test_given_genotypes(spark):
    long, _ = tables.parse_genotypes(tables.text_wide(spark, LANG))
    result = analysis.analyse(long, is_genotype=True)
    assert {r.identity.split("-")[1]: r.parent.split("-")[1] for r in result.edges.collect()} == {"red": "0", "orange": "red", "aqua": "0", "sienna": "green", "green": "red", "gold": "sienna"}
    stacked = result.stacked.collect()
    assert len({(r.group_id, r.generation) for r in stacked}) == len(stacked)
    for gen in {r.generation for r in stacked}:
        assert sum(r.frequency for r in stacked if r.generation == gen) == pytest.approx(1)


GREATER = [([0, 0.1, 0.1, 0.2], [0, 0, 0, 0.5], 0), ([0.5, 0.5, 0.6], [0.1, 0.1, 0.1], 1), ([0.1, 0.1, 0.1], [0.5, 0.5, 0.6], -1), ([0.2, 0, 0], [0, 0, 0.2], -1)]
FIXED = [
    ([0, 0.1, 0.1, 0.2, 0.2, 0.3, 0.3], [0, 0.1, 0.1, 0.2, 0.2, 0.3, 0.3], 0), ([0, 0, 0, 0.403, 0.489, 0.057, 0.08], [0, 0, 0, 0, 0, 0.2675, 0.326], 0),
    ([0, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1], [0, 0, 0, 0, 0, 0.94, 0.94], 1), ([0, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1], [0, 0.9, 0.9, 1.0, 0.5, 0.93, 0.9], 0),
    ([0, 0.1, 0.2, 0.3, 0.3, 0.2, 0.1], [0, 0.9, 0.9, 1.0, 0.5, 0.93, 0.9], 1), ([0, 0.1, 0.1, 0.3, 0.5, 0.5, 0.2], [0.2, 0.9, 0.85, 0.9, 0.95, 1.0, 0.9], 1),
    ([0, 0.5, 0.5, 0.403, 0.489, 0.05, 0.05], [0, 0.7, 0.7, 0.7, 0.7, 0.7, 0.7], 0),
]


@pytest.mark.parametrize(("left", "right", "expected"), GREATER)
def test_score_greater(spark, left, right, expected):
    assert scoring.scored(pair(spark, left, right)).first().score_greater == expected


@pytest.mark.parametrize(("left", "right", "expected"), FIXED)
def test_score_fixed(spark, left, right, expected):
    assert scoring.scored(pair(spark, left, right)).first().score_fixed == expected


def one(f, l, r, *more, **options):
    l, r = (np.array([x], float) for x in (l, r))
    return f(l, r, np.ones(l.shape, bool), *more, **options)[0]


def test_metrics():
    l, r = [0.1, 0.4, 0.9], [0.2, 0.2, 0.7]
    assert one(M.minkowski, l, r) == pytest.approx(0.3)
    n, ml, mr = 3, sum(l) / 3, sum(r) / 3
    c = sum((a - ml) * (b - mr) for a, b in zip(l, r)) / math.sqrt(sum((a - ml) ** 2 for a in l) * sum((b - mr) ** 2 for b in r))
    assert one(M.pearson, l, r, adjusted=False) == pytest.approx(1 - c)
    assert one(M.pearson, l, r) == pytest.approx(1 - c * (1 + (1 - c * c) / (2 * n)))
    b = one(M.binomial, l, r)
    assert one(M.binomial_probability, l, r) == pytest.approx(math.erf(b))
    assert one(M.combined, l, r) == pytest.approx(2 * one(M.pearson, l, r) + one(M.minkowski, l, r))
    assert math.isnan(one(M.binomial, [], [])) and math.isnan(one(M.pearson, [0.5, 0.5], [0.1, 0.4])) and math.isnan(one(M.binomial, [1, 1], [1, 1]))
    for name, f in M.METRICS.items():  # a mask counts its points alone
        far = np.array([[9.0, *l, 7.0]]), np.array([[3.0, *r, 0.0]])
        assert f(*far, np.array([[False, True, True, True, False]]))[0] == pytest.approx(one(f, l, r)), name
    with pytest.raises(ValueError, match="not a metric"):
        M.metric("other")


def test_areas(spark):
    l, r = [0.2, 0.8, 0.2], [0.5, 0.5, 0.5]
    assert value(spark, l, r, lambda x, y: S.area(x)) == pytest.approx(1.0)
    rows = lambda *x: [np.array([v], float) for v in x]
    common = lambda l, r: M.curves_area(*(M.curve(x) for x in rows(l, r)))[0]
    assert common(l, r) == pytest.approx(2 * (0.5 * 0.35 + 0.5 * 0.5)) and M.trapezoid(M.curve(*rows(l)))[0] == pytest.approx(1.0)
    assert one(M.jaccard, [0.1, 0.1], [0.4, 0.4]) == pytest.approx(0.75)
    assert M.contains(*rows([0.4, 0.4], [0.1, 0.1]))[0] and not M.contains(*rows([0.1, 0.1], [0.4, 0.4]))[0]
    assert common([0.3], [0.3]) == 0 and common([], []) == 0


def test_uneven_series(spark):
    """Series of other lengths are compared with 0 where they lack points."""
    rows = spark.createDataFrame([([0.1, 0.5, 0.6], [0.1, 0.2]), ([0.1], [0.3, 0.4, 0.2]), ([], [])], "l array<double>, r array<double>")
    full = spark.createDataFrame([([0.1, 0.5, 0.6], [0.1, 0.2, 0.0]), ([0.1, 0.0, 0.0], [0.3, 0.4, 0.2]), ([0.0] * 3, [0.0] * 3)], "l array<double>, r array<double>")
    plain = lambda df: [tuple(r)[2:] for r in scoring.scored(df).collect()]
    assert plain(rows) == plain(full)


def test_valid_range(spark):
    cut = lambda **k: lambda x, y: S.cut(x, S.valid_range(x, y, 0.03, **k))
    l, r = [0, 0.1, 0, 0.99, 0.2, 0], [0, 0, 0, 0, 0.01, 0]
    assert value(spark, l, r, cut()) == [0.1, 0, 0.99, 0.2]
    assert value(spark, [0.99, 0.5, 0.98], [0, 0, 0], cut(masked=True)) == [0.5]
    assert value(spark, [0.99, 0.5, 0.98], [0.5, 0.5, 0], cut(inner=True)) == [0.99, 0.5]
    assert value(spark, [0, 0], [0, 0.01], cut()) == []


def test_import(spark):
    wide = tables.text_wide(spark, "Trajectory\tGene\tX0\t 17 \t25\nA\tdltB\t0%\t26.1%\t100%\nB\tx\t0\t0\t0\nC\ty\t1%\t\t50%")
    long, info = tables.parse_series(wide)
    got = {(r.label, r.t): r.freq for r in long.collect()}
    assert got == {("A", 0): 0, ("A", 17): 0.261, ("A", 25): 1, ("C", 0): 1, ("C", 17): 0, ("C", 25): 0.5}
    assert info.columns == ["population", "label", "gene"] and info.count() == 3
    with pytest.raises(ValueError, match="time"):
        tables.parse_series(tables.text_wide(spark, "a,b\n1,2"))
    with pytest.raises(ValueError, match="xls form"):
        tables.read_wide(spark, "x.xls")


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text(TRAVERSE.strip())
    written = analysis.run(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    edges = tables.text_wide(spark, "Identity,Parent\n" + "\n".join(f"{r.identity},{r.parent}" for r in spark.read.csv(written["edges"], header=True, sep="\t").collect()))
    assert edges.count() == 13 and set(written) >= {"distances", "linkage", "stacked", "populations", "lineage_dot"}
    (tmp_path / "map.tsv").write_text("a\tb\nc\td\na\te\n")
    assert {r.key: r.value for r in tables.read_map(spark, str(tmp_path / "map.tsv")).collect()} == {"a": "e", "c": "d"}
    (tmp_path / "known.txt").write_text("A,B\nC\n\n")
    assert sorted(r.label for r in tables.read_known_genotypes(spark, str(tmp_path / "known.txt")).collect()) == ["A", "B", "C"]
    (tmp_path / "square.tsv").write_text("\tA\tB\tC\nA\t0\t1\t2\nB\t1\t0\t3\nC\t2\t3\t0\n")
    assert sorted((r.a, r.b, r.distance) for r in tables.read_distances(spark, str(tmp_path / "square.tsv")).collect()) == [("A", "B", 1), ("A", "C", 2), ("B", "C", 3)]
    with pytest.raises(ValueError, match="format"):
        sinks.write_table(edges, str(tmp_path), "edges", "xml")


def test_cli(spark, tmp_path):
    """Distances, aliases, colors, annotations, options and the script, from the command line."""
    lines = TRAVERSE.strip().splitlines()
    head, *rows = (x.split(",") for x in lines)
    wide = [[head[0], "Gene", "Annotation", *head[1:]]] + [[r[0], f"gene{i % 3}<", f"N{i}(x)", *r[1:]] for i, r in enumerate(rows)]
    (tmp_path / "t.tsv").write_text("\n".join("\t".join(r) for r in wide))
    cli.main(["lineage", "--input", str(tmp_path / "t.tsv"), "--output", str(tmp_path / "first"), "--disable-all-filters"])
    read = lambda out, name: spark.read.csv(f"{tmp_path}/{out}/{sinks.TABLES[name]}/{name}", header=True, sep="\t").collect()
    pairs = read("first", "distances")
    assert len(pairs) == 153
    (tmp_path / "pairs.tsv").write_text("\n".join(f"{r.a}\t{r.b}\t{r.distance}" for r in pairs))
    (tmp_path / "alias.tsv").write_text("gene0\tother\n")
    (tmp_path / "colors.tsv").write_text("genotype-1\t#123456\n")
    (tmp_path / "notes.tsv").write_text("gene1 N1\t#654321\n")
    files = {"--filename-pairwise": "pairs.tsv", "--gene-alias": "alias.tsv", "--genotype-colors": "colors.tsv", "--annotation-colors": "notes.tsv"}
    cli.main(["lineage", "--input", str(tmp_path / "t.tsv"), "--output", str(tmp_path / "again"), "--palette", "distinct", "--name", "drawn", "--disable-all-filters", *(x for k, v in files.items() for x in (k, str(tmp_path / v)))])
    assert {(r.identity, r.parent) for r in read("first", "edges")} == {(r.identity, r.parent) for r in read("again", "edges")}
    members = {x: r.genotype for r in read("again", "members") for x in r.members.split("|")}
    notes = {r.genotype: r.annotations for r in read("again", "annotations")}
    assert "other N0" in notes[members["M1"]] and "gene1 N1" in notes[members["M10"]]
    colors = {r.identity: r.color for r in read("again", "palette")}
    assert colors["genotype-1"] == "#123456" and "#654321" in colors.values()
    text = lambda out, name: "\n".join(r.value for r in spark.read.text(f"{tmp_path}/{out}/{sinks.TABLES[name]}/{name}").collect())
    assert '"name": "drawn"' in text("again", "options") and "drawn.png" in text("again", "script") and "#123456" in text("again", "script")
    assert {r.color for r in read("again", "series")} <= set(colors.values()) and read("again", "label_anchors") and read("again", "smooth")
    cli.main(["lineage", "--input", str(tmp_path / "t.tsv"), "--output", str(tmp_path / "filtered"), "--palette", "Blues"])
    assert len(read("filtered", "distances")) == 28 and len(read("filtered", "label_places")) > 0  # eight series pass the filters that are on by default


def test_alone_and_validation(spark):
    """A population of one series is its own genotype; input that is not as it must be is refused."""
    kinds = "population string, label string, t int, freq double"
    rows = [("alone", "A", t, f) for t, f in enumerate([0.0, 0.3, 0.9])] + [("pair", x, t, f) for x, fs in (("B", [0.0, 0.2, 0.8]), ("C", [0.0, 0.4, 0.1])) for t, f in enumerate(fs)]
    result = analysis.analyse(spark.createDataFrame(rows, kinds))
    assert {(r.population, r.label) for r in result.genotypes.members.collect()} == {("alone", "A"), ("pair", "B"), ("pair", "C")}
    assert {(r.population, r.identity, r.parent) for r in result.edges.collect() if r.population == "alone"} == {("alone", "genotype-1", "genotype-0")}
    for bad, what in (([("p", "A", 0, 1.5)], "frequency"), ([("p", "A", 0, None)], "frequency"), ([("p", "A", 0, 0.1), ("p", "A", 0, 0.2)], "two points")):
        with pytest.raises(ValueError, match=what):
            analysis.analyse(spark.createDataFrame(bad, kinds))
    ring = spark.createDataFrame([("p", "a", "c"), ("p", "b", "a"), ("p", "c", "b")], "population string, identity string, parent string")
    for walk in (tables.validate_edges, trees.ancestors, trees.clades):
        with pytest.raises(ValueError, match="cycle"):
            walk(ring)


def test_numbers(spark):
    cells = ["1e-05", "-0.02", "26.1%", " 3 ", "", "none", "about 7.5 of", "NaN", "+4", None, "1.5E3"]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", L.number_in(F.col("c")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [1e-05, -0.02, 26.1, 3, None, None, 7.5, None, 4, None, 1500]
    long, _ = tables.parse_series(tables.text_wide(spark, "Trajectory,0,1\nA,1e-05,-0.02\nB,0.5,1"))
    assert {(r.label, r.t): r.freq for r in long.collect()} == {("A", 0): 1e-05, ("A", 1): 0, ("B", 0): 0.5, ("B", 1): 1}


def test_places(spark):
    rows = spark.createDataFrame([("p", i % 4, i) for i in range(50)] + [("q", 1, 7)], "population string, g int, v int").repartition(5)
    got = packing.placed(rows, ["g"], ["v"], "at").collect()
    assert [(r.g, r.v) for r in sorted(got, key=lambda r: r["at"]) if r.population == "p"] == sorted((i % 4, i) for i in range(50)) and [r["at"] for r in got if r.population == "q"] == [1]
    wide = spark.range(1000, numPartitions=7)
    assert [(r.id + 1) for r in packing.numbered(wide, "n").collect()] == [r.n for r in packing.numbered(wide, "n").collect()]


def test_filters(spark):
    rows = [("A", 0, 0.0), ("A", 1, 0.5), ("A", 2, 0.0), ("B", 0, 0.99), ("B", 1, 0.5), ("B", 2, 0.2), ("C", 0, 0.5), ("C", 1, 0.52), ("C", 2, 0.5), ("E", 0, 0.0), ("E", 1, 0.3), ("E", 2, 0.9)]
    long = spark.createDataFrame([("p", *r) for r in rows], "population string, label string, t int, freq double")
    assert {r.label: r.reason for r in detection.trajectory_reasons(long).collect()} == {"A": "onlyDetectedOnce", "B": "startedFixed", "C": "isConstant", "E": "passed"}
    assert {r.label for r in detection.filter_trajectories(long).collect()} == {"E"}
    assert {r.label for r in detection.fuzzy_backgrounds(long, [0.95, 0.6]).collect()} == {"B"}


def test_invalid(spark):
    rows = {"bg": [0, 0.2, 0.99, 1.0, 1.0], "bad": [0.3, 0.3, 0.3, 0.3, 0.2], "gone": [0.3, 0.2, 0, 0, 0], "once": [0, 0, 0.2, 0, 0]}
    long = spark.createDataFrame([("p", k, t, float(x)) for k, v in rows.items() for t, x in enumerate(v)], "population string, label string, t int, freq double")
    assert {r.label: r.reason for r in detection.invalid_genotypes(long, [0.9, 0.6, 0.3, 0.0]).collect()} == {"bad": "presentBeforeAndAfterFixedGenotype", "once": "notEnoughTimepoints"}


EDGES = [("a", "genotype-0"), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "genotype-0")]


def test_trees(spark):
    edges = spark.createDataFrame([("p", *e) for e in EDGES], "population string, identity string, parent string")
    assert {(r.identity, r.ancestor) for r in trees.ancestors(edges).collect() if r.identity == "d"} == {("d", "b"), ("d", "a"), ("d", "genotype-0")}
    assert {r.identity: (r.clade, r.iterations) for r in trees.clades(edges).collect()} == {"a": ("a", 1), "b": ("a", 2), "c": ("a", 2), "d": ("a", 3), "e": ("e", 1)}
    ages = spark.createDataFrame([("p", x, i) for i, x in enumerate(["genotype-0", "a", "b", "c", "d", "e"], 1)], "population string, identity string, age int")
    assert [r.group_id for r in trees.tour(edges, ages).orderBy("ord").collect()] == ["genotype-0", "e", "ea", "a", "c", "ca", "b", "d", "da", "ba", "aa", "genotype-0a"]
    deep = spark.createDataFrame([("p", f"n{i}", f"n{i - 1}" if i else "genotype-0") for i in range(105)], "population string, identity string, parent string")
    assert trees.clades(deep).agg(F.max("iterations")).first()[0] == 105
    noted = spark.createDataFrame([("p", k, i, v) for i, (k, v) in enumerate({"g10": ["dltB "], "g11": ["dltB Q111*"], "g16": ["P|Q "], "g6": ["S G119C"], "g9": ["dltB "], "bare": []}.items())], "population string, identity string, place int, annotations array<string>")
    found = {}
    for r in trees.group_clades(noted).collect():
        found.setdefault(r.opener, set()).add(r.identity)
    assert found == {"g10": {"g10", "g11", "g9"}, "g16": {"g16"}, "g6": {"g6"}}
    tables.validate_edges(edges)
    with pytest.raises(ValueError, match="two parents"):
        tables.validate_edges(edges.union(edges.limit(1)))


def test_stacked(spark):
    pops = {"genotype-0": [100, 50, 20], "a": [0, 50, 60], "b": [0, 0, 20]}
    table = spark.createDataFrame([("p", 10 * g, k, float(x)) for k, v in pops.items() for g, x in enumerate(v)], "population string, generation int, identity string, abundance double")
    edges = spark.createDataFrame([("p", "a", "genotype-0"), ("p", "b", "a")], "population string, identity string, parent string")
    got = abundance.stacked_area(table, edges).orderBy("ord").collect()
    assert len(got) == 2 * 3 * 5
    assert [r.unique_id for r in got[:6]] == ["genotype-0_0", "a_0", "b_0", "ba_0", "aa_0", "genotype-0a_0"]
    mids = {(r.generation, r.identity): 2 * r.abundance for r in got if r.generation in (5.0, 15.0)}
    assert mids == {(5.0, "genotype-0"): 75, (5.0, "a"): 0, (5.0, "b"): 0, (15.0, "genotype-0"): 35, (15.0, "a"): 55, (15.0, "b"): 0}
    merged = abundance.merge_halves(abundance.stacked_area(table, edges))
    assert {r.group_id for r in merged.collect()} == {"genotype-0", "genotype-0a", "a", "aa", "b"}


def test_labels(spark):
    rows = spark.createDataFrame([("dltB<", "Q111*(CAA)", "#FF0000"), ("PR_1/>PR_2", "intergenic (-1)", "#000000"), ("<x", "del 5", "#FFFFFF"), (None, None, None), ("", "(a)", "#00FF00")], "g string, a string, c string")
    got = rows.select(L.clean_gene(F.col("g")).alias("g"), L.clean_annotation(F.col("a")).alias("a"), F.round(L.luminance(F.col("c")), 3).alias("l")).collect()
    assert [tuple(r) for r in got] == [("dltB", "Q111*", 0.299), ("PR_1|PR_2", "intergenic", 0.0), ("", "del", 1.0), ("", "", None), ("", "(a)", 0.587)]


def test_annotations(spark):
    info = spark.createDataFrame([("p", "A", "dltB", "Q1(x)"), ("p", "B", "", ""), ("p", "C", "old", "")], "population string, label string, Gene string, Annotation string")
    members = spark.createDataFrame([("p", "g1", "A"), ("p", "g1", "B"), ("p", "g2", "C")], "population string, genotype string, label string")
    alias = spark.createDataFrame([("old", "new")], "key string, value string")
    found = annotations.genotype_annotations(members, annotations.label_annotations(info, alias))
    assert {r.genotype: r.annotations for r in found.collect()} == {"g1": ["dltB Q1"], "g2": ["new"]}
    assert annotations.find_annotation(found, "mew").first().annotation == "new"
    edges = spark.createDataFrame([("p", "g1", "genotype-0"), ("p", "g2", "g1")], "population string, identity string, parent string")
    palette = annotations.distinct_palette(edges.select("population", "identity"), spark.createDataFrame([("g2", "#123456")], "identity string, color string"))
    assert {r.identity: r.color for r in palette.collect()}["g2"] == "#123456"
    assert '"g1" -> "g2";' in annotations.dot_graph(edges, palette).first().dot


def test_options():
    assert parse_frequencies("0.3") == [0.9, 0.6, 0.3, 0.0] and parse_frequencies(".2,.4,.7") == [0.7, 0.4, 0.2, 0.0]
    args = cli.parser().parse_args(["lineage", "--input", "a", "--output", "b", "--detection", "0.05", "--fixed", "1"])
    assert cli.options_of(args).flimit == pytest.approx(0.95)
    assert Options().flimit == pytest.approx(0.97) and packing.pair_count(5) == 10


def test_ranking_ties_and_zeros(spark):
    rows = {"early": [0, 0.5, 1.0], "late": [0, 0.1, 1.0], "zero": [0, 0, 0], "start": [0.9, 0.2, 0.1]}
    long = spark.createDataFrame([("p", k, t, float(x)) for k, v in rows.items() for t, x in enumerate(v)], "population string, label string, t int, freq double")
    assert [r.label for r in ranking.rank_genotypes(long).orderBy("rank").collect()] == ["early", "late", "start"]


def test_known(spark, traverse):
    found = analysis.infer_genotypes(traverse, Options(known_genotypes=[["M1", "M9"]]))
    groups = {r.label: r.genotype for r in found.members.collect()}
    assert groups["M1"] == groups["M9"]
    _, edges = analysis.infer_lineage(found, Options(known_ancestry={groups["M4"]: groups["M16"]}))
    parents = {r.identity: r.parent for r in edges.collect()}
    assert parents[groups["M4"]] == groups["M16"] and parents[groups["M16"]] == "genotype-0"


def test_stream(spark, tmp_path):
    from cladeflow.streaming import arrivals

    schema = "population string, label string, t int, freq double, at timestamp"
    rows = spark.sql("SELECT 'p' AS population, 'A' AS label, cast(id % 3 AS int) AS t, cast(0.5 AS double) AS freq, timestamp'2024-01-01' AS at FROM range(6)")
    rows.write.json(str(tmp_path / "in"))
    seen = []
    q = arrivals.into_table(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "c"), lambda df: seen.append(df.count()))
    q.awaitTermination(120)
    assert seen[-1] == 3


def test_names_by_color(spark):
    members = spark.createDataFrame([("p", "genotype-1", "trajectory-red-1"), ("p", "genotype-1", "trajectory-red-2"), ("p", "genotype-2", "trajectory-red-3"), ("p", "genotype-2", "x")], "population string, genotype string, label string")
    assert {r.label: r.genotype for r in clustering.named_by_color(members).collect()} == {"trajectory-red-1": "genotype-red", "trajectory-red-2": "genotype-red", "trajectory-red-3": "genotype-2", "x": "genotype-2"}


def test_criteria():
    merges = [(0, 1, 1.0, 2), (2, 3, 1.1, 2), (4, 5, 9.0, 4)]
    assert len(set(clustering.flat_clusters(merges, 4, 1.05))) == 3
    assert len(set(clustering.flat_clusters(merges, 4, 0.5, "inconsistent"))) == 2
    assert len(set(clustering.flat_clusters(merges, 4, 2.0, "monocrit"))) == 1
    with pytest.raises(ValueError, match="criterion"):
        clustering.flat_clusters(merges, 4, 1, "other")
