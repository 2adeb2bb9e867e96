"""The whole analysis as one plan: series to genotypes, ranks, ancestry, abundances and the stacked-area table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROOT, ROOT_COLOR, Options
from ..operators import abundance, annotations, clustering, detection, distances, ranking, scoring, ward
from ..sources import sinks, tables
from .settle import settled


@dataclass
class Genotypes:
    """members: (population, genotype, label); series: long, labelled by genotype."""

    members: DataFrame
    series: DataFrame
    ranks: DataFrame
    distance: DataFrame | None = None
    linkage: DataFrame | None = None
    #: populations that were clustered again in each round of the genotype filter
    again: tuple[int, ...] = ()


@dataclass
class Analysis:
    genotypes: Genotypes
    scores: DataFrame
    edges: DataFrame
    populations: DataFrame
    stacked: DataFrame


def infer_genotypes(long: DataFrame, options: Options, distance: DataFrame | None = None) -> Genotypes:
    """Filter, compare, cluster and rank; what later steps use more than once is settled.

    distance: (population, a, b, distance) known from before; pairs of labels that are filtered out go."""
    spark = long.sparkSession
    if options.filter_single or options.filter_startfixed or options.filter_consistency > 0:
        long = detection.filter_trajectories(long, dlimit=options.dlimit, flimit=options.flimit, consistency=options.filter_consistency, single=options.filter_single, startfixed=options.filter_startfixed)
    if distance is None:
        distance = settled(distances.distances(long, options.metric, options.dlimit, options.flimit))
    else:
        distance = settled(distances.reduced(distance, long.select("population", "label").distinct()))
    found = settled(distances.fill_missing(distance))
    if options.known_genotypes:
        rows = [("all", f"known-{i}", x) for i, g in enumerate(options.known_genotypes) for x in g]
        found = distances.apply_known(found, spark.createDataFrame(rows, "population string, genotype string, label string"))
    if options.similarity_cutoff:
        cutoffs = found.select("population").distinct().withColumn("cutoff", F.lit(float(options.similarity_cutoff)))
    else:
        cutoffs = distances.similarity_cutoff(found, options.quantile)
    places = settled(ward.leaves(found))
    linkage = settled(ward.linkage_of(ward.merges(found, places), places))
    members = clustering.with_single(clustering.flat(linkage, places, cutoffs), long)
    members = settled(clustering.named_by_color(members) if options.color_names else members)
    series = settled(clustering.mean_genotypes(long, members))
    genotypes = Genotypes(members, series, settled(ranking.rank_genotypes(series, options.dlimit, options.slimit)), found, linkage)
    return _without_invalid(long, genotypes, options, distance) if options.filter_genotypes else genotypes


def _without_invalid(long: DataFrame, found: Genotypes, options: Options, distance: DataFrame) -> Genotypes:
    """Remove the members of each population's first invalid genotype and infer again, until none is left.

    Only the populations that lost something are clustered again, from the distances that stand; the others are done. A round removes a series at least."""
    again = replace(options, filter_genotypes=False, filter_single=False, filter_startfixed=False, filter_consistency=0.0)
    done, rounds = [], []
    while True:
        bad = detection.first_invalid(found.series, found.ranks, list(options.frequencies), options.dlimit, options.strict).withColumnRenamed("label", "genotype")
        gone = settled(found.members.join(bad, ["population", "genotype"], "left_semi").select("population", "label"))
        lost = settled(gone.select("population").distinct())
        done.append(_parts(found, lost, "left_anti") if rounds or not lost.isEmpty() else found)
        if lost.isEmpty():
            break
        rounds.append(lost.count())
        long = settled(long.join(lost, "population", "left_semi").join(gone, ["population", "label"], "left_anti"))
        distance = settled(distance.join(lost, "population", "left_semi"))
        found = infer_genotypes(long, again, distance)
    whole = [reduce(DataFrame.unionByName, parts) for parts in zip(*([g.members, g.series, g.ranks, g.distance, g.linkage] for g in done), strict=True)]
    return Genotypes(*map(settled, whole), again=tuple(rounds))


def _parts(found: Genotypes, populations: DataFrame, how: str) -> Genotypes:
    return Genotypes(*(x.join(populations, "population", how) for x in (found.members, found.series, found.ranks, found.distance, found.linkage)))


def given_genotypes(series: DataFrame, options: Options) -> Genotypes:
    """Series that are genotypes already: each its own member, named with the prefix genotype-."""
    name = F.when(F.col("label").startswith("genotype-"), F.col("label")).otherwise(F.concat(F.lit("genotype-"), F.col("label")))
    members = settled(series.select("population", "label").distinct().select("population", name.alias("genotype"), "label"))
    series = settled(series.withColumn("label", name))
    return Genotypes(members, series, settled(ranking.rank_genotypes(series, options.dlimit, options.slimit)))


def infer_lineage(genotypes: Genotypes, options: Options) -> tuple[DataFrame, DataFrame]:
    """(scores, edges)."""
    scores = settled(scoring.score_pairs(genotypes.series, genotypes.ranks, options.dlimit, options.flimit, options.pvalue, options.weights))
    known = None
    if options.known_ancestry:
        spark = scores.sparkSession
        known = spark.createDataFrame([("all", k, v) for k, v in options.known_ancestry.items()], "population string, identity string, parent string")
    return scores, scoring.resolve_edges(scoring.candidates(scores, known), genotypes.ranks)


def analyse(long: DataFrame, options: Options | None = None, is_genotype: bool = False, distance: DataFrame | None = None) -> Analysis:
    """The whole analysis of series that are as validate_series wants them; distance: known from before (see infer_genotypes)."""
    options = options or Options()
    long = tables.validate_series(long)
    genotypes = given_genotypes(long, options) if is_genotype else infer_genotypes(long, options, distance)
    scores, edges = infer_lineage(genotypes, options)
    edges = tables.validate_edges(settled(edges))
    populations = settled(abundance.population_table(genotypes.series, edges, options.dlimit))
    return Analysis(genotypes, scores, edges, populations, abundance.stacked_area(populations, edges))


def palette_of(result: Analysis, options: Options, genotype_annotations: DataFrame | None = None, colors: DataFrame | None = None, annotation_colors: DataFrame | None = None) -> DataFrame:
    """(population, identity, color): by lineage or of well distinguishable colors; colors of annotations and of genotypes (identity, color) go before."""
    identities = result.edges.select("population", "identity")
    if annotation_colors is not None and genotype_annotations is not None:
        own = annotations.annotation_palette(genotype_annotations, annotation_colors).where("color IS NOT NULL").select("identity", "color")
        colors = own if colors is None else colors.select("identity", "color").unionByName(own.join(colors, "identity", "left_anti"))
    if options.palette == "lineage":
        found = annotations.lineage_palette(result.edges, colors)
    else:
        found = annotations.distinct_palette(identities, colors) if options.palette == "distinct" else annotations.scheme_palette(identities, options.palette, colors)
    return found.unionByName(identities.select("population", F.lit(ROOT).alias("identity"), F.lit(ROOT_COLOR).alias("color")).distinct())


def save(result: Analysis, long: DataFrame, info: DataFrame, folder: str, options: Options, fmt: str = "tsv", aliases: DataFrame | None = None, colors: DataFrame | None = None, annotation_colors: DataFrame | None = None) -> dict[str, str]:
    """Write every table, with the options and a script that draws the stacked area; populations and edges only where there are none yet. Returns the paths.

    aliases: (key, value), other names of genes; colors: (identity, color); annotation_colors: (annotation, color)."""
    g = result.genotypes
    notes = annotations.genotype_annotations(g.members, annotations.label_annotations(info, aliases))
    palette = settled(palette_of(result, options, notes, colors, annotation_colors))
    members = clustering.member_lists(g.members)
    merged = settled(abundance.merge_halves(result.stacked))
    tables_ = {
        "trajectories": sinks.trajectory_table(long, info, g.members), "genotypes": g.series.join(members.withColumnRenamed("genotype", "label"), ["population", "label"]), "members": members, "annotations": notes,
        "scores": result.scores, "edges": result.edges, "populations": result.populations, "stacked": result.stacked, "series": merged.join(palette, ["population", "identity"], "left"),
        "label_anchors": (anchors := settled(abundance.label_anchors(merged))), "label_places": abundance.label_places(anchors, top=1.0), "smooth": abundance.interpolated(g.series), "palette": palette, "trajectory_palette": annotations.trajectory_palette(palette, g.members), "lineage_dot": annotations.dot_graph(result.edges, palette),
    }
    if g.distance is not None:
        tables_ |= {"distances": g.distance, "distance_matrix": distances.square(g.distance), "linkage": g.linkage}
    paths = {k: sinks.write_table(v, folder, k, fmt, keep=k in ("populations", "edges")) for k, v in tables_.items()}
    paths["options"] = sinks.write_text(long.sparkSession, sinks.options_json(options), folder, "options")
    if fmt == "tsv":
        few = palette.orderBy("population", "identity").limit(sinks.DRAWN).collect()  # what one picture can show
        paths["script"] = sinks.write_text(long.sparkSession, sinks.plot_script(paths["stacked"], f"{options.name}.png", {r.identity: r.color for r in few}), folder, "script")
    return paths


def run(spark: SparkSession, path: str, folder: str, options: Options | None = None, is_genotype: bool = False, pairwise: str | None = None, aliases: str | None = None, colors: str | None = None, annotation_colors: str | None = None, sheet: str | None = None) -> dict[str, str]:
    """From a table (a file, or pasted text) to the folder of results. sheet: of a workbook. pairwise: a file of distances from before; the others: files of two columns."""
    options = options or Options()
    wide = tables.read_any(spark, path, sheet)
    long, info = tables.parse_genotypes(wide) if is_genotype else tables.parse_series(wide)
    long = settled(long)
    known = tables.read_distances(spark, pairwise) if pairwise else None
    two = lambda file, key, value: tables.read_map(spark, file).toDF(key, value) if file else None
    result = analyse(long, options, is_genotype, known)
    return save(result, long, info, folder, options, aliases=two(aliases, "key", "value"), colors=two(colors, "identity", "color"), annotation_colors=two(annotation_colors, "annotation", "color"))
