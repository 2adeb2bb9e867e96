"""Operator 7, n-gram Jaccard join: pivots, Voronoi regions with triangle-inequality windows, recursive and exact.

1. Documents with equal shingle sets are one (the least doc_id stands for all).
2. Among the rest nearly all distances are 1, from any pivot too, and Voronoi regions of pivots would take in everything
   (see the README for figures). So the space is first cut where it is disconnected. Sets within the distance share at least
   ``need`` of the slices of module ``shingles``. Slices that more than FEW sets share (common passages, large groups of copies) are dropped
   and counted for each set, as are its empty slices. A set with fewer dropped slices than ``need`` shares other ones with each of its
   partners, need - dropped at least: pairs under that bound go. Sets with more are *saturated*; pairs of two such are
   sought among these sets alone: in any one order of all elements, rare ones first, two sets within the distance share one of their first
   elements (size - least intersection + 1 of them). Sets connected through the pairs left, or through first elements of saturated
   sets, make a *family*; no pair within the distance crosses families.
3. Inside a family distances spread, and a large family is joined as a metric space: some members are drawn as pivots. A
   member whose nearest pivot is within NEAR (at distance m) goes to that pivot's region and, by the triangle inequality, to those of
   all pivots within m + 2 * radius: of any two such members within the radius both are in the region of one's nearest
   pivot. Members beyond NEAR make a region of the rest, with those beyond NEAR - radius. Regions still large
   are cut again with other pivots, as long as the windows copy members at most GROWTH times; what cannot be cut that way is joined in
   pairs of blocks, of which a region has MOST at most, so that a member is copied MOST times at most. Each region or pair of blocks is joined exactly and gives a spanning forest of its links, not its pairs.
4. Links' components, by contraction.

Words and shingles are told apart by hashes of 64 bits under a key drawn for the run (module ``hashing``), equal sets by their size and two sums of mixed hashes.

Rows: null text has no words; rows without doc_id are left out; of rows that share a doc_id the one with the smallest text
stands for all. Documents without words have an empty set and link with nothing. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import repeats as R
from .common import buckets_of, discard, fresh, partitions, saved, tidy
from .components import components, spanning
from .hashing import U64, draw, mix
from .shingles import set_batches, set_prints, size_class, slices
from .suffix_dedup import unique_documents

#: members of a region that are joined at once (larger ones are cut by pivots), and of a block where no pivot can cut; a region has MOST blocks at most, whose
#: members are then more and are joined BLOCK by BLOCK inside the task
BASE, BLOCK, MOST = 64, 1024, 24
#: members that meet all of their region before the others do
LEADERS = 64
#: elements of saturated sets whose counts are known to all tasks: the most common ones, of those in over SOME sets
COMMON, SOME = 1 << 18, 8
PIVOTS = 64
NEAR = 0.6
GROWTH = 2.0
LEVELS = 4
#: members of small regions that one task joins, region by region
MEMBERS = 50_000
#: sets that share a slice, beyond which it is dropped (and counted)
FEW = 6


def _prints(words: int, similarity: tuple[int, int], key: int):
    """Per document: size and prints of its set; for its size class and the next (0, 1) how many slices it can lose before it is saturated."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, counts in set_batches(batches, words, key):
            a, b = set_prints(values, counts)
            cut = slices(values, counts, similarity)
            kind = size_class(counts)
            spare = np.full((2, len(counts)), 1 << 40)  # where a set is not cut for a class, nothing is lost
            spare[cut["cls"] - kind[cut["set"]], cut["set"]] = cut["need"] - cut["empty"]
            yield pa.record_batch([pa.array(x) for x in (ids, counts.astype(np.int64), a.view(np.int64), b.view(np.int64), kind, spare[0], spare[1])], names=["doc_id", "n_shingles", "print_a", "print_b", "cls", "spare", "spare_up"])

    return run


def _slices(words: int, similarity: tuple[int, int], buckets: int, key: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[R.Entries] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            e = {f: np.concatenate([h[f] for h in held]) for f in ("symbol", "doc", "len")}
            held.clear()
            return R.pack(R.bucketed(e, buckets))

        for ids, values, counts in set_batches(batches, words, key):
            a, _ = set_prints(values, counts)
            new = np.array([not (x in seen or seen.add(x)) for x in a.tolist()], bool)  # an equal set of this task speaks for it
            if len(seen) > 500_000:
                seen.clear()
            cut = slices(values[np.repeat(new, counts)], counts[new], similarity)
            held.append({"symbol": cut["sig"], "doc": ids[new][cut["row"]], "len": cut["of"].astype(np.int32)})
            if sum(len(h["doc"]) for h in held) >= R.GATHER:
                yield flush()
        if held:
            yield flush()

    return run


def _shared(few: int):
    """Rows (a, b, cls, n): sets a < b share n slices that no more than ``few`` sets share; b null: a has n that more share."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        e = R.unpack(table, 0)
        by = np.lexsort((e["doc"], e["symbol"]))
        s, d, c = e["symbol"][by], e["doc"][by], e["len"][by].astype(np.int64)
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(s)])
        left, right = [], []
        for n in range(2, few + 1):
            at = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    left.append(at + i)
                    right.append(at + j)
        left, right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        pairs, n = np.unique(np.stack([d[left], d[right], c[left]], 1), axis=0, return_counts=True)
        lost = np.repeat(size > few, size)
        drops, m = np.unique(np.stack([d[lost], c[lost]], 1), axis=0, return_counts=True)
        b = pa.array(np.r_[pairs[:, 1], np.zeros(len(drops), np.int64)], mask=np.r_[np.zeros(len(pairs), bool), np.ones(len(drops), bool)])
        return pa.table({"a": pa.array(np.r_[pairs[:, 0], drops[:, 0]]), "b": b, "cls": pa.array(np.r_[pairs[:, 2], drops[:, 1]]), "n": pa.array(np.r_[n, m].astype(np.int64))})

    return run


def equal_sets(docs: DataFrame, words: int, similarity: tuple[int, int], key: int) -> DataFrame:
    """(doc_id, n_shingles, cls, spare, spare_up, same): same is the least doc_id with an equal set; null for empty sets."""
    sets = saved(docs.mapInArrow(_prints(words, similarity, key), "doc_id long, n_shingles long, print_a long, print_b long, cls long, spare long, spare_up long"), "jaccard-sets")
    prints = ["n_shingles", "print_a", "print_b"]
    least = saved(sets.where("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("same")), "jaccard-least")  # a table of its own: a join with it can split a large group of copies
    out = saved(sets.join(least, prints, "left").drop("print_a", "print_b"), "jaccard-equal")
    discard(sets)
    discard(least)
    return out


def candidates(docs: DataFrame, equal: DataFrame, words: int, similarity: tuple[int, int], buckets: int, key: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of distinct sets that meet the bound, and the saturated sets (id)."""
    packed = docs.mapInArrow(_slices(words, similarity, buckets, key), R.PACKED)
    shared = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared(FEW), "a long, b long, cls long, n long")
    shared = saved(shared.groupBy("a", "b", "cls").agg(F.sum("n").alias("n")), "jaccard-shared")
    cuts = equal.where("n_shingles > 0").select("doc_id", "same", F.explode(F.array(F.struct("cls", "spare"), F.struct((F.col("cls") + 1).alias("cls"), F.col("spare_up").alias("spare")))).alias("x")).select("doc_id", "same", "x.cls", "x.spare")
    drops = shared.where("b IS NULL").select(F.col("a").alias("doc_id"), "cls", "n")
    slack = saved(cuts.join(drops, ["doc_id", "cls"], "left").select("doc_id", "same", "cls", (F.col("spare") - F.coalesce("n", F.lit(0))).alias("slack")), "jaccard-slack")
    side = lambda x: slack.select(F.col("doc_id").alias(x), "cls", F.col("same").alias(f"same_{x}"), F.col("slack").alias(f"slack_{x}"))
    pairs = shared.where("b IS NOT NULL").join(side("a"), ["a", "cls"]).join(side("b"), ["b", "cls"])
    pairs = pairs.where("n >= slack_a AND n >= slack_b AND same_a <> same_b").select(F.least("same_a", "same_b").alias("a"), F.greatest("same_a", "same_b").alias("b")).distinct()
    pairs = saved(pairs, "jaccard-pairs")
    full = saved(slack.where("slack <= 0").select(F.col("same").alias("id")).distinct(), "jaccard-saturated")
    discard(shared)
    discard(slack)
    return pairs, full


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold each element, as far as one batch goes."""
    for b in batches:
        values, n = np.unique(np.frombuffer(b"".join(b.column("elements").to_pylist()), U64), return_counts=True)
        yield pa.record_batch([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["element", "n"])


def common_elements(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common elements of all sets, ascending, and how many sets hold each. Which ones are known only decides how rare first elements are."""
    counts = sets.mapInArrow(tidy(_counts), "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") > SOME)
    known = counts.orderBy(F.desc("n")).limit(COMMON).toArrow()
    values, n = known.column("element").to_numpy().view(U64), known.column("n").to_numpy()
    by = np.argsort(values)
    return values[by], n[by]


def first_elements(values: np.ndarray, counts: np.ndarray, similarity: tuple[int, int], common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, elements): of each set as many of its rarest elements as it takes to share one with every set within the distance."""
    a, b = similarity
    known, n = common
    row, rank = np.repeat(np.arange(len(counts)), counts), np.zeros(len(values), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        rank = np.where(known[at] == values, n[at], 0)
    by = np.lexsort((values, rank, row))
    place = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = by[place <= np.repeat(counts - -(-counts * a // b), counts)]
    return row[kept], values[kept]


def _firsts(similarity: tuple[int, int], buckets: int, common: tuple[np.ndarray, np.ndarray]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sets = [np.frombuffer(x.as_py(), U64) for x in b.column("elements")]
                row, element = first_elements(np.concatenate(sets), np.array([len(x) for x in sets]), similarity, common)
                yield R.pack(R.bucketed({"symbol": element, "doc": b.column("id").to_numpy()[row]}, buckets))

    return run


def _stars(key: tuple, table: pa.Table) -> pa.Table:
    """Sets that share an element, each with the least of them."""
    e = R.unpack(table, 0)
    by = np.lexsort((e["doc"], e["symbol"]))
    s, d = e["symbol"][by], e["doc"][by]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(s) else d
    pairs = np.unique(np.stack([d, least], 1)[d != least], axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


SETS = "id long, elements binary"


def _sets(words: int, key: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, values, counts in set_batches(iter([b]), words, key):
                raw = [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["id", "elements"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices, some columns (elements) at a time; elements of one side only are left out."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    if left is right:
        values, n = np.unique(a, return_counts=True)
        shared = values[n > 1]
    out = np.zeros((len(left), len(right)), np.float32)
    coded = []
    for side, flat in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        col = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        ok = shared[col] == flat if len(shared) else np.zeros(len(flat), bool)
        by = np.argsort(col[ok], kind="stable")
        coded.append((row[ok][by], col[ok][by]))
    for first in range(0, len(shared), columns):
        parts = []
        for (row, col), side in zip(coded, (left, right), strict=True):
            i, j = np.searchsorted(col, [first, first + columns])
            m = np.zeros((len(side), min(columns, len(shared) - first)), np.float32)
            m[row[i:j], col[i:j] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    out = np.rint(out)
    if left is right:
        np.fill_diagonal(out, [len(x) for x in left])
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs have b * intersection >= a * union, for similarity (a, b)."""
    a, b = similarity
    both = intersections(left, right).astype(np.int64)
    total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return b * both >= a * (total - both)


def forest(sets: list[np.ndarray], l: np.ndarray, r: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Component (the least place in it) of each place, of the graph of all links between places ``l`` and places ``r`` (one and the same array: of all links inside).

    Some leaders meet all others first. Members of one component need not meet any more, so near copies of one text are not compared pair by pair: the rest goes
    in the order of components, BLOCK by BLOCK, a block inside a component with members of the others only."""
    within, of = l is r, np.arange(len(sets))

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal of
        left = [sets[k] for k in x]
        for at in range(0, len(y), BLOCK):
            part = y[at : at + BLOCK]
            i, j = np.nonzero(linked(left, [sets[k] for k in part], similarity))
            up = np.arange(len(sets))
            moved = spanning(up, of[x[i]], of[part[j]])
            up[moved[:, 0]] = moved[:, 1]
            of = up[of]

    if len(sets) > LEADERS:
        meet(l[:LEADERS], r)
        if not within:
            meet(r[:LEADERS], l)
        l, r = (k[np.argsort(of[k], kind="stable")] for k in (l, r))
    for at in range(0, len(l), BLOCK):
        x, y = l[at : at + BLOCK], r[at:] if within else r
        if (of[x] == of[x[0]]).all():
            y = y[of[y] != of[x[0]]]
        meet(x, y)
    return of


def _join(similarity: tuple[int, int]):
    """Links inside each region of a bucket, or between the two blocks of a pair (side 0 and 1; side 2: within the block)."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        region = table.column("region").to_numpy()
        order = np.lexsort((table.column("id").to_numpy(), region))
        table = table.take(pa.array(order))
        region, ids, side = (table.column(c).to_numpy() for c in ("region", "id", "side"))
        raw = table.column("elements").combine_chunks()
        out = [np.zeros((0, 2), np.int64)]
        for part in np.split(np.arange(len(ids)), np.flatnonzero(region[1:] != region[:-1]) + 1):
            sets = [np.frombuffer(raw[i].as_py(), U64) for i in part]
            every = np.arange(len(part))
            l, r = (every, every) if (side[part] == 2).all() else (np.flatnonzero(side[part] == k) for k in (0, 1))
            if len(l) and len(r):
                out.append(spanning(ids[part], every, forest(sets, l, r, similarity)))
        got = np.concatenate(out)
        return pa.table({"a": pa.array(got[:, 0]), "b": pa.array(got[:, 1])})

    return run


def _nearest(similarity: tuple[int, int]):
    """Each member's regions: its nearest pivot's and those of pivots within twice the radius more, or that of the rest, or both."""
    radius = 1 - similarity[0] / similarity[1]

    @tidy
    def run(key: tuple, members: pa.Table, pivots: pa.Table) -> pa.Table:
        ids = members.column("id").to_numpy()
        if not pivots.num_rows or not members.num_rows:
            targets: list[list[int]] = [[] for _ in ids]
        else:
            left = [np.frombuffer(x.as_py(), U64) for x in members.column("elements")]
            pivots = pivots.sort_by("id")
            right = [np.frombuffer(x.as_py(), U64) for x in pivots.column("elements")]
            both = intersections(left, right)
            size = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
            far = 1 - both / (size - both)
            region = mix(pivots.column("id").to_numpy().view(U64) ^ mix(np.full(len(right), key[0].as_py(), np.int64).view(U64))).view(np.int64)
            least = far.min(1, keepdims=True)
            own = (far <= least + 2 * radius + 1e-9) & (least <= NEAR)
            rest = int(mix(np.array([key[0].as_py()], np.int64).view(U64) + U64(1)).view(np.int64)[0])
            targets = [region[row].tolist() + ([rest] if m > NEAR - radius - 1e-9 else []) for row, m in zip(own, least[:, 0], strict=True)]
        return pa.table({"region": members.column("region"), "id": members.column("id"), "targets": pa.array(targets, pa.list_(pa.int64()))})

    return run


def _bucket(name: str, buckets: int):
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def region_links(sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): spanning forests of the links inside the regions of ``sets`` (region, id, elements), saved."""
    buckets = max(partitions(sets.sparkSession) * 4, -(-sets.count() // MEMBERS))
    kinds = "a long, b long"
    found, rows = None, sets
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        rows = rows.join(sizes, "region")
        small = rows.where(f"size <= {BASE}").withColumn("side", F.lit(2))
        part = small.withColumn("bucket", _bucket("region", buckets)).drop("size").groupBy("bucket").applyInArrow(_join(similarity), kinds)
        part = saved(part, "jaccard-links")
        found = part if found is None else found.unionByName(part)
        large = saved(rows.where(f"size > {BASE}"), "jaccard-large")
        if large.isEmpty():
            return found
        salts = F.ceil(F.col("size") / BLOCK).cast("int")
        blocks = F.least(salts, F.lit(MOST))
        whole = large
        if level < LEVELS:
            # pivots: about the square root of the members, PIVOTS at most, by hash; members meet their family's pivots in as many tasks as it has blocks
            chance = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 40)).cast("double") / float(1 << 40)
            pivots = large.where(chance < F.least(F.sqrt("size"), F.lit(PIVOTS)) / F.col("size")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
            dealt = large.withColumn("salt", F.pmod(F.xxhash64("id"), salts.cast("long")).cast("int"))
            near = dealt.groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt")).applyInArrow(_nearest(similarity), "region long, id long, targets array<long>")
            near = saved(near, "jaccard-near")
            cuts = near.groupBy("region").agg((F.sum(F.size("targets")) / F.count(F.lit(1)) <= GROWTH).alias("few"), F.countDistinct(F.try_element_at("targets", F.lit(1))).alias("kinds"))
            good = cuts.where("few AND kinds > 1").select("region")
            cut = large.join(near, ["region", "id"]).join(good, "region", "left_semi")
            rows = saved(cut.select(F.explode("targets").alias("region"), "id", "elements"), "jaccard-regions")
            whole = large.join(good, "region", "left_anti")
        # the rest in pairs of blocks: every pair of members meets in one
        block = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
        pairs = whole.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pairs = pairs.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "id", "elements", F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"))
        part = saved(pairs.withColumn("bucket", F.col("region")).groupBy("bucket").applyInArrow(_join(similarity), kinds), "jaccard-links")
        found = found.unionByName(part)
        if level == LEVELS:
            break
    return found


def jaccard_components(documents: DataFrame, words: int = 3, similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents linked by Jaccard similarity of at least a / b of their
    ``words``-word shingle sets, for ``similarity`` (a, b); the component's id is its least doc_id."""
    docs = unique_documents(documents)
    buckets, key = buckets_of(docs), draw()
    equal = equal_sets(docs, words, similarity, key)
    pairs, full = candidates(docs, equal, words, similarity, 4 * buckets, key)
    wanted = full.unionByName(pairs.select(F.col("a").alias("id"))).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = saved(docs.join(wanted.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(words, key), SETS), "jaccard-members")
    saturated = sets.join(full, "id", "left_semi")
    firsts = saturated.mapInArrow(_firsts(similarity, buckets, common_elements(saturated)), R.PACKED)
    stars = firsts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_stars, "a long, b long").distinct()
    family = components(pairs.unionByName(stars))
    members = saved(sets.join(family, "id").select(F.col("component").alias("region"), "id", "elements"), "jaccard-regions")
    discard(sets)
    of = components(region_links(members, similarity))
    named = equal.join(of, F.col("same") == F.col("id"), "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "same", "doc_id").alias("component_id"))


def keep_one_each(documents: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose doc_id is the least of its class (see jaccard_components);
    rows without doc_id go, and of rows that share a doc_id one of the smallest text stays."""
    if not documents.groupBy("doc_id").count().where("count > 1").limit(1).isEmpty():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("text", F.lit("")), *(c for c in documents.columns if c not in ("doc_id", "text"))))
        row = fresh(documents, "row")
        documents = documents.withColumn(row, first).where(F.col(row) == 1).drop(row)
    kept = fresh(documents, "kept")
    least = jaccard_components(documents, words, similarity).where("component_id = doc_id").select(F.col("doc_id").alias(kept))
    return documents.join(least, F.col("doc_id") == F.col(kept), "left_semi")
