"""Operator 3, benchmark decontamination by the q-gram lemma.

Texts and items are compared with A-Z in lower case and every run of white space as one space. Looked for is each
stretch of ``length`` bytes of an item, at any offset (the whole item where it is shorter). A stretch of m bytes that occurs
with at most k edits shares at least m - q + 1 - k * q of its q-grams with the place, on diagonals that lie within k of each other.
So each document's q-grams are looked up among the items', and hits are dealt to overlapping diagonal bands (2k + 2 wide,
starting every k + 1 diagonals: every placement lies in one). In a band, only stretches that hold enough hits are left,
and banded alignment decides: no place within the budget is lost. Neighbouring stretches' edits differ by one at most, so an
alignment also settles those stretches near by that its edits leave no doubt about.

The items' q-grams are broadcast, in shards of at most SHARD bytes of items: one shard for any usual benchmark,
one pass over the documents for each.

Rows: null or empty texts and items hold nothing. Items under ``shortest`` bytes are looked for with the longest q, up to ``q``, for which
the lemma holds; those too short for an edit are looked for exactly, and not inside longer words (of A-Z, a-z, 0-9). Rows without doc_id
are left out; repeated rows are looked at each for itself. An empty table on either side gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, flat_ranges, fresh, row_chunks, text_bytes, tidy
from .hashing import U64, gram_hashes

SHARD = 8 << 20
CHUNK = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[WHITE] = 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, runs of white space as one space, none at the ends of a row."""
    text = LOWER[data]
    blank = text == 32
    drop = np.zeros(len(text), bool)
    drop[1:] = blank[1:] & blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    drop[first] = blank[first]
    some = np.flatnonzero(offsets[:-1] < offsets[1:])
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(text))))[offsets[some + 1] - 1]
    end = np.maximum(last + 1, offsets[some])
    drop[flat_ranges(end, offsets[some + 1] - end)] = True
    kept = np.r_[0, np.cumsum(~drop)]
    return text[~drop], kept[offsets]


@dataclass
class Patterns:
    """The items of one shard that are looked for with the same q, their q-grams sorted by hash, and a bit map of these hashes.

    Looked for are all stretches of ``window`` bytes of an item, with ``budget`` edits."""

    q: int
    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    window: np.ndarray
    budget: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    bits: np.ndarray

    @property
    def bound(self) -> np.ndarray:
        return self.window - self.q + 1 - self.budget * self.q


MAP_BITS = 24
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(97, 123)]] = True


def build_patterns(items: list[tuple[int, str | None]], q: int, budget: float, length: int, shortest: int) -> list[Patterns]:
    """One for each q in use: ``q`` and, for items under ``shortest`` bytes, the lesser ones they need."""
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.string()))
    text, offsets = normalised(data, offsets)
    sizes = np.diff(offsets)
    windows = np.minimum(sizes, length)
    budgets = np.floor(windows * budget).astype(np.int64)
    grams_of = np.where(sizes >= shortest, q, np.minimum(q, windows // (budgets + 1)))
    numbers = np.array([item for item, _ in items], np.int64)
    out = []
    for g in np.unique(grams_of[sizes > 0])[::-1]:
        of = np.flatnonzero((sizes > 0) & (grams_of == g))
        start, size = offsets[:-1][of], sizes[of]
        grams = size - g + 1
        hashes = gram_hashes(text, int(g))[flat_ranges(start, grams)]
        owner, place = np.repeat(np.arange(len(of)), grams), flat_ranges(np.zeros(len(of), np.int64), grams)
        by = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << MAP_BITS, bool)
        bits[(hashes >> U64(64 - MAP_BITS)).astype(np.int64)] = True
        out.append(Patterns(int(g), text, start, size, numbers[of], windows[of], budgets[of], hashes[by], owner[by].astype(np.int32), place[by].astype(np.int32), bits))
    return out


def candidate_bands(p: Patterns, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, first diagonal, first stretch, last stretch): bands and the stretches whose hits in them meet the bound."""
    none = np.zeros(0, np.int64)
    at = np.flatnonzero(p.bits[(grams >> U64(64 - MAP_BITS)).astype(np.int64)])
    lo = np.searchsorted(p.hashes, grams[at], "left")
    n = np.searchsorted(p.hashes, grams[at], "right") - lo
    some = n > 0
    at, lo, n = at[some], lo[some], n[some]
    if not len(at):
        return none, none, none, none
    # any place lies in a part of the text of its stretch's length and budget: too few hits of any kind in it, and it cannot meet the bound
    reach, least = int((p.window + p.budget).max()), int(p.bound.min())
    dense = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach) >= least
    at, lo, n = at[dense], lo[dense], n[dense]
    rows = flat_ranges(lo, n)
    owner, place = p.owner[rows].astype(np.int64), p.place[rows].astype(np.int64)
    base = int((p.size + p.budget).max())
    diagonal = np.repeat(at, n) - place + base  # from 0 on
    band = diagonal // (p.budget[owner] + 1) + 1  # a band takes in two steps: its own and the next
    width = int(band.max()) + 1 if len(band) else 1
    key, place = np.concatenate([owner * width + band, owner * width + band - 1]), np.tile(place, 2)
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    some = count[of] >= p.bound[key // width]
    key, place = key[some], place[some]
    by = np.lexsort((place, key))
    key, place = key[by], place[by]
    owner = key // width
    last = np.arange(len(key)) + p.bound[owner] - 1  # the hit that completes the bound
    some = np.flatnonzero(last < len(key))
    some = some[key[last[some]] == key[some]]
    room = p.window - p.q
    some = some[place[last[some]] - place[some] <= room[owner[some]]]
    key, owner = key[some], owner[some]
    low = np.maximum(place[last[some]] - room[owner], 0)
    high = np.minimum(place[some], (p.size - p.window)[owner])
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] > high[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.r_[first[1:], len(key)][: len(first)] - 1
    owner = owner[first]
    return owner, (key[first] % width - 1) * (p.budget[owner] + 1) - base, low[first], high[end]


def align_bands(patterns: np.ndarray, text: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best alignment of each pattern (a row) inside its band of ``width`` diagonals from ``begin``.

    A placement may use the bytes low .. high - 1 of ``text`` and begin on any diagonal. All rows step together, pattern byte
    by pattern byte; a cell holds 256 * edits + the diagonal where the alignment began."""
    n, m = patterns.shape
    at = begin[:, None] + np.arange(m + width - 1)
    cells = np.where((at >= low[:, None]) & (at < high[:, None]), text[np.clip(at, 0, len(text) - 1)].astype(np.int16), np.int16(-1))
    cost = np.tile(np.arange(width, dtype=np.int32), (n, 1))
    ramp = np.arange(width, dtype=np.int32) * 256
    for i in range(m):
        before = cost
        cost = before + ((cells[:, i : i + width] != patterns[:, i : i + 1]).astype(np.int32) << 8)
        np.minimum(cost[:, :-1], before[:, 1:] + 256, out=cost[:, :-1])  # pattern byte left out
        cost = np.minimum.accumulate(cost - ramp, axis=1) + ramp  # text byte left out
    best = np.argmin(cost, axis=1)
    value = cost[np.arange(n), best]
    return value >> 8, begin + (value & 255), begin + best + m


ALIGNED = 2000


def verified(p: Patterns, text: np.ndarray, cuts: np.ndarray, owner: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """Placements within the budget of the stretches low .. high of candidate bands, each inside one row: all that begin or end
    a run of such stretches, and the best ones."""
    m, k = p.window[owner], p.budget[owner]
    begin, end = np.maximum(first + low, 0), np.minimum(first + high + 2 * (k + 1) + m, len(text))
    rows = np.searchsorted(cuts, begin, "right") - 1  # empty rows have equal cuts: this is the last that begins there
    spread = np.maximum(0, np.searchsorted(cuts, end, "left") - rows)
    at, row = np.repeat(np.arange(len(owner)), spread), flat_ranges(rows, spread)
    fits = np.minimum(end[at], cuts[row + 1]) - np.maximum(begin[at], cuts[row]) >= m[at] - k[at]
    at, row = at[fits], row[fits]
    task, low, high = np.arange(len(at)), low[at], high[at]
    best = np.full(len(at), np.iinfo(np.int64).max)
    out: dict[str, list[np.ndarray]] = {f: [np.zeros(0, np.int64)] for f in ("row", "item", "start", "end", "edits")}
    while len(task):
        middle = (low + high) // 2
        edits, start, end = (np.empty(len(task), np.int64) for _ in range(3))
        for size in np.unique(m[at[task]]):
            every = np.flatnonzero(m[at[task]] == size)
            for part in range(0, len(every), ALIGNED):
                of = every[part : part + ALIGNED]
                t = task[of]
                o, budget = owner[at[t]], int(k[at[t[0]]])
                patterns = p.text[(p.start[o] + middle[of])[:, None] + np.arange(size)].astype(np.int16)
                edits[of], start[of], end[of] = align_bands(patterns, text, first[at[t]] + middle[of], cuts[row[t]], cuts[row[t] + 1], 2 * (budget + 1))
        budget = k[at[task]]
        good = edits <= budget
        np.minimum.at(best, task[good], edits[good])
        a, z = cuts[row[task]], cuts[row[task] + 1]
        start, end = np.clip(start, a, z), np.clip(end, a, z)
        whole = good.copy()
        strict = good & (budget == 0)
        if strict.any():
            s, e = start[strict], end[strict]
            inner = (s > a[strict]) & LETTER[text[s]] & LETTER[text[s - 1]]
            inner |= (e < z[strict]) & LETTER[text[e - 1]] & LETTER[text[np.minimum(e, len(text) - 1)]]
            whole[strict] = ~inner
        for f, v in (("row", row[task]), ("item", p.item[owner[at[task]]]), ("start", start - a), ("end", end - a), ("edits", edits)):
            out[f].append(v[whole])
        # what is d stretches away has at least edits - d and at most edits + d edits
        sure = np.where(best[task] == 0, budget - edits, np.minimum(budget - edits, edits - best[task]))
        step = np.where(good, np.maximum(1, sure), edits - budget)
        left, right = np.where(good & (middle > low), np.maximum(middle - step, low), middle - step), np.where(good & (middle < high), np.minimum(middle + step, high), middle + step)
        before, after = left >= low, right <= high
        task, low, high = np.r_[task[before], task[after]], np.r_[low[before], right[after]], np.r_[left[before], high[after]]
    return {f: np.concatenate(v) for f, v in out.items()}


def places(hit: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Placements of an item in a row that touch or overlap as one, with the fewest edits."""
    by = np.lexsort((hit["start"], hit["item"], hit["row"]))
    hit = {f: v[by] for f, v in hit.items()}
    row, item, start = hit["row"], hit["item"], hit["start"]
    pair = np.r_[0, np.cumsum((row[1:] != row[:-1]) | (item[1:] != item[:-1]))]
    span = int(hit["end"].max()) + 2
    reached = np.maximum.accumulate(pair * span + hit["end"])
    first = np.flatnonzero(np.r_[True, pair[1:] * span + start[1:] > reached[:-1]])
    least, most = np.minimum.reduceat(hit["edits"], first), np.maximum.reduceat(hit["end"], first)
    return {"row": row[first], "item": item[first], "start": start[first], "end": most, "edits": least}


def _search(patterns):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offsets, CHUNK):
                text, cuts = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for p in patterns.value:
                    bands = candidate_bands(p, gram_hashes(text, p.q))
                    if not len(bands[0]):
                        continue
                    hit = verified(p, text, cuts, *bands)
                    if len(hit["row"]):
                        hit = places(hit)
                        cols = (ids[i + hit["row"]], hit["item"], hit["start"], hit["end"], hit["edits"])
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, q: int = 8, budget: float = 0.1, length: int = 100, shortest: int = 50) -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_places): items found in documents; start and end in the normalised
    bytes, from the first place to the last, edits of the best stretch, and the number of separate places."""
    if length * budget > 60:
        raise ValueError("bands of over 255 diagonals are not supported: take a smaller length or budget")
    if not length * (1 - budget * q) > q or not shortest * (1 - budget * q) > q - 1:
        raise ValueError("the q-gram lemma says nothing for these parameters: take a smaller q or budget, or longer patterns")
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // SHARD))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    kinds = "doc_id long, item_id long, start long, end long, edits long"
    found = None
    for shard in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).collect()  # at most about SHARD bytes
        patterns = build_patterns([(r.item_id, r.text) for r in rows], q, budget, length, shortest)
        if not patterns:
            continue
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast(patterns)), kinds)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kinds)
    return found.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"), F.countDistinct("start", "end").alias("n_places"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``documents`` without those that hold an item; all columns stay."""
    leak = fresh(documents, "leak")
    leaks = find_leaks(documents, benchmark, **parameters).select(F.col("doc_id").alias(leak)).distinct()
    return documents.join(leaks, F.col("doc_id") == F.col(leak), "left_anti")
