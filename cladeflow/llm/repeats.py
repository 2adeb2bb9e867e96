"""Exact long repeats over anchored windows, shared by the byte and the word form of substring dedup.

A *window* is ``width`` consecutive symbols (bytes or words) of one document. Its content alone chooses an
*anchor* inside it, so equal windows choose the same one. Windows that follow each other and share the anchor
make one *entry* (doc_id, pos, n, symbol, print): ``pos`` is the first window's start, ``n`` the number of windows,
``symbol`` the name of the anchor and ``print`` the fingerprint of all the entry's symbols. Then

* an entry whose (symbol, print) occurs earlier repeats as a whole: all its windows do;
* a symbol that has one print only needs nothing more;
* for the others ("torn" entries, at the rims of repeats) the windows themselves are compared, by their bytes: in the bucket of their symbol or, where
  a symbol has over HOT torn entries (many documents hold it in different surroundings), each window in the bucket of its own hash.

Prints are 64-bit hashes under the run's key (module ``hashing``); in op1 the anchor's name is another, in op8 it is an exact name.

Entries travel as packed columns, one row for each bucket of symbols and batch of text, so a shuffled entry costs
about 23 bytes, and copies inside a batch go no further than the batch: a passage in every document
comes to its bucket once a batch, not once a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import flat_ranges, tidy, word_bounds
from .hashing import U64, keyed_hashes, keyed_symbols, mix, same_pieces

#: kind 0: entries; kind 1: repeated stretches (doc_id, start, end); kind 2: torn entries; kind 3: torn entries of hot symbols
PACKED = "bucket int, kind int, n long, symbol binary, print binary, doc binary, pos binary, len binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), *((c, pa.binary()) for c in ("symbol", "print", "doc", "pos", "len"))])
FIELDS = ("symbol", "print", "doc", "pos", "len")
TYPES = {"symbol": U64, "print": U64, "doc": np.int64, "pos": np.int64, "len": np.int32}
Entries = dict[str, np.ndarray]


def planes(values: np.ndarray) -> bytes:
    """Byte planes: the many zero bytes of small numbers come together, and any codec squeezes them."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def pack(rows: list[tuple[int, int, Entries]]) -> pa.RecordBatch:
    """One packed row for each (bucket, kind, entries)."""
    rows = [r for r in rows if len(r[2]["doc"])]
    cols = {f: [planes(e[f]) if f in e else None for _, _, e in rows] for f in FIELDS}
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[2]["doc"]) for r in rows], pa.int64()), *(pa.array(cols[f], pa.binary()) for f in FIELDS)],
        schema=PACKED_ARROW,
    )


def unpack(table: pa.Table | pa.RecordBatch, kind: int) -> Entries:
    """All entries of one kind, row after row."""
    out: dict[str, list[np.ndarray]] = {f: [] for f in FIELDS}
    cols = {f: table.column(f) for f in FIELDS}
    for i, k in enumerate(table.column("kind").to_pylist()):
        if k == kind:
            for f in FIELDS:
                if (raw := cols[f][i]).is_valid:
                    out[f].append(unplanes(raw.as_py(), TYPES[f]))
    return {f: np.concatenate(v) if v else np.zeros(0, TYPES[f]) for f, v in out.items()}


def take(e: Entries, at: np.ndarray) -> Entries:
    return {f: v[at] for f, v in e.items() if len(v)} if len(e["doc"]) else e


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Entries:
    """The union of stretches: sorted, those that overlap or touch made one. doc, pos = start, print = end."""
    if not len(doc):
        return {"doc": doc.astype(np.int64), "pos": start.astype(np.int64), "print": end.astype(U64)}
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by].astype(np.int64)
    group = np.r_[0, np.cumsum(doc[1:] != doc[:-1])]
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    first = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    return {"doc": doc[at], "pos": start[at], "print": reach[np.r_[at[1:] - 1, len(doc) - 1]].astype(U64)}


def firsts(e: Entries, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (symbol, print, doc, pos); in it, whether each entry is kept as a first, and where (symbol, print) begins.

    within: a repeat inside one document counts (else only one from a smaller doc_id; then all entries of the
    first document are kept)."""
    by = np.lexsort((e["pos"], e["doc"], e["print"], e["symbol"]))
    s, p, d = e["symbol"][by], e["print"][by], e["doc"][by]
    new = np.ones(len(by), bool)
    new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1])
    if within:
        return by, new, new
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else d
    return by, d == least, new


def split_firsts(e: Entries, within: bool, width: int) -> tuple[Entries, Entries]:
    """Kept entries in index order, and the stretches that the others cover."""
    by, keep, _ = firsts(e, within)
    rest = by[~keep]
    return take(e, by[keep]), merged(e["doc"][rest], e["pos"][rest], e["pos"][rest] + e["len"][rest] + width - 1)


def bucketed(e: Entries, buckets: int, kind: int = 0) -> list[tuple[int, int, Entries]]:
    """Entries by the bucket of their symbol."""
    if not len(e["doc"]):
        return []
    of = ((mix(e["symbol"]) >> U64(33)) % U64(buckets)).astype(np.int64)
    by = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.r_[True, of[by][1:] != of[by][:-1]])
    return [(int(of[part[0]]), kind, take(e, part)) for part in np.split(by, cuts[1:])]


#: entries gathered by a task before they are packed: the more, the fewer and fuller the rows, and the more copies end here
GATHER = 400_000


def packed_batches(parts: Iterator[Entries], width: int, within: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries, gathered, freed of copies among them, packed by bucket."""
    held: list[Entries] = []
    count = 0

    def flush() -> pa.RecordBatch:
        kept, spans = split_firsts({f: np.concatenate([e[f] for e in held]) for f in FIELDS}, within, width)
        held.clear()
        return pack(bucketed(kept, buckets) + by_document(spans, buckets))

    for e in parts:
        if len(e["doc"]):
            held.append(e)
            count += len(e["doc"])
        if count >= GATHER:
            yield flush()
            count = 0
    if held:
        yield flush()


def by_document(spans: Entries, buckets: int) -> list[tuple[int, int, Entries]]:
    """Repeated stretches as packed rows; their bucket only spreads them."""
    if not len(spans["doc"]):
        return []
    return [(int(spans["doc"][0] % buckets), 1, spans)]


def entries_of(windows: np.ndarray, anchor: np.ndarray, name: np.ndarray, doc: np.ndarray, local: np.ndarray, sequence: np.ndarray, width: int, key: int) -> Entries:
    """Entries of windows that start at ``windows`` (ascending) with anchors at ``anchor`` named ``name``.

    doc, local: of each window, its document and start inside it; sequence: the bytes, or the names of words, that windows count in."""
    if not len(windows):
        return {f: np.zeros(0, TYPES[f]) for f in FIELDS}
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1) | (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(windows)])
    start = windows[at]
    lead = (anchor[at] - start).astype(U64)  # equal contents under equal symbols must also agree on where the anchor stands
    return {"symbol": name[at], "print": (keyed_hashes if sequence.dtype == np.uint8 else keyed_symbols)(sequence, start, start + n + width - 1, key) ^ mix(lead * U64(1024) + n.astype(U64)), "doc": doc[at], "pos": local[at], "len": n.astype(np.int32)}


def torn(e: Entries) -> np.ndarray:
    """Of sorted first entries: those whose symbol has more than one print."""
    s, p = e["symbol"], e["print"]
    if not len(s):
        return np.zeros(0, bool)
    new = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(new) - 1
    kinds = np.bincount(group, weights=np.r_[True, (s[1:] != s[:-1]) | (p[1:] != p[:-1])])
    return kinds[group] > 1


# ---- torn entries: their own symbols, window by window

CONTENT = "bucket int, doc binary, pos binary, len binary, symbol binary, content binary"
CONTENT_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "pos", "len", "symbol", "content"))])


#: torn entries of one symbol, beyond which their windows are dealt one by one
HOT = 1000


class Units:
    """Bytes, or words each with a blank after it, that windows count in: unit i stands at begin(i) .. end(i) - 1 of data."""

    def __init__(self, data: np.ndarray, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.data, self.starts, self.ends = data, starts, ends

    @staticmethod
    def of_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Units:
        """The words of a text without what else is between them."""
        size = ends - starts
        last = np.cumsum(size + 1) - 1
        data = np.full(int(last[-1]) + 1 if len(last) else 0, 0x20, np.uint8)
        data[flat_ranges(last - size, size)] = text[flat_ranges(starts, size)]
        return Units(data, last - size, last)

    @staticmethod
    def parsed(data: np.ndarray, words: bool) -> Units:
        return Units(data, *word_bounds(data, np.array([0, len(data)]))[:2]) if words else Units(data)

    def begin(self, i: np.ndarray) -> np.ndarray:
        return i if self.starts is None else self.starts[i]

    def end(self, i: np.ndarray) -> np.ndarray:
        return i + 1 if self.ends is None else self.ends[i]

    def after(self, i: np.ndarray) -> np.ndarray:
        """As end, with the blank after a word."""
        return i + 1 if self.ends is None else self.ends[i] + 1


def single_windows(e: Entries, where: np.ndarray, units: Units, width: int, key: int) -> tuple[Entries, np.ndarray]:
    """Entries, those of hot symbols as one for each window, named by the window's content; and their first units."""
    hot = e["hot"].astype(bool)
    rest, part = take(e, np.flatnonzero(~hot)), {f: v[hot] for f, v in e.items()}
    n = part["len"].astype(np.int64)
    at = flat_ranges(where[hot], n)
    name = keyed_hashes(units.data, units.begin(at), units.end(at + width - 1), key)
    alone = {"doc": np.repeat(part["doc"], n), "pos": flat_ranges(part["pos"], n), "len": np.ones(len(at), np.int32), "symbol": name}
    return {f: np.concatenate([rest[f], alone[f]]) for f in alone}, np.concatenate([where[~hot], at])


def content_batch(e: Entries, where: np.ndarray, units: Units, width: int, buckets: int, key: int) -> pa.RecordBatch:
    """Packed rows of entries with the bytes they cover; where: their first units."""
    e, where = single_windows(e, where, units, width, key)
    rows = []
    for bucket, _, part in bucketed(e | {"at": where}, buckets):
        begin = units.begin(part["at"])
        content = units.data[flat_ranges(begin, units.after(part["at"] + part["len"] + width - 2) - begin)]
        rows.append((bucket, *(planes(part[f]) for f in ("doc", "pos", "len", "symbol")), content.tobytes()))
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(CONTENT_ARROW)], schema=CONTENT_ARROW)


def equal_windows(data: np.ndarray, begin: np.ndarray, end: np.ndarray, symbol: np.ndarray, key: int) -> np.ndarray:
    """A number for each window, the same for two of one symbol only where their bytes are."""
    numbers = keyed_hashes(data, begin, end, key) ^ mix(symbol)
    by = np.argsort(numbers, kind="stable")
    first = by[np.flatnonzero(np.r_[True, numbers[by][1:] != numbers[by][:-1]])] if len(by) else by
    one = np.empty(len(by), np.int64)
    one[by] = np.repeat(first, np.diff(np.r_[np.searchsorted(numbers[by], numbers[first]), len(by)]))
    size = end - begin
    same = (size == size[one]) & (symbol == symbol[one])
    rest = np.flatnonzero(same & (one != np.arange(len(one))))
    same[rest] = same_pieces(data, begin[rest], data, begin[one[rest]], size[rest])
    if same.all():
        return numbers
    found: dict[tuple[int, bytes], int] = {}
    return np.array([found.setdefault((s, data[x:y].tobytes()), len(found)) for s, x, y in zip(symbol.tolist(), begin.tolist(), end.tolist(), strict=True)], U64)


def repeated_windows(table: pa.Table, words: bool, width: int, within: bool, key: int) -> Entries:
    """Stretches covered by windows of torn entries that start earlier in another (or, within, the same) document.

    words: windows count in words, not bytes."""
    got: dict[str, list[np.ndarray]] = {f: [] for f in ("doc", "pos", "len", "symbol", "content")}
    for i in range(table.num_rows):
        for f in ("doc", "pos", "len", "symbol"):
            got[f].append(unplanes(table.column(f)[i].as_py(), TYPES[f]))
        got["content"].append(np.frombuffer(table.column("content")[i].as_py(), np.uint8))
    if not got["doc"]:
        return merged(*[np.zeros(0, np.int64)] * 3)
    e = {f: np.concatenate(v) for f, v in got.items()}
    units = Units.parsed(e["content"], words)
    size = e["len"].astype(np.int64) + width - 1
    at_unit = np.cumsum(size) - size
    by = np.argsort(e["symbol"], kind="stable")
    weight = np.cumsum(e["len"][by])
    new = np.flatnonzero(np.r_[True, e["symbol"][by][1:] != e["symbol"][by][:-1]])
    spans, at = [], 0
    ends = np.r_[new[1:], len(by)]
    while at < len(new):  # a good hundred thousand windows at a time, symbols whole
        done = weight[new[at] - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(weight[ends - 1], done + 150_000, side="right")))
        part = by[new[at] : ends[min(to, len(new)) - 1]]
        at = to
        n = e["len"][part].astype(np.int64)
        window = flat_ranges(at_unit[part], n)
        number = equal_windows(units.data, units.begin(window), units.end(window + width - 1), np.repeat(e["symbol"][part], n), key)
        doc, pos = np.repeat(e["doc"][part], n), flat_ranges(e["pos"][part], n)
        order = np.lexsort((pos, doc, number))
        k, d = number[order], doc[order]
        first = np.r_[True, k[1:] != k[:-1]]
        if not within:
            first = d == d[np.flatnonzero(first)][np.cumsum(first) - 1]
        rest = order[~first]
        spans.append(merged(doc[rest], pos[rest], pos[rest] + width))
    return {f: np.concatenate([s[f] for s in spans]) for f in ("doc", "pos", "print")}


def torn_rows(bucket: int, kept: Entries) -> list[tuple[int, int, Entries]]:
    """Torn entries of a bucket (kind 2), those of hot symbols apart (kind 3)."""
    part = take(kept, torn(kept))
    if not len(part["doc"]):
        return []
    _, of, n = np.unique(part["symbol"], return_inverse=True, return_counts=True)
    hot = n[of] > HOT
    return [(bucket, kind, take(part, np.flatnonzero(hot == (kind == 3)))) for kind in (2, 3)]


def matched(width: int, within: bool):
    """Of all entries of a bucket: repeated stretches (kind 1) and torn entries (kinds 2 and 3)."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kept, spans = split_firsts(unpack(table, 0), within, width)
        old, bucket = unpack(table, 1), key[0].as_py()
        spans = merged(*(np.r_[spans[f].astype(np.int64), old[f].astype(np.int64)] for f in ("doc", "pos", "print")))
        return pa.Table.from_batches([pack([(bucket, 1, spans), *torn_rows(bucket, kept)])], PACKED_ARROW)

    return run


SPANS = "doc_id long, start long, end long"
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def span_batch(s: Entries) -> pa.RecordBatch:
    return pa.record_batch([pa.array(s["doc"], pa.int64()), pa.array(s["pos"], pa.int64()), pa.array(s["print"].astype(np.int64), pa.int64())], schema=SPANS_ARROW)


def unpack_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = unpack(b, 1)
        if len(s["doc"]):
            yield span_batch(merged(s["doc"], s["pos"], s["print"].astype(np.int64)))

