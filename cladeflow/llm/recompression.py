"""Operator 8, substring dedup by recompression: equal word sequences get equal inner symbols.

All words are named first, then rounds compress each document's sequence of symbols: every run of one symbol becomes a symbol, then
adjacent pairs (left, right) do, where a coin that hangs on the symbol and the round makes it a left or a right one. Names are handed out
by Spark, round by round: each chunk of text sends its distinct words, or its distinct runs and pairs, to their buckets, where equal ones
get one number, by comparison of their bytes or parts, and the numbers go back to the chunks. Equal symbols thus stand for equal words, without chance.

A symbol's *context* is the stretch of words that its being there hangs on: its own words and, at each round, the neighbours that
decided where it ends. Wherever the same words stand, a symbol whose context they hold stands too. So each 50-word window takes as its anchor,
of the last round's symbols with their context inside it, the longest (the one of the least hash where several are); a window without
any (in very repetitive text) is an anchor itself. Shared symbols reveal repeats, and what shares one is verified (module
``repeats``): as a whole by the print of all its words, at the rims of repeats window by window.

Rows: null text has no words; rows without doc_id are left out; of rows that share a doc_id the one with the smallest
text stands for all. Documents under ``width`` words are kept whole. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .common import buckets_of, discard, flat_ranges, row_chunks, saved, saved_by, text_bytes, tidy, word_bounds
from .hashing import U64, draw, grouped, keyed_symbols, mix, piece_hashes, same_pieces
from .suffix_dedup import compare_windows, torn_by_document, torn_of, unique_documents

WIDTH = 50
#: bytes of text and words in a chunk, and words in a piece of a long document (pieces overlap by a window less a word)
CHUNK, CHUNK_WORDS, SEGMENT = 1_000_000, 1 << 18, 1 << 16
#: names that a bucket hands out, about
NAMES = 1_000_000
#: names of different rounds differ: a name is a multiple of it and the round
NAMINGS = 16

Arrays = dict[str, np.ndarray]
#: of a chunk: its pieces, and their words as places among the chunk's distinct words
READ = {"doc": np.int64, "begin": np.int64, "size": np.int64, "code": np.int32, "raw": np.uint8, "long": np.int32}
#: of a chunk: its pieces, and their named words
WORDS = {"doc": np.int64, "begin": np.int64, "size": np.int64, "words": np.int64}
#: a run, or a pair of runs: symbols (the second one's number and 1, or 0) and how often they stand
KEY = {"s1": np.int64, "n1": np.int32, "s2": np.int64, "n2": np.int32}
#: of a chunk's symbols: words to the next one, words of context before and after their start, and 0 for a separator, 1 for one of ``symbol``
#: (in their order), or 2 and the place of their key among the chunk's keys
STATE = {"step": np.int32, "before": np.int32, "after": np.int32, "code": np.int32, "symbol": np.int64, **KEY}


def rounds_for(width: int) -> int:
    """As many as leave contexts of about a third of a window: symbols grow by 4/3 a round."""
    return max(1, round(math.log(max(width, 2) / 16) / math.log(4 / 3)))


def kinds(fields: dict) -> str:
    return "chunk long, names long, " + ", ".join(f"`{f}` binary" for f in fields)


def to_bytes(x: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of their bytes, as many as the largest one needs, after the number of planes."""
    planes = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    parts = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)
    return bytes([planes]) + b"".join(parts[:, i].tobytes() for i in range(planes))


def from_bytes(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], (len(raw) - 1) // raw[0])
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view(kind).reshape(-1)


def row_of(chunk: int, names: int, arrays: Arrays) -> pa.Table:
    raw = {f: R.planes(v) if f == "doc" else to_bytes(v) for f, v in arrays.items()}  # ids may be negative
    return pa.table({"chunk": pa.array([chunk], pa.int64()), "names": pa.array([names], pa.int64()), **{f: pa.array([x], pa.binary()) for f, x in raw.items()}})


def arrays_of(rows: pa.Table | pa.RecordBatch, fields: dict, at: int = 0) -> Arrays:
    return {f: (R.unplanes if f == "doc" else from_bytes)(rows.column(f)[at].as_py(), kind) for f, kind in fields.items()}


# ---- words


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct piece, number of each piece), numbered by hash and, should hashes collide, by bytes."""
    hashes = piece_hashes(data, starts, ends)
    one, of = grouped(hashes)
    size = ends - starts
    same = size == size[one[of]]
    long = np.flatnonzero(same & (size > 8))  # of one length up to eight bytes, hashes differ where the bytes do
    same[long] = same_pieces(data, starts[long], data, starts[one[of[long]]], size[long])
    if same.all():
        return one, of
    raw = data.tobytes()
    _, one, of = np.unique(np.array([int(h).to_bytes(8) + raw[x:y] for h, x, y in zip(hashes, starts.tolist(), ends.tolist(), strict=True)], object), return_index=True, return_inverse=True)
    return one, of


def _read(width: int):
    """A row for each chunk of text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in row_chunks(offsets, CHUNK):
                text = data[offsets[i] : offsets[j]]
                starts, ends, counts = word_bounds(text, offsets[i : j + 1] - offsets[i])
                base = np.cumsum(counts) - counts
                pieces = np.maximum(1, -(-(counts - width + 1) // SEGMENT))
                row = np.repeat(np.arange(j - i), pieces)
                begin = flat_ranges(np.zeros(j - i, np.int64), pieces) * SEGMENT
                size = np.minimum(begin + SEGMENT + width - 1, counts[row]) - begin
                long = size >= width
                row, begin, size = row[long], begin[long], size[long]
                for x, y in row_chunks(np.r_[0, np.cumsum(size)], CHUNK_WORDS):
                    at = flat_ranges(base[row[x:y]] + begin[x:y], size[x:y])
                    one, code = distinct_pieces(text, starts[at], ends[at])
                    first, n = starts[at[one]], (ends - starts)[at[one]]
                    arrays = {"doc": ids[i:j][row[x:y]].astype(np.int64), "begin": begin[x:y], "size": size[x:y], "code": code.astype(np.int32), "raw": text[flat_ranges(first, n)], "long": n.astype(np.int32)}
                    yield from row_of(chunk, len(one), arrays).to_batches()
                    chunk += 1

    return run


# ---- naming: chunks ask, buckets answer

ASK = "bucket int, chunk long, n int, s1 binary, n1 binary, s2 binary, n2 binary, raw binary, long binary"
ASK_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), *((f, pa.binary()) for f in (*KEY, "raw", "long"))])
ANSWER = "chunk long, bucket int, name binary"


def key_hashes(k: Arrays) -> np.ndarray:
    return mix(k["s1"].view(U64) * U64(0xA24BAED4963EE407) + (k["n1"].astype(U64) << U64(32) | k["n2"].astype(U64))) ^ mix(k["s2"].view(U64) * U64(0x9FB21C651E98DF25))


def distinct_keys(k: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """As distinct_pieces, of runs and pairs."""
    hashes = key_hashes(k)
    one, of = grouped(hashes)
    if all((v == v[one[of]]).all() for v in k.values()):
        return one, of
    _, one, of = np.unique(np.stack([hashes, *(k[f].astype(U64) for f in KEY)], 1), axis=0, return_index=True, return_inverse=True)
    return one, of.ravel()


def _ask(words: bool, buckets: int):
    """What each chunk wants named, by bucket. A chunk's things are in the order of their hashes, and buckets are ranges of hashes, so
    a bucket's are next to each other, and the answers in the order of buckets are those to all."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                if words:
                    got = arrays_of(whole, {"raw": np.uint8, "long": np.int32}, i)
                    ends = np.cumsum(got["long"], dtype=np.int64)
                    hashes = piece_hashes(got["raw"], ends - got["long"], ends)
                    ends = np.r_[0, ends]
                else:
                    got = arrays_of(whole, KEY, i)
                    hashes = key_hashes(got)
                of = ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
                cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
                rows = []
                for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = {"raw": got["raw"][ends[x] : ends[y]], "long": got["long"][x:y]} if words else {f: got[f][x:y] for f in KEY}
                    rows.append({"bucket": int(of[x]), "chunk": whole.column("chunk")[i].as_py(), "n": y - x, **{f: to_bytes(v) for f, v in part.items()}})
                yield pa.record_batch([pa.array([r.get(f.name) for r in rows], f.type) for f in ASK_ARROW], schema=ASK_ARROW)

    return run


def _answer(words: bool, level: int, buckets: int):
    """Numbers for what a bucket is asked: equal things get one, whichever chunks ask."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = {f: np.concatenate([from_bytes(x, kind) for x in table.column(f).to_pylist()]) for f, kind in ({"raw": np.uint8, "long": np.int32} if words else KEY).items()}
        if words:
            ends = np.cumsum(got["long"], dtype=np.int64)
            _, of = distinct_pieces(got["raw"], ends - got["long"], ends)
        else:
            _, of = distinct_keys(got)
        names = (of * buckets + key[0].as_py()) * NAMINGS + level
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "name": pa.array([to_bytes(x) for x in np.split(names, np.cumsum(table.column("n").to_numpy())[:-1])], pa.binary())})

    return run


def named(state: DataFrame, words: bool, level: int, least: int) -> DataFrame:
    """(chunk, bucket, name): the answers to what the chunks of ``state`` ask."""
    total = state.agg(F.coalesce(F.sum("names"), F.lit(0))).first()[0]
    buckets = max(least, -(-int(total) // NAMES))
    asked = state.select("chunk", *(("raw", "long") if words else KEY)).mapInArrow(_ask(words, buckets), ASK)
    return asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer(words, level, buckets), ANSWER)


def names_from(answers: pa.Table) -> np.ndarray:
    names = answers.column("name").to_pylist()
    return np.concatenate([np.zeros(0, np.int64), *(from_bytes(names[i], np.int64) for i in np.argsort(answers.column("bucket").to_numpy()))])


# ---- rounds


def compressed(symbol: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> Arrays:
    """STATE after a round over symbols that start at word ``start`` with the context lo .. hi - 1; negative symbols are separators, which stay alone."""
    length = start[-1] + 1  # the last symbol is a separator
    first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
    last = np.r_[first[1:], len(symbol)] - 1
    s, n = symbol[first], (last - first + 1).astype(np.int32)
    # a run hangs on the neighbours that differ from it
    start, lo, hi = start[first], lo[np.maximum(first - 1, 0)], hi[np.minimum(last + 1, len(symbol) - 1)]
    coin = s.view(U64) * U64(0xD1342543DE82EF95 + 2 * level) + n.astype(U64) * U64(0xA24BAED4963EE407)
    coin = (coin ^ (coin >> U64(32))) * U64(0xD6E8FEB86659FD93) >> U64(63) == U64(1)
    word = s >= 0
    pair = np.zeros(len(s), bool)
    pair[:-1] = coin[:-1] & ~coin[1:] & word[:-1] & word[1:]
    at = np.flatnonzero(np.r_[True, ~pair[:-1]])
    two, left = pair[at], coin[at]
    after, before = np.minimum(at + 1, len(s) - 1), np.maximum(at - 1, 0)
    # a left symbol hangs on what follows it, a right one on what it follows
    lo, hi, start = np.where(left, lo[at], lo[before]), np.where(left, hi[after], hi[at]), start[at]
    new = (two | (n[at] > 1)) & word[at]
    first, two, after = at[new], two[new], after[new]
    key = {"s1": s[first], "n1": n[first], "s2": np.where(two, s[after] + 1, 0), "n2": np.where(two, n[after], 0).astype(np.int32)}
    one, of = distinct_keys(key)
    code = word[at].astype(np.int32)
    code[new] = of + 2
    small = lambda x: x.astype(np.int32)
    return {"step": small(np.diff(np.r_[start, length])), "before": small(start - lo), "after": small(hi - start), "code": code, "symbol": s[at[code == 1]], **{f: v[one] for f, v in key.items()}}


def symbols_of(rows: pa.Table, answers: pa.Table, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbol, start, lo and hi of a chunk's state with the names of its keys put in."""
    s = arrays_of(rows, {f: kind for f, kind in STATE.items() if f not in KEY}, at)
    code, names = s["code"], names_from(answers)
    symbol = -1 - np.cumsum(code == 0)  # separators differ from each other
    symbol[code == 1] = s["symbol"]
    symbol[code > 1] = names[code[code > 1] - 2]
    start = np.cumsum(s["step"], dtype=np.int64) - s["step"]
    return symbol, start, start - s["before"], start + s["after"]


@tidy
def _words(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
    w = arrays_of(rows, READ)
    return row_of(key[0].as_py(), 0, {"doc": w["doc"], "begin": w["begin"], "size": w["size"], "words": names_from(answers)[w["code"]]})


def separated(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The words of pieces of these sizes with a separator before, between and after them."""
    ends = np.cumsum(size + 1)
    out = -1 - np.arange(int(ends[-1]) + 1, dtype=np.int64)
    out[flat_ranges(ends - size, size)] = words
    return out


@tidy
def _first_round(key: tuple, rows: pa.Table) -> pa.Table:
    words = separated(**arrays_of(rows, {"words": np.int64, "size": np.int64}))
    place = np.arange(len(words), dtype=np.int32)
    state = compressed(words, place, place, place + 1, 0)
    return row_of(key[0].as_py(), len(state["s1"]), state)


def _next_round(level: int):
    @tidy
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        state = compressed(*symbols_of(rows, answers), level)
        return row_of(key[0].as_py(), len(state["s1"]), state)

    return run


def longest(names: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of symbols left .. right - 1 the one of the most words; of those the least by hashed name, the leftmost of equals."""
    rank = (U64(255) - np.minimum(words, 255).astype(U64)) << U64(56) | mix(names.view(U64)) >> U64(8)
    best = [np.arange(len(names))]
    span = right - left
    for k in range(int(span.max()).bit_length() - 1 if len(span) else 0):
        a, b = best[k][: -(1 << k)], best[k][1 << k :]
        best.append(np.where(rank[b] < rank[a], b, a))
    out = left.copy()
    for k, row in enumerate(best):
        of = (span >> k) == 1
        a, b = row[left[of]], row[right[of] - (1 << k)]
        out[of] = np.where(rank[b] < rank[a], b, a)
    return out


def anchors(symbol: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: np.ndarray, windows: np.ndarray, width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of each window's anchor."""
    left, right = np.searchsorted(lo, windows), np.searchsorted(hi, windows + width, "right")
    some = left < right
    chosen = longest(symbol, np.diff(np.r_[start, len(words)]), left[some], right[some])
    at, called = windows.copy(), np.empty(len(windows), U64)
    at[some], called[some] = start[chosen], symbol[chosen].view(U64)
    bare = windows[~some]
    called[~some] = keyed_symbols(words, bare, bare + width, key)
    return at, called


def _close(width: int, buckets: int, run_key: int):
    """The last round's names put in, and the entries of all windows of a chunk packed by their anchor's bucket."""

    @tidy
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        w = arrays_of(rows, WORDS)
        n = w["size"] - width + 1
        windows = flat_ranges(np.cumsum(w["size"] + 1) - w["size"], n)
        words = separated(w["words"], w["size"])
        at, called = anchors(*symbols_of(rows, answers), words, windows, width, run_key)
        entries = R.entries_of(windows, at, called, np.repeat(w["doc"], n), flat_ranges(w["begin"], n), words, width, run_key + 10)
        return pa.Table.from_batches(list(R.packed_batches(iter([entries]), width, False, buckets)), R.PACKED_ARROW)

    return run


def matched_entries(docs: DataFrame, width: int, buckets: int, key: int) -> DataFrame:
    """Repeated stretches (kind 1) and torn entries (kinds 2 and 3) by what shares a symbol after rounds_for(width) rounds of naming, saved.

    Chunks stay where they are: their tables are bucketed by chunk, so only questions and answers move."""
    live: list[DataFrame] = []

    def kept(df: DataFrame, name: str, moved: bool = True) -> DataFrame:
        live.append(saved_by(df, f"recompression-{name}", "chunk", buckets, moved))
        return live[-1]

    def met(state: DataFrame, words: bool, level: int, more: DataFrame | None = None):
        asked = named(state, words, level, buckets)
        return (state if more is None else state.join(more.drop("names").hint("merge"), "chunk")).groupBy("chunk").cogroup(asked.groupBy("chunk"))

    try:
        read = kept(docs.mapInArrow(_read(width), kinds(READ)), "read", False)
        words = kept(met(read, True, 0).applyInArrow(_words, kinds(WORDS)), "words")
        discard(read)
        state = kept(words.groupBy("chunk").applyInArrow(_first_round, kinds(STATE)), "round")
        for level in range(1, rounds_for(width)):
            state, old = kept(met(state, False, level).applyInArrow(_next_round(level), kinds(STATE)), "round"), state
            discard(old)
        packed = met(state, False, rounds_for(width), words).applyInArrow(_close(width, buckets, key), R.PACKED)
        return saved(packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(R.matched(width, False), R.PACKED), "recompression-matched")
    finally:
        for table in live:
            discard(table)


# ---- verification and removal


def _torn_words(width: int, buckets: int, key: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            e, row = torn_of(b)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            for i, j in row_chunks(offsets, CHUNK // 4):
                if cuts[i] < cuts[j]:
                    text = data[offsets[i] : offsets[j]]
                    starts, ends, counts = word_bounds(text, offsets[i : j + 1] - offsets[i])
                    part, base = R.take(e, np.arange(cuts[i], cuts[j])), np.r_[0, np.cumsum(counts)]
                    yield R.content_batch(part, base[row[cuts[i] : cuts[j]] - i] + part["pos"], R.Units.of_words(text, starts, ends), width, buckets, key)

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, spans): stretches of words of each document covered by windows that start in a document with a smaller doc_id."""
    buckets, key = buckets_of(docs), draw()
    matched = matched_entries(docs, width, buckets, key)
    torn = docs.join(torn_by_document(matched), "doc_id").mapInArrow(_torn_words(width, buckets, key), R.CONTENT)
    found = saved(compare_windows(torn, buckets, True, width, False, key).unionByName(matched.where("kind = 1").mapInArrow(R.unpack_spans, R.SPANS)), "recompression-spans")
    discard(matched)
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _keep(texts: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200))):
            rows = []
            for doc, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                s = R.merged(np.zeros(len(spans or [])), np.array([x["start"] for x in spans or []], np.int64), np.array([x["end"] for x in spans or []], np.int64))
                for x, y in zip(s["pos"][::-1], s["print"][::-1], strict=True):
                    del words[int(x) : int(y)]
                kept = b" ".join(words)
                rows.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup_passages(documents: DataFrame, width: int = WIDTH, texts: bool = True) -> DataFrame:
    """Per document: its words, those removed, and what is kept with its hash (see the module). texts: return kept_text too."""
    docs = unique_documents(documents)
    return docs.join(repeated_spans(docs, width), "doc_id", "left").mapInArrow(_keep(texts), DIGEST)
