"""Operator 13, LM scoring: an n-gram model in Elias-Fano tries, counted, kept and asked in Spark.

Tokens are words, A-Z folded, and an end after each text; every text also has a begin before it, which is only context. The model mixes orders:

    P1(w) = (c(w) + 1) / (N + V + 1)      P(w | context) = c(context w) / (c(context) + M) + M / (c(context) + M) * P(w | shorter context)

M = MASS[order], over the counts of all training texts, none left out: sums to one at each order, as unknown words share one place of P1.

A trie level holds the n-grams of one length: the contexts (nodes of the level above), pointers to where each one's successors begin, the successors, and for
each its share c(context w) / (c(context) + M) as a code of 1 / STEPS decades, rounded down so that no sum exceeds one; all but the last level
hold counts too. Contexts, pointers, successors (raised by the successors before them) and running counts are monotone, so they stand in Elias-Fano
form. A successor is not the word but its rank among the words known to follow the context without its first word, a far smaller number, and it is
searched for between its context's two pointers, by the sequence's successor search. A level is dealt to buckets by context, and a context of over SPLIT tokens
to several by its successors; a bucket is one binary value of a Parquet table, and a task reads its arrays in place, as views of the Arrow buffer that Spark
hands it (an executor has no file of its own to map).

Chunks of text stay where they are, in tables bucketed by chunk. Order by order they ask for their distinct n-grams (with their counts in training texts) and get
nodes, ranks and codes: a bucket's asks are first summed into its part of the level, then answered from it. A word or n-gram is asked for once a chunk, however often it stands.
Equality is that of bytes (words) and numbers (n-grams); hashes only deal to buckets.

Rows: null text counts as empty (the end alone); each row is scored, also rows that share a doc_id or have none (those train). Long texts are cut into pieces that overlap by the
context. No training text: each token has probability 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets_of, discard, flat_ranges, row_chunks, saved, saved_by, text_bytes, tidy, word_bounds
from .elias_fano import Monotone
from .hashing import U64, mix, piece_hashes
from .recompression import distinct_pieces, from_bytes, to_bytes
from .shingles import FOLD

ORDER, STEPS, ABSENT = 3, 4096, 65535
#: weight of the shorter context's probabilities, in tokens, at each order from 2 on
MASS = {2: 300.0, 3: 20.0}
#: bytes of text and tokens in a chunk, tokens in a piece of a long text, tokens of a context beyond which its successors are split, tokens for each bucket
CHUNK, CHUNK_TOKENS, SEGMENT, SPLIT, BUCKET_TOKENS = 6_000_000, 1 << 20, 1 << 16, 1 << 17, 1_500_000
BLANK = np.array([0x20, 0x20], np.uint8)

Arrays = dict[str, np.ndarray]
#: of a chunk: its pieces (row, doc_id and its absence, held out, first token, tokens scored, tokens of context before them), tokens as places among its distinct words, and those words' bytes.
#: Place 0 is the begin and place 1 the end, written as blanks, which no word has.
READ = {"row": np.int64, "doc": np.int64, "none": np.int8, "held": np.int8, "begin": np.int64, "size": np.int64, "lead": np.int64, "code": np.int32, "raw": np.uint8, "long": np.int32}
#: the same with the words' nodes (number + 1, or 0) and counts
NAMED = {**{f: READ[f] for f in ("row", "doc", "none", "held", "begin", "size", "lead", "code")}, "node": np.int64, "count": np.int64}
#: of a chunk's distinct n-grams: node + 1 (or 0), number among successors, count
GRAMS = {"node": np.int64, "item": np.int64, "count": np.int64}
WORD_ASK, GRAM_ASK = {"raw": np.uint8, "long": np.int32, "count": np.int64}, {"context": np.int64, "item": np.int64, "count": np.int64, "total": np.int64}
WORD_ANSWER, GRAM_ANSWER = {"found": np.int64, "count": np.int64}, {"place": np.int64, "rank": np.int64, "count": np.int64}
#: the last level tells shares alone; those of the others follow from their counts
LAST_ANSWER = {"share": np.int32}
#: contexts and places ascend in a message: they go as steps, no step being what is not found
STEPPED = ("context", "place")


def binaries(keys: str, fields: dict) -> str:
    return keys + ", " + ", ".join(f"`{f}` binary" for f in fields)


def packed(keys: dict[str, pa.DataType], rows: list[dict], fields: dict) -> pa.Table:
    """Rows of plain keys and packed arrays."""
    return pa.table({**{k: pa.array([r[k] for r in rows], t) for k, t in keys.items()}, **{f: pa.array([_pack(f, r[f]) for r in rows], pa.binary()) for f in fields}})


def _pack(field: str, values: np.ndarray) -> bytes:
    if field in STEPPED:
        values = np.diff(np.maximum.accumulate(values), prepend=0)
    return squeezed(values.astype(np.int64).tobytes() if field == "doc" else to_bytes(values))  # ids may be negative


def _unpack(field: str, raw: bytes, kind: type) -> np.ndarray:
    values = from_bytes(opened(raw), kind)
    if field == "place":
        return np.where(values > 0, np.cumsum(values), 0)
    return np.cumsum(values) if field == "context" else values


_ZSTD = pa.Codec("zstd", 3)


def squeezed(raw: bytes) -> bytes:
    """Bytes for a shuffle, whose own codec finds repeats but not what is merely frequent."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def opened(raw: bytes) -> bytes:
    return _ZSTD.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def arrays(rows: pa.Table | pa.RecordBatch, fields: dict, i: int = 0) -> Arrays:
    raw = {f: opened(rows.column(f)[i].as_py()) for f in fields}
    return {f: np.frombuffer(raw[f], np.int64) if f == "doc" else from_bytes(raw[f], kind) for f, kind in fields.items()}


def joined(rows: pa.Table, fields: dict) -> Arrays:
    """The arrays of all rows, one after the other."""
    return {f: np.concatenate([np.zeros(0, kind), *(_unpack(f, x, kind) for x in rows.column(f).to_pylist())]) for f, kind in fields.items()}


# ---- chunks of text


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to CHUNK bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of text."""
    chunk = base_row = TaskContext.get().partitionId() << 40
    for b in gathered(batches):
        data, offsets = text_bytes(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        held = b.column("held_out").to_numpy(zero_copy_only=False)
        for i, j in row_chunks(offsets, CHUNK):
            text = FOLD[data[offsets[i] : offsets[j]]]
            starts, ends, words = word_bounds(text, offsets[i : j + 1] - offsets[i])
            starts, ends = np.r_[len(text), len(text), starts], np.r_[len(text) + 2, len(text) + 1, ends]  # begin and end of texts come first
            text = np.r_[text, BLANK]
            counts = words + 1  # and the end
            first = np.cumsum(words) - words + 2
            pieces = -(-counts // SEGMENT)
            row = np.repeat(np.arange(j - i), pieces)
            begin = flat_ranges(np.zeros(j - i, np.int64), pieces) * SEGMENT
            size = np.minimum(begin + SEGMENT, counts[row]) - begin
            lead = np.minimum(begin, ORDER - 2) + 1  # the begin, or tokens before
            for x, y in row_chunks(np.r_[0, np.cumsum(size)], CHUNK_TOKENS):
                r, place = row[x:y], begin[x:y] - lead[x:y]
                within = flat_ranges(place, lead[x:y] + size[x:y])
                of = np.repeat(r, lead[x:y] + size[x:y])
                at = np.where(within < 0, 0, np.where(within == words[of], 1, first[of] + within))
                one, code = distinct_pieces(text, starts[np.r_[0, 1, at]], ends[np.r_[0, 1, at]])
                often = np.bincount(code, minlength=len(one))
                often[code[:2]] = len(code) + 2, len(code) + 1
                place_of = np.argsort(-often, kind="stable")  # begin and end to the front, then the most frequent: small numbers
                new = np.empty(len(one), np.int64)
                new[place_of] = np.arange(len(one))
                one = np.r_[0, 1, at][one[place_of]]
                n = (ends - starts)[one]
                found = {
                    "row": base_row + r, "doc": np.array([ids[i + k] or 0 for k in r.tolist()], np.int64), "none": np.array([ids[i + k] is None for k in r.tolist()], np.int8), "held": held[i:j][r].astype(np.int8),
                    "begin": begin[x:y], "size": size[x:y], "lead": lead[x:y], "code": new[code[2:]].astype(np.int32), "raw": text[flat_ranges(starts[one], n)], "long": n.astype(np.int32),
                }
                yield from packed({"chunk": pa.int64()}, [{"chunk": chunk, **found}], READ).to_batches()
                chunk += 1
            base_row += j - i


def scored(c: Arrays) -> np.ndarray:
    """Whether each token of the stream is scored; the others are context."""
    out = np.ones(len(c["code"]), bool)
    length = c["lead"] + c["size"]
    out[flat_ranges(np.cumsum(length) - length, c["lead"])] = False
    return out


def trained(c: Arrays) -> np.ndarray:
    """Each token's weight in counts: one where it is scored and its text trains."""
    return scored(c) & ~np.repeat(c["held"], c["lead"] + c["size"]).astype(bool)


def paired(c: Arrays, of: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the n-gram that ends at each token or -1, left and right parts of each distinct one); of: the same for n - 1, node: their nodes + 1."""
    of = np.where(np.r_[node, 0][of] > 0, of, -1)
    before = np.r_[-1, of[:-1]]
    before[np.cumsum(c["lead"] + c["size"])[:-1]] = -1
    live = np.flatnonzero((before >= 0) & (of >= 0))
    key, number = numbered(before[live].astype(np.int64) * len(node) + of[live])
    out = np.full(len(of), -1, np.int64)
    out[live] = number
    return out, *np.divmod(key, max(len(node), 1))


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; the number of each key among them)."""
    by = np.argsort(key)
    ranked = key[by]
    new = np.ones(len(by), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(new) - 1
    return ranked[new], out


def ordered(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Places by bucket, in their order inside each."""
    return np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")


def splits(total: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts that each context's successors are dealt to, the part of each item)."""
    parts = 1 + total // SPLIT
    return parts, (mix(item.astype(U64)) % parts.astype(U64)).astype(np.int64)


def dealt(context: np.ndarray, item: np.ndarray, total: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, their order by bucket, context and item)."""
    part = splits(total, item)[1]
    bucket = (mix(context.astype(U64) * U64(0x9E3779B97F4A7C15) + part.astype(U64)) % U64(buckets)).astype(np.int64)
    wide = int(item.max(initial=0)).bit_length()
    high = wide + int(context.max(initial=0)).bit_length()
    if high + buckets.bit_length() < 63:
        return bucket, np.argsort(bucket << high | context << wide | item)
    return bucket, np.lexsort((item, context, bucket))


def in_buckets(bucket: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist() if len(bucket) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


ASK_KEYS = {"bucket": pa.int32(), "chunk": pa.int64(), "n": pa.int32()}


def _ask_words(buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = arrays(b, READ, i)
                ends = np.cumsum(c["long"], dtype=np.int64)
                starts = ends - c["long"]
                count = np.bincount(c["code"], weights=trained(c), minlength=len(ends)).astype(np.int64)
                bucket, by = word_buckets(c["raw"], starts, ends, buckets)
                rows = []
                for x, y in in_buckets(bucket[by]):
                    at = by[x:y]
                    rows.append({"bucket": int(bucket[at[0]]), "chunk": b.column("chunk")[i].as_py(), "n": y - x, "raw": c["raw"][flat_ranges(starts[at], c["long"][at].astype(np.int64))], "long": c["long"][at], "count": count[at]})
                yield from packed(ASK_KEYS, rows, WORD_ASK).to_batches()

    return run


def word_buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (piece_hashes(raw, starts, ends) % U64(buckets)).astype(np.int64)
    return bucket, ordered(bucket, buckets)


def _ask_grams(level: int, buckets: int):
    """What chunks ask of a level: (chunk's named words, and its n-grams of the levels between)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, known = arrays(b, NAMED, i), [arrays(b.select([f"{f}{k}" for f in GRAMS]).rename_columns(list(GRAMS)), GRAMS, i) for k in range(2, level)]
                of, ask = asked(c, known)
                weight = trained(c)[of >= 0]
                ask["count"] = np.bincount(of[of >= 0], weights=weight, minlength=len(ask["item"])).astype(np.int64)
                bucket, by = dealt(ask["context"], ask["item"], ask["total"], buckets)
                rows = [{"bucket": int(bucket[by[x]]), "chunk": b.column("chunk")[i].as_py(), "n": y - x, **{f: ask[f][by[x:y]] for f in GRAM_ASK}} for x, y in in_buckets(bucket[by])]
                yield from packed(ASK_KEYS, rows, GRAM_ASK).to_batches()

    return run


def asked(c: Arrays, known: list[Arrays]) -> tuple[np.ndarray, Arrays]:
    """(number of the n-gram at each token, what to ask for each distinct one) at the level after ``known``."""
    of, level = c["code"].astype(np.int64), {"node": c["node"], "item": c["node"], "count": c["count"]}
    for nxt in [*known, None]:
        of, left, right = paired(c, of, level["node"])
        if nxt is None:
            return of, {"context": level["node"][left], "item": level["item"][right], "total": level["count"][left]}
        level = nxt
    raise AssertionError


# ---- levels


def answered(table: pa.Table, found: Arrays, fields: dict) -> pa.Table:
    cuts = np.cumsum(table.column("n").to_numpy())[:-1]
    parts = {f: np.split(v, cuts) for f, v in found.items()}
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), **{f: pa.array([_pack(f, x) for x in parts[f]], pa.binary()) for f in fields}})


WORD_ROWS = binaries("chunk long, bucket int, words long, tokens long", {**WORD_ANSWER, "raw": 0, "long": 0, "total": 0})
GRAM_ROWS = binaries("chunk long, bucket int, level binary", {**GRAM_ANSWER, **LAST_ANSWER})
WORD_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), *((f, pa.binary()) for f in (*WORD_ANSWER, "raw", "long", "total"))])
GRAM_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("level", pa.binary()), *((f, pa.binary()) for f in (*GRAM_ANSWER, *LAST_ANSWER))])


def together(schema: pa.Schema, parts: list[pa.Table]) -> pa.Table:
    """Tables of some of the columns as one; columns that a table lacks are null."""
    return pa.concat_tables([pa.table([t.column(f.name) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema], schema=schema) for t in parts])


def found_words(table: pa.Table, a: Arrays, v: Arrays) -> pa.Table:
    """Answers from a bucket of the vocabulary, v."""
    ends = np.cumsum(np.r_[v["long"], a["long"]], dtype=np.int64)
    one, of = distinct_pieces(np.r_[v["raw"], a["raw"]], np.r_[0, ends[:-1]], ends)
    n = len(v["long"])
    at = np.zeros(len(one), np.int64)
    at[of[:n]] = np.arange(n) + 1
    found = at[of[n:]]
    return answered(table, {"found": found, "count": np.r_[0, v["total"]][found]}, WORD_ANSWER)


@tidy
def _learn_words(key: tuple, table: pa.Table) -> pa.Table:
    """A bucket's training words with their counts (one row), and the answers to its asks from them."""
    a = joined(table, WORD_ASK)
    ends = np.cumsum(a["long"], dtype=np.int64)
    starts = ends - a["long"]
    one, of = distinct_pieces(a["raw"], starts, ends)
    total = np.bincount(of, weights=a["count"], minlength=len(one)).astype(np.int64)
    some = one[total > 0]
    total = total[total > 0]
    v = {"raw": a["raw"][flat_ranges(starts[some], a["long"][some].astype(np.int64))], "long": a["long"][some], "total": total}
    row = {"bucket": key[0].as_py(), "words": len(some), "tokens": int(total.sum()), **v}
    return together(WORD_SCHEMA, [packed({"bucket": pa.int32(), "words": pa.int64(), "tokens": pa.int64()}, [row], {"raw": 0, "long": 0, "total": 0}), found_words(table, a, v)])


@tidy
def _find_words(key: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
    return together(WORD_SCHEMA, [found_words(table, joined(table, WORD_ASK), joined(held, {"raw": np.uint8, "long": np.int32, "total": np.int64}))])


def shares(count: np.ndarray, total: np.ndarray, mass: float) -> np.ndarray:
    """Codes of count / (total + mass), rounded down; ABSENT where count is 0."""
    some = count > 0
    code = np.ceil(-np.log10(np.where(some, count, 1) / (total + mass)) * STEPS - 1e-9)
    return np.where(some, np.clip(code, 0, ABSENT - 1), ABSENT).astype(np.int32)


def trie_level(context: np.ndarray, item: np.ndarray, count: np.ndarray, total: np.ndarray, mass: float, counts: bool) -> bytes:
    """A bucket of a level from its n-grams, ascending by (context, item)."""
    first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    pointers = np.r_[first, len(context)]
    raise_by = np.r_[0, np.cumsum(item[pointers[1:-1] - 1] + 1)] if len(first) else np.zeros(0, np.int64)
    share = shares(count, total, mass).astype(np.uint16)
    sequences = [context[first], pointers, item + np.repeat(raise_by, np.diff(pointers))] + ([np.r_[0, np.cumsum(count)]] if counts else [])
    return np.array([len(sequences)], np.int64).tobytes() + b"".join(map(Monotone.dump, sequences)) + share.tobytes()


class TrieLevel:
    """A bucket of a level, read in place."""

    def __init__(self, raw: memoryview | bytes) -> None:
        at, self.parts = 8, []
        for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
            self.parts.append(Monotone(raw, at))
            at = self.parts[-1].end
        self.contexts, self.pointers, self.successors = self.parts[:3]
        self.counts = len(self.parts) > 3
        self.shares = np.frombuffer(raw, np.uint16, self.successors.n, at)

    def find(self, context: np.ndarray, item: np.ndarray) -> Arrays:
        """place (+ 1, or 0), rank among the context's successors, count (0 in the last level) and share of each n-gram."""
        n = len(context)
        out = {"place": np.zeros(n, np.int64), "rank": np.zeros(n, np.int64), "count": np.zeros(n, np.int64), "share": np.full(n, ABSENT, np.int32)}
        j = self.contexts.successor(context)
        live = np.flatnonzero(j < self.contexts.n)
        live = live[self.contexts.get(j[live]) == context[live]]
        begin, end = self.pointers.get(j[live]), self.pointers.get(j[live] + 1)
        base = np.zeros(len(live), np.int64)
        base[begin > 0] = self.successors.get(begin[begin > 0] - 1) + 1
        value = base + item[live]
        at = self.successors.successor(value)
        hit = np.flatnonzero(at < end)
        hit = hit[self.successors.get(at[hit]) == value[hit]]
        live, at, begin = live[hit], at[hit], begin[hit]
        out["place"][live], out["rank"][live], out["share"][live] = at + 1, at - begin, self.shares[at]
        if self.counts:
            out["count"][live] = self.parts[3].get(at + 1) - self.parts[3].get(at)
        return out


def distinct_grams(context: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct n-gram, ascending by (context, item); the number of each)."""
    wide = int(item.max(initial=0)).bit_length()
    if int(context.max(initial=0)).bit_length() + wide < 63:
        key = context << wide | item
        by = np.argsort(key)
        new = np.r_[True, key[by][1:] != key[by][:-1]] if len(by) else np.zeros(0, bool)
    else:
        by = np.lexsort((item, context))
        new = np.r_[True, (context[by][1:] != context[by][:-1]) | (item[by][1:] != item[by][:-1])]
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of


def found_grams(table: pa.Table, a: Arrays, one: np.ndarray, of: np.ndarray, raw: memoryview | bytes) -> pa.Table:
    """Answers from a bucket of a level: each distinct n-gram is looked for once."""
    level = TrieLevel(raw)
    found, fields = level.find(a["context"][one], a["item"][one]), GRAM_ANSWER if level.counts else LAST_ANSWER
    return answered(table, {f: found[f][of] for f in fields}, fields)


def _learn_grams(mass: float, counts: bool):
    """A bucket's part of a level (one row), and the answers to its asks from it."""

    @tidy
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = joined(table, GRAM_ASK)
        one, of = distinct_grams(a["context"], a["item"])
        count = np.bincount(of, weights=a["count"], minlength=len(one)).astype(np.int64)
        some = one[count > 0]
        level = trie_level(a["context"][some], a["item"][some], count[count > 0], a["total"][some], mass, counts)
        return together(GRAM_SCHEMA, [pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level], pa.binary())}), found_grams(table, a, one, of, level)])

    return run


def _find_grams(counts: bool):
    @tidy
    def run(key: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
        a = joined(table, {"context": np.int64, "item": np.int64})
        # the level's arrays are views of the buffer that Arrow holds
        raw = memoryview(held.column("level").combine_chunks()[0].as_buffer()) if held.num_rows else trie_level(*[np.zeros(0, np.int64)] * 4, 1.0, counts)
        return together(GRAM_SCHEMA, [found_grams(table, a, *distinct_grams(a["context"], a["item"]), raw)])

    return run


# ---- answers come to their chunks


def in_order(answers: pa.Table, fields: dict) -> Arrays:
    return joined(answers.sort_by("bucket"), fields)


def _name(buckets: int):
    @tidy
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = arrays(rows, READ)
        ends = np.cumsum(c["long"], dtype=np.int64)
        bucket, by = word_buckets(c["raw"], ends - c["long"], ends, buckets)
        got = in_order(answers, WORD_ANSWER)
        node, count = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        node[by] = np.where(got["found"] > 0, (got["found"] - 1) * buckets + bucket[by] + 2, 0)
        count[by] = got["count"]
        node[0], count[0] = 1 if count[1] else 0, count[1]  # texts begin as often as they end
        return packed({"chunk": pa.int64()}, [{"chunk": key[0].as_py(), **c, "node": node, "count": count}], NAMED)

    return run


def _received(ask: Arrays, answers: pa.Table, buckets: int) -> Arrays:
    """GRAMS of what a chunk has asked."""
    bucket, by = dealt(ask["context"], ask["item"], ask["total"], buckets)
    got = in_order(answers, GRAM_ANSWER)
    out = {f: np.zeros(len(by), kind) for f, kind in GRAMS.items()}
    parts, part = splits(ask["total"], ask["item"])
    out["node"][by] = np.where(got["place"] > 0, (got["place"] - 1) * buckets + bucket[by] + 1, 0)
    out["item"][by] = got["rank"] * parts[by] + part[by]
    out["count"][by] = got["count"]
    return out


def _known(rows: pa.Table, level: int) -> list[Arrays]:
    return [arrays(rows.select([f"{f}{k}" for f in GRAMS]).rename_columns(list(GRAMS)), GRAMS) for k in range(2, level)]


def _learn(level: int, buckets: int):
    """A chunk's n-grams of a level with what was found of them."""

    @tidy
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = _received(asked(arrays(rows, NAMED), _known(rows, level))[1], answers, buckets)
        return packed({"chunk": pa.int64()}, [{"chunk": key[0].as_py(), **out}], GRAMS).rename_columns(["chunk", *(f"{f}{level}" for f in GRAMS)])

    return run


PIECES = "row long, doc_id long, held_out boolean, begin long, n_tokens long, n_known long, base_score double, score double"


def _score(level: int, buckets: int, tokens: int, words: int):
    """A row for each piece of a text."""

    @tidy
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        c, known = arrays(rows, NAMED), _known(rows, level)
        p = (c["count"][c["code"]] + 1) / (tokens + words + 1)
        real, base = scored(c), np.log10(p)
        of, state = c["code"].astype(np.int64), {"node": c["node"], "item": c["node"], "count": c["count"]}
        for order, mass in MASS.items():
            before = np.r_[-1, of[:-1]]
            before[np.cumsum(c["lead"] + c["size"])[:-1]] = -1
            context = np.where(before >= 0, np.r_[state["count"], 0][before], 0)
            of, left, right = paired(c, of, state["node"])
            if order < level:
                nxt = known[order - 2]
                share = shares(nxt["count"], state["count"][left], mass)
            else:
                nxt, share = {}, np.empty(len(left), np.int32)
                share[dealt(state["node"][left], state["item"][right], state["count"][left], buckets)[1]] = in_order(answers, LAST_ANSWER)["share"]
            share = np.r_[share, ABSENT][of]
            p = np.where(share < ABSENT, 10.0 ** (-share / STEPS), 0.0) + mass / (context + mass) * p
            state = nxt
        first = np.cumsum(c["size"]) - c["size"]
        sums = [np.add.reduceat(x[real], first) for x in ((c["count"][c["code"]] > 0).astype(np.int64), base, np.log10(p))]
        return pa.table({"row": c["row"], "doc_id": pa.array(c["doc"], mask=c["none"].astype(bool)), "held_out": c["held"].astype(bool), "begin": c["begin"], "n_tokens": c["size"], "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    return run


# ---- models


@dataclass
class Model:
    """Tables by bucket: vocabulary (words and counts) and the tries' levels; numbers of training tokens and of different ones."""

    vocabulary: DataFrame
    levels: list[DataFrame]
    buckets: int
    tokens: int
    words: int


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def run(documents: DataFrame, held: Column, model: Model | None = None, keep: bool = True) -> tuple[Model, DataFrame]:
    """The model (learned from the rows that are not held out, unless one is given) and the scores of all rows. keep: whether the model's tables stay for other documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    made: list[DataFrame] = []
    try:
        return _walk(docs, model, keep, made)
    finally:
        for table in made:
            discard(table)


def _walk(docs: DataFrame, model: Model | None, keep: bool, made: list[DataFrame]) -> tuple[Model, DataFrame]:
    """As run; made: tables that go at the end."""
    spread = buckets_of(docs)

    def kept(df: DataFrame, name: str, moved: bool = True) -> DataFrame:
        made.append(saved_by(df, f"lm-{name}", "chunk", spread, moved))
        return made[-1]

    chunks = kept(docs.mapInArrow(_read, binaries("chunk long", READ)), "read", False)
    fit = model is None
    if fit:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        model = Model(None, [], max(spread, -(-int(size) // (6 * BUCKET_TOKENS))), 0, 0)  # a token has six bytes, about

    def told(state: DataFrame, ask, fields: dict, table: DataFrame | None, learn, find, kinds: str) -> DataFrame:
        """Answers to what chunks ask, saved, with the rows of what is learned from the asks where there is no table yet."""
        asks = state.mapInArrow(ask, binaries("bucket int, chunk long, n int", fields)).repartition(model.buckets, "bucket").groupBy("bucket")
        return saved(asks.applyInArrow(learn, kinds) if table is None else asks.cogroup(table.groupBy("bucket")).applyInArrow(find, kinds), "lm-answers")

    def met(state: DataFrame, answers: DataFrame, fields: dict):
        return state.groupBy("chunk").cogroup(answers.where("chunk IS NOT NULL").select("chunk", "bucket", *fields).repartition(spread, "chunk").groupBy("chunk"))

    answers = told(chunks, _ask_words(model.buckets), WORD_ASK, model.vocabulary, _learn_words, _find_words, WORD_ROWS)
    if fit:
        learned = answers.where("chunk IS NULL")
        model.words, model.tokens = learned.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        if keep:
            model.vocabulary = saved(learned.select("bucket", "raw", "long", "total"), "lm-vocabulary")
    state = kept(met(chunks, answers, WORD_ANSWER).applyInArrow(_name(model.buckets), binaries("chunk long", NAMED)), "named")
    discard(answers)
    discard(chunks)
    for level in range(2, ORDER + 1):
        known = None if fit else model.levels[level - 2]
        answers = told(state, _ask_grams(level, model.buckets), GRAM_ASK, known, _learn_grams(MASS[level], level < ORDER), _find_grams(level < ORDER), GRAM_ROWS)
        if fit and keep:
            model.levels.append(saved(answers.where("chunk IS NULL").select("bucket", "level"), f"lm-level{level}"))
        if level < ORDER:
            found = kept(met(state, answers, GRAM_ANSWER).applyInArrow(_learn(level, model.buckets), "chunk long, " + ", ".join(f"{f}{level} binary" for f in GRAMS)), "grams")
            state = state.join(found.hint("merge"), "chunk")
            discard(answers)
    pieces = saved(met(state, answers, LAST_ANSWER).applyInArrow(_score(ORDER, model.buckets, model.tokens, model.words), PIECES), "lm-pieces")
    discard(answers)
    return model, _whole(pieces, model)


def _whole(pieces: DataFrame, model: Model) -> DataFrame:
    """The pieces of each text together, added in their order."""
    add = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, x: a + x[f]).alias(f)
    whole = pieces.groupBy("row", "doc_id", "held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sort_array(F.collect_list(F.struct("begin", "base_score", "score"))).alias("parts"))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), add("base_score"), add("score"))


def fit_and_score(documents: DataFrame) -> DataFrame:
    """Scores of all documents by the model of those that are not held out (see the module)."""
    return run(documents, held_out(), keep=False)[1]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Scores of other documents by a model."""
    return run(documents, F.lit(True), model)[1]


def forget(model: Model) -> None:
    """Delete a model's tables."""
    for table in (model.vocabulary, *model.levels):
        discard(table)
