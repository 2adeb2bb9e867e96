"""Token output against direct encoding."""

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cladeflow.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
HARD = ["", " ", "Don't stop.", "ΑΣ Σ. ΣΑΣ,", "İstanbul,", "A..B ,. x.,", "ﬁne Ångström é.", "<|endoftext|> <|ENDOFTEXT|>.", "²³ ½. ªº.", "a b c. \x0b\x1c d", "ǅ. ŒUVRE. ẞ.", "日本語。テスト. ", "x" * 3000 + ".", "it's 'S. 'LL,", "word.\n\nword,\tWORD."]


def plain(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def encoded(encode, texts):
    import pyarrow as pa

    ids, counts = encode(*tokens.text_bytes(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_hard_texts():
    encode = tokens.Encoder(PATH)
    for _ in range(2):
        assert encoded(encode, HARD) == [plain(t) for t in HARD]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(tokens.encoder(PATH), texts) == [plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAé.,ÉH\u0301\u0331'<|> \n1×÷Kß", max_size=12))
def test_rims(text):
    assert encoded(tokens.encoder(PATH), [text]) == [plain(text)]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 5)
    encode = tokens.Encoder(PATH)
    for text in ["one two three.", "four Five six seven", "One two eight nine ten", "one, two three"] * 2:
        assert encoded(encode, [text]) == [plain(text)]


def test_round_trip(spark, tmp_path):
    rows = [(5, "Second text."), (1, None), (9, ""), (-3, "x " * 5000), (None, "no id"), (5, "Second text."), (5, "Another.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS part", "3 AS row")
    path = f"file://{tmp_path}/out"
    got = sorted(tokens.token_output(docs, PATH, path=path).collect(), key=lambda r: r.start)
    at, expected = 0, [(None, "no id"), (-3, "x " * 5000), (1, ""), (5, "Another."), (5, "Second text."), (5, "Second text."), (9, "")]
    for (doc, text), row in zip(expected, got, strict=True):
        ids = [*plain(text), 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.ids for r in tokens.read_tokens(spark, path, [9]).collect()] == [[1]]
    assert tokens.token_output(docs.limit(0), PATH).count() == 0


def thue_morse(n, a="a", b="b"):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(b if x else a for x in bits)


def test_equal_polynomials():
    """Words that share every polynomial hash modulo a power of two."""
    encode = tokens.Encoder(PATH)
    for k in range(9, 14):
        texts = [thue_morse(1 << k), thue_morse(1 << k, "b", "a")]
        assert encoded(encode, [" ".join(texts)])[0] == plain(texts[0]) + plain(texts[1])
        assert encoded(encode, texts[::-1]) == [plain(t) for t in texts[::-1]]


def test_equal_names(monkeypatch):
    """Units whose names collide, in one text and over texts, still get their own ids."""
    monkeypatch.setattr(tokens, "unit_names", lambda data, starts, ends: (ends - starts).astype(np.uint64) % 3)
    encode = tokens.Encoder(PATH)
    for text in ["one two three four. six", "five, seven eight", "One TWO x y zebra"] * 2:
        assert encoded(encode, [text]) == [plain(text)]
