"""The pipeline on a small table, every stage against plain Python, and the layout of the token files."""

import glob
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cladeflow.llm import quality, tokens

from .test_operators import DOCS, edits, jaccard_classes

PATH = public_tokenizers.path("word_bpe_49k.json")


def tables(folder, spark, clash):
    rng = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "st", "ll")]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, prose(30)) for i in range(3)]
    rows, labels = [], []
    for i in range(140):
        good, source = i % 4 != 0, f"s{i % 3}"
        text = prose(rng.randint(20, 60))
        if i % 9 == 1 and len(rows) > 5:
            text = rows[-5][1] or ""
            if i % 2:
                text += " tail"
        if i % 10 == 3:
            text += " " + items[i % 3][1] + " " + prose(4)
        if not good:
            text, source = " ".join(w.upper() + "!!" for w in text.split()), "junk"
        rows.append((i, text, "en", source, len(text)))
        labels.append((i, int(good), 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, prose(20), "en", "s1", 1), (7, rows[7][1] + " again", "en", "s1", 3), (502, "word " * 3000, "en", "s2", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in clash:
        docs = docs.selectExpr("*", f"concat('x', doc_id) AS {c}")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def poisson(mean, u):
    p = total = math.exp(-mean)
    n = 0
    while total <= u:
        n += 1
        p *= mean / n
        total += p
    return n


@pytest.mark.parametrize("clash", [(), ("copy", "n_copies", "kept", "leak", "row", "component_id", "label")])
def test_pipeline(spark, tmp_path, clash):
    folder = f"file://{tmp_path}"
    items = tables(folder, spark, clash)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, got = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, got, folder)
        out.write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        assert name == "token_output" or got.columns == docs.columns
        kept[name] = got.collect()
    key = lambda r: (r.doc_id, r.text)
    # each document that scores the threshold
    scored = quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = Counter(r.doc_id for r in scored.collect() if r.keep)
    assert Counter(r.doc_id for r in kept["quality_classifier"]) == good and 90 < sum(good.values()) < 125
    # the least of each class of near copies
    one = {}
    for r in sorted((r for r in kept["quality_classifier"] if r.doc_id is not None), key=lambda r: (r.doc_id, r.text or "")):
        one.setdefault(r.doc_id, r)
    classes = jaccard_classes([tuple(r)[:5] for r in one.values()], 5, 80, 100)
    assert sorted(map(str, (key(r) for r in kept["jaccard_join"]))) == sorted(str(key(r)) for d, r in one.items() if classes[d][1] == d)
    assert len(kept["jaccard_join"]) < len(one)
    # none with a stretch of 100 bytes of an item
    fold = lambda t: " ".join((t or "").lower().split())
    leaks = set()
    for r, (_, item) in itertools.product(kept["jaccard_join"], items):
        x, t = fold(item), fold(r.text)
        if any(x[s : s + 8] in t for s in range(0, len(x) - 8, 4)) and min(edits(x[s : s + 100], t) for s in range(0, max(1, len(x) - 99), 9)) <= 10:
            leaks.add(r.doc_id)
    assert {r.doc_id for r in kept["decontamination"]} == {r.doc_id for r in kept["jaccard_join"]} - leaks and leaks
    # as many copies as the Poisson quantile says
    before = kept["decontamination"]
    sources = Counter(r.source or "" for r in before)
    copies = Counter()
    for r in before:
        u = int(hashlib.md5(f"17:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        copies[r.doc_id] += poisson(len(before) / len(sources) / sources[r.source or ""], u)
    assert Counter(r.doc_id for r in kept["mixing"]) == +copies
    # ids of the texts in the order of doc_id and text
    encode, at = Tokenizer.from_file(PATH), 0
    rows = sorted(kept["token_output"], key=lambda r: r.start)
    for r, (doc, text) in zip(rows, sorted((r.doc_id, r.text or "") for r in kept["mixing"]), strict=True):
        ids = [*encode.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pipeline_run(spark, tmp_path):
    tables(f"file://{tmp_path}", spark, ())
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 20
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/{t}.parquet").limit(0).write.parquet(f"file://{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0


def test_orc_layout(spark, tmp_path):
    """Stripes, row indexes and Bloom filters stand in the files, and a search by doc_id reads few rows."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(3 * i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60))) for i in range(12_000)], "doc_id long, text string")
    path = f"file://{tmp_path}/out"
    tokens.write_tokens(docs, PATH, path, stride=1000, stripe_mb=1)
    orc, hadoop = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    rows = stripes = 0
    for file in glob.glob(f"{tmp_path}/out/*.orc"):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.OrcFile.readerOptions(hadoop))
        assert reader.getRowIndexStride() == 1000 and str(reader.getCompressionKind()) == "ZSTD"
        rows, stripes = rows + reader.getNumberOfRows(), stripes + reader.getStripes().size()
        records = reader.rows()
        streams = Counter(str(x.getKind()) for s in reader.getStripes() for x in records.readStripeFooter(s).getStreamsList())
        assert streams["ROW_INDEX"] >= 4 and streams["BLOOM_FILTER_UTF8"] >= 1
        encodings = {str(e.getKind()) for s in reader.getStripes() for e in records.readStripeFooter(s).getColumnsList()}
        assert "DIRECT_V2" in encodings  # integer run lengths, second version
        records.close()
    assert rows == 12_000 and stripes >= len(glob.glob(f"{tmp_path}/out/*.orc"))
    assert [r.doc_id for r in tokens.read_tokens(spark, path, [333]).collect()] == [333]
    assert tokens.read_tokens(spark, path, [334]).count() == 0
