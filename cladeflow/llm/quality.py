"""Operator 2, quality classifier by co-training.

Two logistic classifiers see a document differently: one its text (words and their shapes), one its page metadata
(source, language, layout). They start from the same labels; in each round each scores a pool of unlabelled documents (drawn once, of bounded
size, as in co-training as it was published) and hands those it is surest of, with its own label, to the other. Held-out labelled documents then calibrate each view (Platt) and
weigh the two calibrated views against each other; all documents are scored with the combination.

Fitting uses bounded samples (``labelled``, ``pool``: at most so many rows, chosen by a hash of doc_id); features and scores cover all rows.

Rows: null text, source and language count as empty; labels other than 0 and 1 and labels that contradict each other for one
doc_id are left out; of rows that share a doc_id the one that sorts first by text, source and language stands for the label. With labels of one class only, or none, every document scores the share of good labels (0.5
without any). Repeated rows score alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from .common import tidy

VIEWS = {"text": X.TEXT_SIZE, "meta": X.META_SIZE}


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    platt: dict[str, tuple[float, float]]
    mix: np.ndarray  # weights of the calibrated views' logits, and the bias
    constant: float | None = None


def prepared(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c).cast("string") if c in documents.columns else F.lit(None), F.lit("")).alias(c) for c in ("text", "source", "lang")))


def _views(b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, X.Sparse]:
    return {"text": X.text_view(data, offsets), "meta": X.meta_view(data, offsets, b.column("source"), b.column("lang"))}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in X.rows_of(batches):
        views = _views(b, data, offsets)
        yield pa.record_batch([b.column("doc_id"), b.column("label"), *X.sparse_lists(views["text"]), *X.sparse_lists(views["meta"])], names=["doc_id", "label", "text_index", "text_value", "meta_index", "meta_value"])


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) where the labels of a document agree."""
    ok = labels.where(f"doc_id IS NOT NULL AND {column} IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return ok.agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("most")).where("label = most").drop("most")


def sample(documents: DataFrame, labels: DataFrame, labelled: int, pool: int, seed: int) -> pa.Table:
    """Features of the bounded samples; label -1 marks the pool."""
    ids = documents.select("doc_id").where("doc_id IS NOT NULL").distinct()
    known = X.bounded_sample(ids.join(labels, "doc_id"), "doc_id", labelled, seed)
    others = X.bounded_sample(ids.join(labels.select("doc_id"), "doc_id", "left_anti"), "doc_id", pool, seed + 1).withColumn("label", F.lit(-1))
    chosen = F.broadcast(known.unionByName(others))  # labelled + pool rows of two numbers at most
    rows = one_each(documents.join(chosen, "doc_id"))
    kinds = "doc_id long, label int, text_index array<int>, text_value array<float>, meta_index array<int>, meta_value array<float>"
    return rows.mapInArrow(_extract, kinds).toArrow().sort_by("doc_id")  # any run sees the same rows in the same order


def one_each(rows: DataFrame) -> DataFrame:
    """(doc_id, label, text, source, lang): of rows that share a doc_id the one that sorts first; these are bounded samples."""
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", "source", "lang")).alias("first")).select("doc_id", "label", "first.*")


def surest(p: np.ndarray, free: np.ndarray, share: float, per_round: int) -> np.ndarray:
    """Rows of the pool to hand over: the surest of either class, in the proportion of the labels, none under 0.9."""
    good = [i for i in np.argsort(-p, kind="stable") if free[i] and p[i] >= 0.9][: max(1, round(share * per_round))]
    bad = [i for i in np.argsort(p, kind="stable") if free[i] and p[i] <= 0.1][: max(1, round((1 - share) * per_round))]
    return np.array(good + bad, np.int64)


def joined(parts: list[X.Sparse]) -> X.Sparse:
    ends = np.cumsum([0, *(len(p.index) for p in parts)])
    return X.Sparse(np.concatenate([p.index for p in parts]), np.concatenate([p.value for p in parts]), np.concatenate([[0], *(p.offsets[1:] + e for p, e in zip(parts, ends[:-1], strict=True))]))


def co_train(table: pa.Table, rounds: int, per_round: int) -> Model:
    label = table.column("label").to_numpy()
    data = {v: X.gathered(table, v) for v in VIEWS}
    rows, pool = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
    if len(rows) < 10 or label[rows].min() == label[rows].max():
        return Model({}, {}, np.zeros(3), float(label[rows].mean()) if len(rows) else 0.5)
    held = np.arange(len(rows)) % 5 == 4
    train, test = rows[~held], rows[held]
    y = label.astype(float)
    if y[train].min() == y[train].max():
        train = rows
    share = float(y[train].mean())
    lent = {v: (np.zeros(0, np.int64), np.zeros(0)) for v in VIEWS}  # pseudo-labelled rows that each view learns from
    weights: dict[str, np.ndarray | None] = dict.fromkeys(VIEWS)
    for r in range(rounds + 1):
        for v, size in VIEWS.items():
            at, says = lent[v]
            x = joined([data[v].take(train), data[v].take(at)])
            weights[v] = X.fit_logistic(x, np.r_[y[train], says], size, np.r_[np.ones(len(train)), np.full(len(at), 0.5)], weights[v], steps=80 if r == 0 else 25)
        if r < rounds and len(pool):
            for v, other in (("text", "meta"), ("meta", "text")):
                p = X.sigmoid(data[v].take(pool).dot(weights[v][:-1]) + weights[v][-1])
                free = ~np.isin(pool, lent[other][0])
                chosen = surest(p, free, share, per_round)
                lent[other] = np.r_[lent[other][0], pool[chosen]], np.r_[lent[other][1], (p[chosen] > 0.5).astype(float)]
    raw = {v: data[v].take(test).dot(weights[v][:-1]) + weights[v][-1] for v in VIEWS}
    platt = {v: X.fit_platt(raw[v], y[test]) for v in VIEWS}
    logits = np.stack([platt[v][0] * raw[v] + platt[v][1] for v in VIEWS], 1)
    return Model(weights, platt, combine(logits, y[test]))


def combine(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two calibrated logits and a bias, held near an even mixture."""
    even = np.array([0.5, 0.5, 0.0])
    if len(y) < 20 or y.min() == y.max():
        return even
    z = np.c_[np.clip(logits, -12, 12), np.ones(len(y))]
    w = even.copy()
    for _ in range(40):
        p = X.sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(3)
        w -= np.clip(np.linalg.solve(h, z.T @ (p - y) + 1.0 * (w - even)), -0.5, 0.5)
    return w


def score(model: Model, views: dict[str, X.Sparse]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of a good page: by text, by metadata, combined."""
    n = len(views["text"])
    if model.constant is not None:
        return (np.full(n, model.constant),) * 3
    logits = [np.clip(model.platt[v][0] * (x.dot(model.weights[v][:-1]) + model.weights[v][-1]) + model.platt[v][1], -12, 12) for v, x in views.items()]
    return X.sigmoid(logits[0]), X.sigmoid(logits[1]), X.sigmoid(model.mix[0] * logits[0] + model.mix[1] * logits[1] + model.mix[2])


def _score(shared):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offsets in X.rows_of(batches):
            yield pa.record_batch([b.column("doc_id"), *(pa.array(p) for p in score(shared.value, _views(b, data, offsets)))], names=["doc_id", "p_text", "p_meta", "quality"])

    return run


def fit_quality(documents: DataFrame, labels: DataFrame, labelled: int = 6000, pool: int = 4000, rounds: int = 3, per_round: int = 400, seed: int = 11) -> Model:
    """Co-train on bounded samples (see the module)."""
    return co_train(sample(prepared(documents), known_labels(labels, "quality"), labelled, pool, seed), rounds, per_round)


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None, **parameters) -> DataFrame:
    """(doc_id, p_text, p_meta, quality, keep) of every row; keep: quality of at least ``threshold``."""
    model = model or fit_quality(documents, labels, **parameters)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed size
    return prepared(documents).mapInArrow(_score(shared), "doc_id long, p_text double, p_meta double, quality double").withColumn("keep", F.col("quality") >= threshold)


def _keep(shared, threshold: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cols = {c: (whole.column(c).cast(pa.string()) if c in whole.schema.names else pa.nulls(whole.num_rows, pa.string())).fill_null("") for c in ("text", "source", "lang")}
            seen = pa.record_batch([pa.array(np.arange(whole.num_rows)), *cols.values()], names=["row", *cols])
            good = [np.zeros(0, bool)]
            for b, data, offsets in X.rows_of(iter([seen])):
                good.append(score(shared.value, _views(b, data, offsets))[2] >= threshold)
            yield whole.filter(pa.array(np.concatenate(good)))

    return run


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Model | None = None, **parameters) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that score at least ``threshold``."""
    model = model or fit_quality(documents, labels, **parameters)
    return documents.mapInArrow(_keep(documents.sparkSession.sparkContext.broadcast(model), threshold), documents.schema)
