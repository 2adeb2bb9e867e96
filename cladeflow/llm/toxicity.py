"""Operator 4, toxicity by cumulative-link ordinal regression.

Severity has ordered grades 0 .. ``grades`` - 1. P(grade > k) = sigmoid(w . x - c_k) for ordered cuts c_k: all
thresholds share the weights w over sparse word features. ``fit_ordinal`` takes graded labels. Labels that only say toxic or not, as here, hold no
severity: they are graded first, toxic documents by how much of the words that set the toxic labels apart they hold, in equal parts. So of these scores P(grade > 0) is
learned from labels, and the grades above order toxic documents by the weight of their toxic words, no more. Features are words and their first bytes (stems), hashed, with log counts; those whose
share differs most between the classes are kept. The expected severity is the sum of P(grade > k).

Fitting uses a bounded sample (``labelled`` rows at most, chosen by a hash of doc_id); all rows are scored.

Rows: null text counts as empty and scores as a text without known words; labels other than 0 and 1, and contradicting ones, are left out; of rows that share a doc_id the one that sorts first stands for the label. With
labels of one class only, or none, everything scores 0 (or the top grade, if all labels are toxic). Repeated rows score alike. An
empty table gives an empty result. Other columns are ignored.
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
from .quality import known_labels, one_each, prepared

SIZE = 1 << 18


@dataclass
class Ordinal:
    kept: np.ndarray  # hashed features, ascending
    weights: np.ndarray
    cuts: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> X.Sparse:
    """Words with log counts; with ``kept``, only those, numbered in its order."""
    row, index, count = X.words_and_stems(data, offsets, SIZE)
    if kept is not None:
        at = np.minimum(np.searchsorted(kept, index), max(0, len(kept) - 1))
        ok = kept[at] == index if len(kept) else np.zeros(len(index), bool)
        row, index, count = row[ok], at[ok], count[ok]
    return X.stacked([(row, index, np.log1p(count))], len(offsets) - 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offsets in X.rows_of(batches):
        yield pa.record_batch([b.column("doc_id"), b.column("label"), *X.sparse_lists(features(data, offsets))], names=["doc_id", "label", "text_index", "text_value"])


def graded(x: X.Sparse, y: np.ndarray, kept: np.ndarray, odds: np.ndarray, grades: int) -> np.ndarray:
    """0 for labels 0; 1 .. grades - 1 for labels 1, in equal parts by the summed log odds of the telling words."""
    weight = np.zeros(SIZE)
    weight[kept] = np.maximum(odds, 0)
    held = x.dot(weight)
    out = np.zeros(len(y), np.int64)
    toxic = np.flatnonzero(y == 1)
    place = np.argsort(np.argsort(held[toxic], kind="stable"), kind="stable")
    out[toxic] = 1 + place * (grades - 1) // max(1, len(toxic))
    return out


def telling(x: X.Sparse, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features whose document shares differ most between the classes (z score), and their log odds."""
    ones = np.ones(len(x.index))
    by = [np.bincount(x.index, ones * np.repeat(y == c, np.diff(x.offsets)), SIZE) for c in (0, 1)]
    n = [max(1.0, float((y == c).sum())) for c in (0, 1)]
    odds = np.log((by[1] + 0.5) / (n[1] - by[1] + 0.5)) - np.log((by[0] + 0.5) / (n[0] - by[0] + 0.5))
    spread = np.sqrt(1 / (by[1] + 0.5) + 1 / (n[1] - by[1] + 0.5) + 1 / (by[0] + 0.5) + 1 / (n[0] - by[0] + 0.5))
    z = np.where(by[0] + by[1] >= 3, np.abs(odds / spread), 0)
    best = np.argsort(-z, kind="stable")[:most]
    best = np.sort(best[z[best] >= 4.0])
    return best, odds[best]


def fit_ordinal(x: X.Sparse, grade: np.ndarray, size: int, grades: int, steps: int = 300, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered cuts by Adam; the cuts are a first one and the logs of the gaps to the next."""
    params = np.zeros(size + grades - 1)
    m, v = np.zeros_like(params), np.zeros_like(params)
    share = np.array([max(1e-3, min(0.999, float((grade > k).mean()))) for k in range(grades - 1)])
    first = -np.log(share / (1 - share))
    params[size] = first[0]
    params[size + 1 :] = np.log(np.maximum(np.diff(first), 0.1))
    n = len(grade)
    for t in range(1, steps + 1):
        w, gaps = params[:size], np.exp(params[size + 1 :])
        cuts = params[size] + np.r_[0, np.cumsum(gaps)]
        z = x.dot(w)
        above = X.sigmoid(z[:, None] - cuts)  # P(grade > k)
        bounds = np.c_[np.ones(n), above, np.zeros(n)]
        p = np.maximum(bounds[np.arange(n), grade] - bounds[np.arange(n), grade + 1], 1e-9)
        slope = np.c_[np.zeros(n), above * (1 - above), np.zeros(n)]
        upper, lower = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        gz = -(upper - lower) / p / n
        gc = np.zeros(grades + 1)
        np.add.at(gc, grade, upper / p / n)
        np.add.at(gc, grade + 1, -lower / p / n)
        gc = gc[1:-1]
        g = np.r_[x.back(gz, size) + penalty * w, gc.sum(), gaps * np.cumsum(gc[::-1])[::-1][1:]]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= 0.1 / np.sqrt(1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return params[:size], params[size] + np.r_[0, np.cumsum(np.exp(params[size + 1 :]))]


def fit_toxicity(documents: DataFrame, labels: DataFrame, grades: int = 4, labelled: int = 10000, most: int = 512, seed: int = 13) -> Ordinal:
    docs = prepared(documents)
    known = X.bounded_sample(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(known_labels(labels, "toxic"), "doc_id"), "doc_id", labelled, seed)
    rows = one_each(docs.join(F.broadcast(known), "doc_id"))  # labelled rows of two numbers at most
    table = rows.select("doc_id", "label", "text").mapInArrow(_extract, "doc_id long, label int, text_index array<int>, text_value array<float>").toArrow().sort_by("doc_id")
    y = table.column("label").to_numpy()
    none = np.zeros(0, np.int64)
    if not len(y) or y.min() == y.max():
        return Ordinal(none, np.zeros(0), np.full(grades - 1, -30.0 if len(y) and y[0] else 30.0))
    x = X.gathered(table, "text")
    kept, odds = telling(x, y, most)
    grade = graded(x, y, kept, odds, grades)
    at = np.minimum(np.searchsorted(kept, x.index), max(0, len(kept) - 1))
    ok = kept[at] == x.index if len(kept) else np.zeros(len(x.index), bool)
    row = np.repeat(np.arange(len(x)), np.diff(x.offsets))
    small = X.stacked([(row[ok], at[ok], x.value[ok])], len(x))
    return Ordinal(kept, *fit_ordinal(small, grade, len(kept), grades))


def _score(shared):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b, data, offsets in X.rows_of(batches):
            z = features(data, offsets, model.kept).dot(model.weights) if len(model.kept) else np.zeros(b.num_rows)
            above = X.sigmoid(z[:, None] - model.cuts)
            yield pa.record_batch([b.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(1), pa.int32())], names=["doc_id", "expected_severity", "p_toxic", "grade"])

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Ordinal | None = None, **parameters) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every row; toxic: P(grade > 0) of at least ``threshold``."""
    model = model or fit_toxicity(documents, labels, **parameters)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most ``most`` words and their weights
    return prepared(documents).mapInArrow(_score(shared), "doc_id long, expected_severity double, p_toxic double, grade int").withColumn("toxic", F.col("p_toxic") >= threshold)
