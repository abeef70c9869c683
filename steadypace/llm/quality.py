"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and character n-grams, hashed into a
fixed number of rows, followed by a softmax over both classes; it is trained by stochastic gradient
descent in numpy (steps scaled by the gradients so far). A word that repeats the one before it is one
more hashed word. Once trained, each row's vector times the output layer is one number, so scoring is a
lookup and an average; the whole text counts.

The model has a fixed size (``ROWS`` x ``DIMENSIONS``) and is fitted on at most ``per_class`` labelled
documents of each class. Scoring is one pass without a shuffle.

Nulls: a null or empty text has no features and gets the score of the bias alone; a null id is scored as
other rows. Repeated rows are each scored. Without labelled rows of both classes every score is 0.5 and
``keep`` keeps all. Columns other than id and text are carried by ``keep`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.llm.hashing import SPACE, U, Words, ngrams, slices, text_buffers
from steadypace.llm.labelled import calibrate, held_out, training_rows

BITS = 16
NGRAMS = (3, 4)
ROWS = 2 * (1 << BITS) + 1
DIMENSIONS = 8


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document in the batch, row of the table) of every feature, in parts of bounded size."""
    data, offsets = text_buffers(column)
    found = Words(data, offsets, ~SPACE)
    owners = found.owners()
    yield owners, (found.hashes >> U(64 - BITS)).astype(np.int32)
    again = np.flatnonzero((found.hashes[1:] == found.hashes[:-1]) & (owners[1:] == owners[:-1]))
    yield owners[again + 1], np.full(len(again), ROWS - 1, np.int32)
    for owner, hashes in ngrams(data, offsets, NGRAMS):
        yield owner, (hashes >> U(64 - BITS)).astype(np.int32) + np.int32(1 << BITS)


@dataclass(frozen=True)
class QualityModel:
    """``table``: each row's vector times the output layer; ``bias`` likewise."""

    table: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for owner, rows in features(column):
            total += np.bincount(owner, self.table[rows], len(column))
            count += np.bincount(owner, minlength=len(column))
        margin = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _bags(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                parts = list(features(batch.column("text")))
                owner = np.concatenate([p[0] for p in parts]).astype(np.int64)
                row = np.concatenate([p[1] for p in parts]).astype(np.int64)
                keys, counts = np.unique(owner * ROWS + row, return_counts=True)
                ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * ROWS)
                ids, counts = (keys % ROWS).astype(np.int32), counts.astype(np.float32)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "y": batch.column("y").cast(pa.int32()), "weight": batch.column("weight"),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in zip(ends, ends[1:])],
                                       pa.binary()),
                })

    with_package(rows.sparkSession)
    return rows.select("doc_id", "text", "y", "weight").mapInArrow(
        run, "doc_id long, y int, weight double, ids binary, counts binary")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, epochs: int = 8, batch: int = 32,
          rate: float = 0.1, seed: int = 7) -> QualityModel:
    """Fit on at most ``2 * per_class`` documents, which come to the driver as bags of hashed ids."""
    rows = sorted(_bags(training_rows(docs, labels, "quality", per_class)).toLocalIterator(),
                  key=lambda r: r["doc_id"])
    rows = [r for r in rows if r["ids"]]
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(ROWS, np.float32), 0.0)
    ids = [np.frombuffer(r["ids"], np.int32) for r in rows]
    shares = [(c := np.frombuffer(r["counts"], np.float32)) / c.sum() for r in rows]
    weight = np.array([r["weight"] for r in rows])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (ROWS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full((ROWS, 1), 1e-10, np.float32), 1e-8, 1e-8
    # Every fifth row is kept from the descent, to set slope and shift by.
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside[:] = False
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~aside))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            sizes = np.array([len(ids[i]) for i in part])
            row = np.concatenate([ids[i] for i in part])
            share = np.concatenate([shares[i] for i in part])[:, None]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[row] * share, starts)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p = (p * weight[part, None] / len(part)).astype(np.float32)
            back = np.repeat(p @ out.T, sizes, axis=0) * share
            touched, place = np.unique(row, return_inverse=True)
            step = np.stack([np.bincount(place, back[:, d]) for d in range(DIMENSIONS)], 1)
            step = step.astype(np.float32)
            seen[touched] += (step**2).mean(1, keepdims=True)
            vectors[touched] -= rate * step / np.sqrt(seen[touched])
            grad = mean.T @ p
            seen_out += float((grad**2).mean())
            out -= rate * grad / np.sqrt(seen_out)
            seen_bias += float((p.sum(0) ** 2).mean())
            bias -= rate * p.sum(0) / np.sqrt(seen_bias)
    lean = out[:, 1] - out[:, 0]
    table = (vectors @ lean).astype(np.float64)
    # Averages of long texts have small margins: scaled to the labels' odds, classes weighing alike.
    margin = np.array([table[i] @ s for i, s in zip(ids, shares)])
    known = aside if aside.any() else ~aside
    margin, y = margin[known], y[known]
    even = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    slope, shift = calibrate(margin, y, even)
    return QualityModel((table * slope).astype(np.float32), shift)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.5 on)."""
    shared = with_package(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()),
                                       "score": pa.array(shared.value.scores(batch.column("text")))})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with its columns, without the rows that score below the threshold."""
    shared = with_package(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(shared.value.scores(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
