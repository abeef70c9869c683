"""Training rows for the classifiers: a bounded, balanced sample of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steadypace.session import materialise


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text, y, weight: at most ``per_class`` documents of each class, picked by a hash of the id.
    ``weight`` restores the classes' shares among all training rows. Labels of ids that ``docs`` does not
    have count for nothing. Rows with a null id or label and
    labels that contradict each other are left out."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_most"))
        .where(F.col("y") == F.col("_most")).drop("_most")
    )
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"))
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else float(share)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    weight = F.when(F.col("y") == 1, F.lit(2 * share)).otherwise(F.lit(2 * (1 - share)))
    # At most 2 * per_class ids: a bound that no input moves.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.withColumn("weight", weight).dropDuplicates(["doc_id"])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift that turn margins into log-odds of the labels (logistic regression on one number,
    by Newton steps, with a light ridge on the slope). Margins are taken in units of their spread."""
    unit = float(margin.std()) or 1.0
    x = np.stack([margin / unit, np.ones_like(margin)], 1)
    w = weight / weight.sum()
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - y)) + np.array([ridge * b[0], 0])
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([ridge, 1e-9])
        step = np.linalg.solve(curve, grad)
        b -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
    return float(b[0] / unit), float(b[1])
