"""I-Match fingerprints with randomised lexicons.

The lexicon is all terms whose document frequency lies in a band (an inverse-document-frequency band).
A document keeps its distinct terms from the lexicon, sorted, and hashes them once for each of several random
subsets of the lexicon, from whole lexicons down to one term in 2**(SCALES - 1), with ``DRAWS`` draws of
each size. Equal texts agree in all of them; the more terms a changed text keeps, the more subsets agree.
Likeness is the share of equal hashes among the subsets of one size in which either text has a term, at the
size where it is largest; sizes with fewer than half of the draws in use do not count by themselves.

The lexicon is counted over all documents. Its size is bounded by (mean distinct terms of a document) / (low
share), whatever the number of documents, which is why it may be broadcast. A text without a term in
the band falls back on all its terms.

Neighbours in id order come from a sort inside ranges of ids: each range also gets the first document of the
range after it, so no pair is lost and no task sees more than one range.

Nulls: a null text is empty, and an empty text has the fingerprint of no terms; equal fingerprints have
likeness 1. Null ids come last in descending order; equal ids follow each other by text. An empty table
gives an empty result; a single document is its own next one. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.llm.hashing import ALNUM, U, batch_words, mix, powers, slices

DRAWS, SCALES = 8, 12
_SEEDS = mix(np.arange(1, DRAWS + 1, dtype=U) * U(0xA0761D6478BD642F))


def lexicon(docs: DataFrame, low: float, high: float) -> np.ndarray:
    """Sorted hashes of the terms in between ``low`` and ``high`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = batch_words(batch.column("text"), ALNUM)
                own = [np.unique(found.hashes[a:b])
                       for a, b in zip(found.documents[:-1], found.documents[1:])]
                terms, counts = np.unique(np.concatenate(own), return_counts=True)
                yield pa.record_batch({"term": pa.array(terms.view(np.int64)),
                                       "n": pa.array(counts.astype(np.int64))})

    total = docs.count()
    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= low * total) & (F.col("n") <= high * total))
    parts = kept.select("term").toArrow().column("term").to_numpy()
    return np.sort(np.ascontiguousarray(parts).view(U))


def signatures(column: pa.Array, known: np.ndarray) -> np.ndarray:
    """One row per text: DRAWS * SCALES hashes of 16 bits, 0 where the subset has no term of the text."""
    found = batch_words(column, ALNUM)
    n = len(column)
    kept = []
    for a, b in zip(found.documents[:-1], found.documents[1:]):
        own = np.unique(found.hashes[a:b])
        if len(known) and len(own):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            banded = own[known[at] == own]
            own = banded if len(banded) else own
        kept.append(own)
    terms = np.concatenate(kept) if kept else np.zeros(0, U)
    owners = np.repeat(np.arange(n), [len(k) for k in kept])
    out = np.zeros((n, DRAWS * SCALES), np.uint16)
    for draw, seed in enumerate(_SEEDS):
        dealt, own, left = mix(terms ^ seed), owners, terms
        for scale in range(SCALES):
            if scale:
                inside = dealt < (U(1) << U(64 - scale))
                dealt, own, left = dealt[inside], own[inside], left[inside]
            if len(left) == 0:
                break
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            up, _ = powers(int(place.max()) + 1)
            total = mix(np.add.reduceat(mix(left) * up[place], first))
            out[own[first], draw * SCALES + scale] = total % U(65535) + U(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    used = ((a != 0) | (b != 0)).reshape(-1, DRAWS, SCALES)
    same = (a == b).reshape(-1, DRAWS, SCALES) & used
    n = used.sum(1)
    best = np.where(2 * n >= DRAWS, same.sum(1) / np.maximum(n, 1), 0).max(1, initial=0)
    overall = same.sum((1, 2)) / np.maximum(n.sum(1), 1)
    return np.where((a == b).all(1), 1.0, np.maximum(best, overall))


def spell(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, range, extra: sorted inside each task by range, then extra, then descending id. The
    one extra row of a range is the document that follows its last one; after the last document comes the
    first."""
    ids = docs.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)])).first()[0] or []
    borders = F.array(*(F.lit(int(c)) for c in sorted(set(cuts)))) if cuts else F.expr("cast(array() as array<bigint>)")
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(
        F.size(F.filter(borders, lambda c: c <= F.col("doc_id"))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), place.alias("range"))
    # A row for each range: at most ``ranges`` + 1.
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))
    first = rows.join(F.broadcast(heads.withColumnRenamed("range", "head_range")),
                      (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owner = heads.select("range", F.coalesce(F.lag("range").over(order), F.min("range").over(every)).alias("to"))
    extra = first.join(F.broadcast(owner), "range").select("doc_id", "text", F.col("to").alias("range"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(extra.withColumn("extra", F.lit(1)))
    return both.repartition(ranges, "range").sortWithinPartitions(
        "range", "extra", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, low: float = 0.0005, high: float = 0.05,
                 ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next."""
    spark = with_package(docs.sparkSession)
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(lexicon(docs, low, high))

    def answer(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last of some consecutive documents."""
        known = shared.value
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
        own = signatures(pa.array(texts, pa.large_string()), known)
        changed = signatures(pa.array(edited, pa.large_string()), known)
        return pa.record_batch({
            "doc_id": pa.array(ids[:-1], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array(spell(own[:-1]), pa.string()),
            "edited_fingerprint": pa.array(spell(changed), pa.string()),
            "near_edited": pa.array(likeness(own[:-1], changed), pa.float64()),
            "near_next": pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                extra = batch.column("extra").to_pylist()
                for doc, text, last in zip(batch.column("doc_id").to_pylist(),
                                           batch.column("text").to_pylist(), extra):
                    ids.append(doc)
                    texts.append(text)
                    if last:
                        yield answer(ids, texts)
                        ids, texts = [], []
                if len(ids) > 1:
                    yield answer(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return with_next(docs, ranges).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
             "edited_fingerprint string, near_edited double, near_next double")
