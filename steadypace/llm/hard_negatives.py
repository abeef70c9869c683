"""Hard negatives by exact scores: Strassen products of integer tiles and mergeable heaps.

Vectors become integers (floor of each component times ``SCALE``), so a score, the inner product of an
anchor and another row, is exact. A tile is a block of anchors against a block of candidates; its scores
come from Strassen's recursion on int64 matrices: seven products of halves and exact additions, with zero
padding where a side is odd. Integer arithmetic loses nothing, also where a sum of quarters is larger
than any entry of the result.

Two passes over the candidates, each without a shuffle of vectors. The first keeps, for each anchor, a
heap of the ``positives`` best other rows of its label; the second keeps, for each anchor and positive,
a heap of the ``negatives`` best rows of other labels whose score lies in the positive's window. A task merges
its tiles into its heaps and gives out the heaps alone; merging those of all tasks is a ranking whose
first rows are picked before the shuffle as well. All pairs of anchors and rows are scored, which is the
operator's work; no pair leaves a task unless it is in a heap.

Anchors are a stated query set. They go to the tasks in blocks of at most ``anchor_bytes``, a bound that no
input moves: more anchors mean more passes, not a larger broadcast.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part, nor
do rows with a component whose integer is over the limit that keeps scores of the longest vector within 60 bits
(2**27 for 64 components, that is 2**19 before scaling). A missing component (vectors of different lengths) counts as 0. Equal scores are
ordered by ``vec_id``, nulls last, then by the row. Repeated rows are rows of their own, so an anchor's repeat
is one of its other rows and an anchor itself. A null ``vec_id`` is no anchor but may be found. Columns other
than the three named ones are not read. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.session import materialise

SCALE = 256
LEAF = 16  # sides from here on are multiplied directly
TILE = 1024  # candidates of a tile
ANCHOR_TILE = 512
LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by Strassen's seven products (Winograd's fifteen additions)."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ np.asfortranarray(b)  # columns in one piece each: three times as fast
    # One row or column of zeros makes an odd side even.
    a = np.pad(a, ((0, n % 2), (0, k % 2))) if n % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, m % 2))) if k % 2 or m % 2 else b
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    low = a21 + a22
    cross = low - a11
    right = b12 - b11
    corner = b22 - right
    p11 = strassen(a11, b11, leaf)
    mixed = strassen(cross, corner, leaf) + p11
    shifted = mixed + strassen(a11 - a21, b22 - b12, leaf)
    wide = strassen(low, right, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p11 + strassen(a12, b21, leaf)
    out[:i, l:] = mixed + wide + strassen(a12 - cross, b22, leaf)
    out[i:, :l] = shifted - strassen(a22, corner - b21, leaf)
    out[i:, l:] = shifted + wide
    return out[:n, :m]


def integer_rows(rows: DataFrame, vector: str, vec_id: str, label: str) -> DataFrame:
    """id, label, vector (array<long>) of the rows that take part, and a number of each row. Longer
    vectors hold smaller integers: the limit follows the longest vector of the table."""
    known = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"))
    whole = known.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    longest = whole.agg(F.max(F.size("vector"))).first()[0] or 1
    limit = float(math.isqrt((1 << 60) // max(longest, 1)))
    scaled = whole.withColumn("vector", F.transform("vector", lambda x: x * F.lit(float(SCALE)))).where(
        F.forall("vector", lambda x: F.abs(x) < F.lit(limit)))
    return scaled.withColumn("vector", F.transform("vector", lambda x: F.floor(x).cast("long"))).withColumn(
        "row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Anchors:
    """A block of anchors; ``windows``: scores of the positives, ``LOWEST`` where there are fewer."""

    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    windows: np.ndarray | None = None


@dataclass
class Heaps:
    """The best ``size`` candidates of each place as sorted rows (score, id, row); merged tile by tile. An entry
    is better with a higher score, then a smaller id, nulls last, then a smaller row."""

    places: int
    size: int

    def __post_init__(self) -> None:
        self.score = np.full((self.places, self.size), LOWEST)
        self.id = np.zeros((self.places, self.size), np.int64)
        self.no_id = np.ones((self.places, self.size), bool)
        self.row = np.full((self.places, self.size), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, tile: Tile, first: int = 0, step: int = 1) -> None:
        """Scores (places first, first + step, ... by the tile's candidates, which are in order of id and row);
        ``LOWEST`` is no candidate."""
        worst = self.score[first::step, -1][: len(scores)]
        if scores.shape[1] > self.size:
            worst = np.maximum(worst, np.partition(scores, -self.size, axis=1)[:, -self.size])
        bound = worst[:, None]
        # Fewer than ``size`` are above the bound; of those at the bound the first in order are enough.
        even = (scores == bound) & (scores > LOWEST)
        many = np.flatnonzero(even.sum(1) > self.size)
        even[many] &= np.cumsum(even[many], 1) <= self.size
        place, at = np.nonzero((scores > bound) | even)
        if len(place) == 0:
            return
        owner = first + place * step
        touched = np.unique(owner)
        n = self.size
        old = np.repeat(touched, n)
        keys = np.concatenate([old, owner])
        score = np.concatenate([self.score[touched].ravel(), scores[place, at]])
        ids = np.concatenate([self.id[touched].ravel(), tile.id[at]])
        no_id = np.concatenate([self.no_id[touched].ravel(), tile.no_id[at]])
        row = np.concatenate([self.row[touched].ravel(), tile.row[at]])
        order = np.lexsort((row, ids, no_id, ~score, keys))  # ~ turns the order of all integers
        starts = np.searchsorted(keys[order], touched)
        best = order[(starts[:, None] + np.arange(n)).ravel()]
        for name, values in (("score", score), ("id", ids), ("no_id", no_id), ("row", row)):
            getattr(self, name)[touched] = values[best].reshape(-1, n)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        place, at = np.nonzero(self.score > LOWEST)
        return place, self.score[place, at], self.id[place, at], self.no_id[place, at], self.row[place, at]


@dataclass(frozen=True)
class Tile:
    """Candidates in order of id (nulls last) and row, as columns."""

    id: np.ndarray
    no_id: np.ndarray
    row: np.ndarray
    label: np.ndarray
    columns: np.ndarray


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """One row per vector, shorter ones filled with zeros."""
    ends = vectors.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width), np.int64)
    values = vectors.values.to_numpy()[ends[0] : ends[-1]]
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _tiles(batch: pa.RecordBatch, width: int) -> Iterator[Tile]:
    column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    ids, row, label = batch.column("id"), column("row"), column("label")
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    vectors = _matrix(batch.column("vector"), width)
    order = np.lexsort((row, ids, no_id))
    for lo in range(0, len(order), TILE):
        own = order[lo : lo + TILE]
        yield Tile(ids[own], no_id[own], row[own], label[own], np.ascontiguousarray(vectors[own].T))


FOUND = "anchor_row long, positive_row long, score long, id long, row long"


def _found(heaps: Heaps, anchors: Anchors, positive_rows: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    place, score, ids, no_id, row = heaps.entries()
    anchor, positive = (place, None) if positive_rows is None else divmod(place, positive_rows.shape[1])
    for lo in range(0, len(place), 50_000):
        part = slice(lo, lo + 50_000)
        own = anchor[part]
        yield pa.record_batch({
            "anchor_row": pa.array(anchors.row[own]),
            "positive_row": pa.nulls(len(own), pa.int64()) if positive is None
            else pa.array(positive_rows[own, positive[part]]),
            "score": pa.array(score[part]),
            "id": pa.array(ids[part], mask=no_id[part]),
            "row": pa.array(row[part]),
        })


def _pass(rows: DataFrame, anchors: Anchors, size: int, positive_rows: np.ndarray | None = None) -> DataFrame:
    """Each task's heaps for a block of anchors: of the positives, or with ``positive_rows`` of their windows."""
    shared = with_package(rows.sparkSession).sparkContext.broadcast((anchors, positive_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, positives = shared.value
        slots = 1 if positives is None else positives.shape[1]
        heaps, seen = Heaps(len(own.row) * slots, size), False
        for batch in batches:
            for tile in _tiles(batch, own.vectors.shape[1]):
                seen = True
                for lo in range(0, len(own.row), ANCHOR_TILE):
                    part = slice(lo, lo + ANCHOR_TILE)
                    scores = strassen(own.vectors[part], tile.columns)
                    same = own.label[part, None] == tile.label
                    if positives is None:
                        same &= own.row[part, None] != tile.row
                        heaps.add(np.where(same, scores, LOWEST), tile, lo)
                        continue
                    scores[same] = LOWEST
                    for slot in range(slots):
                        top = own.windows[part, slot, None]
                        low = -(-4 * top // 5)  # the least integer of at least 80 %
                        fits = (scores <= top) & (scores >= low) & (top > LOWEST)
                        heaps.add(np.where(fits, scores, LOWEST), tile, lo * slots + slot, slots)
        if seen:
            yield from _found(heaps, own, positives)

    return rows.select("row", "id", "label", "vector").mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Merge the tasks' heaps: the best ``size`` entries of each key with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _block(anchors: pa.Table, width: int) -> Anchors:
    vectors = anchors.column("vector").combine_chunks()
    return Anchors(anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), _matrix(vectors, width))


def hard_negatives(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
                   anchor_every: int = 100, positives: int = 5, negatives: int = 5,
                   anchor_bytes: int = 32 << 20) -> DataFrame:
    """For each anchor (``vec_id`` divisible by ``anchor_every``) and each of its ``positives`` best rows of the same
    label: the ``negatives`` best rows of other labels with 80 to 100 % of the positive's score. Returns
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    kept = materialise(integer_rows(rows, vector, vec_id, label))
    queries = kept.where(F.col("id") % anchor_every == 0)
    width, count = queries.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    out_schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                  "negative_score long")
    if not count:
        return rows.sparkSession.createDataFrame([], out_schema)
    width = max(width, 1)
    # Also the windows and the rows of the positives go along.
    blocks = -(-count * (width + 2 * positives + 2) * 8 // anchor_bytes)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    parts = []
    for i in range(blocks):
        anchors = _block(queries.where(block == i).orderBy("row").toArrow(), width)
        if not len(anchors.row):
            continue
        best = materialise(_first(_pass(kept, anchors, positives), ["anchor_row"], positives))
        near = best.select("anchor_row", "row", "score", "rank").toArrow()
        at = np.searchsorted(anchors.row, near.column("anchor_row").to_numpy())
        slot = near.column("rank").to_numpy() - 1
        windows = np.full((len(anchors.row), positives), LOWEST)
        positive_rows = np.full((len(anchors.row), positives), -1, np.int64)
        windows[at, slot] = near.column("score").to_numpy()
        positive_rows[at, slot] = near.column("row").to_numpy()
        found = _pass(kept, Anchors(anchors.row, anchors.label, anchors.vectors, windows), negatives, positive_rows)
        ranked = _first(found, ["anchor_row", "positive_row"], negatives)
        known = best.select("anchor_row", F.col("row").alias("positive_row"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
        parts.append(ranked.join(known, ["anchor_row", "positive_row"]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    ids = queries.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    return whole.join(ids, "anchor_row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def shifted_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows with the label of each ``every``-th id moved on by one."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
    return rows.withColumn("label", F.coalesce(moved, F.col("label")))
