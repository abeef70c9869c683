"""Ranked lexical search with range-maximum sparse tables over posting lists.

Documents are indexed in blocks. In a block they are numbered in order of ``doc_id``; each term of the queries has a posting list
(document numbers and impacts, the term's share in the document's score), and each list a sparse table, which
answers in two look-ups where the largest impact in any interval of documents is.

A query starts with all documents of a block as one interval. The sum over its terms of the range maxima bounds every
document's score in an interval. The intervals with the highest bounds are taken first; each is
split at the document with the largest single impact in it: that document is scored exactly from the same
positions that cut the posting lists for the two remaining intervals, which get bounds of their own. Intervals whose bound is
below the ``k``-th best score so far, or equal to it with no smaller ``doc_id``, are dropped. The search ends when none is
left, so the result is exact, whatever is dropped. Equal intervals are taken in order of ``doc_id``, so that a
group of copies costs no more than its first ``k``. A batch of intervals is handled at a time, as arrays.

Two passes for each block of queries: one reads the texts and stores, for each block of documents, posting lists of the queries' terms
only; counts over all documents (N, L, df) follow from them. The other searches blocks, keeping one heap per
query over all blocks of a task. Tasks give out ``k`` documents per query at most; a ranking merges them. Queries are a stated set and go
to the tasks in blocks of at most ``query_words`` words, whatever their number.

Terms are told apart by 64-bit hashes. Defined results: a null text has no terms and counts nowhere; queries without terms, and
null ones, have no rows. Repeated documents and queries are rows of their own: a repeated document takes several
ranks. A null ``doc_id`` comes after all others at equal scores; a null ``item_id`` is carried. Other columns are not
read. Empty tables give no rows.
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
from steadypace.llm.hashing import ALNUM, batch_words, slices
from steadypace.session import materialise

BLOCK_DOCS = 8192
BLOCK_POSTINGS = 2_000_000
BATCH = 64
INDEX = ("docs long, words long, doc_id array<long>, n array<long>, term array<int>, df array<int>, "
         "place array<int>, tf array<int>")


@dataclass(frozen=True)
class Queries:
    """Distinct terms of a block of queries (sorted hashes), and each query's terms with their repeats."""

    hashes: np.ndarray
    items: list[int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def parse_queries(rows: list[tuple[int, str]]) -> Queries:
    found = batch_words(pa.array([t for _, t in rows], pa.string()), ALNUM)
    hashes, at = np.unique(found.hashes, return_inverse=True)
    items, terms, repeats = [], [], []
    for (item, _), lo, hi in zip(rows, found.documents[:-1], found.documents[1:]):
        if hi > lo:
            own, count = np.unique(at[lo:hi], return_counts=True)
            items.append(item)
            terms.append(own)
            repeats.append(count)
    return Queries(hashes, items, terms, repeats)


def query_blocks(items: DataFrame, query_words: int) -> Iterator[Queries]:
    """Queries in blocks of about ``query_words`` words; the driver holds one block and one item at most."""
    block, size = [], 0
    for row in items.where(F.col("text").isNotNull()).select("item", "text").toLocalIterator():
        words = len(batch_words(pa.array([row["text"]]), ALNUM).hashes)
        if block and size + words > query_words:
            yield parse_queries(block)
            block, size = [], 0
        block.append((row["item"], row["text"]))
        size += words
    if block:
        yield parse_queries(block)


class _Gathered:
    """Documents and postings of a block while it is filled."""

    def __init__(self) -> None:
        self.docs = self.words = self.postings = self.rows = 0
        self.ids, self.no_ids, self.sizes, self.owner, self.term, self.tf = [], [], [], [], [], []

    def add(self, batch: pa.RecordBatch, hashes: np.ndarray) -> None:
        found = batch_words(batch.column("text"), ALNUM)
        counts = found.counts()
        self.docs += int((counts > 0).sum())
        self.words += len(found.hashes)
        at = np.minimum(np.searchsorted(hashes, found.hashes), len(hashes) - 1)
        known = np.flatnonzero(hashes[at] == found.hashes)
        pairs, tf = np.unique(found.owners()[known] * len(hashes) + at[known], return_counts=True)
        owner, term = np.divmod(pairs, len(hashes))
        # Only documents with a term of the queries can be found.
        kept, owner = np.unique(owner, return_inverse=True)
        ids = batch.column("doc_id").cast(pa.int64())
        self.ids.append(ids.fill_null(0).to_numpy()[kept])
        self.no_ids.append(ids.is_null().to_numpy(zero_copy_only=False)[kept])
        self.sizes.append(counts[kept])
        self.owner.append(owner + self.rows)
        self.term.append(term)
        self.tf.append(tf)
        self.rows += len(kept)
        self.postings += len(term)

    def full(self) -> bool:
        return self.rows >= BLOCK_DOCS or self.postings >= BLOCK_POSTINGS

    def batch(self) -> pa.RecordBatch:
        empty = [np.zeros(0, np.int64)]
        ids, sizes = np.concatenate(self.ids or empty), np.concatenate(self.sizes or empty)
        no_ids = np.concatenate(self.no_ids or [np.zeros(0, bool)])
        order = np.lexsort((ids, no_ids))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[np.concatenate(self.owner or empty)]
        term, tf = np.concatenate(self.term or empty), np.concatenate(self.tf or empty)
        by_term = np.lexsort((place, term))
        terms, df = np.unique(term, return_counts=True)
        one = lambda x, kind, mask=None: pa.array([pa.array(x, kind, mask=mask)], pa.list_(kind))
        return pa.record_batch({
            "docs": pa.array([self.docs], pa.int64()), "words": pa.array([self.words], pa.int64()),
            "doc_id": one(ids[order], pa.int64(), no_ids[order]), "n": one(sizes[order], pa.int64()),
            "term": one(terms, pa.int32()), "df": one(df, pa.int32()),
            "place": one(place[by_term], pa.int32()), "tf": one(tf[by_term], pa.int32()),
        })


def index_blocks(docs: DataFrame, queries: Queries) -> DataFrame:
    """One row per block: its counts, its documents and the posting lists of the queries' terms."""
    shared = with_package(docs.sparkSession).sparkContext.broadcast(queries.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Gathered()
        for whole in batches:
            for batch in slices(whole, "text"):
                block.add(batch, shared.value)
                if block.full():
                    yield block.batch()
                    block = _Gathered()
        if block.words:
            yield block.batch()

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Corpus:
    """N, L, and the weight of each term of the queries (0 where no document has it)."""

    docs: int
    words: int
    weights: np.ndarray


def corpus_counts(index: DataFrame, terms: int) -> Corpus:
    docs, words = index.agg(F.sum("docs"), F.sum("words")).first()
    pairs = index.select(F.explode(F.arrays_zip("term", "df")).alias("e")).select("e.term", "e.df")
    found = pairs.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row per term of the queries at most
    weights = np.zeros(terms, np.int64)
    for term, df in zip(found.column("term").to_pylist(), found.column("df").to_pylist()):
        weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    return Corpus(docs or 0, words or 0, weights)


class Postings:
    """The posting lists of a block in one array, with a sparse table for each list. Interval ``a..b`` of positions lies in one list."""

    def __init__(self, doc_id: pa.Array, n: np.ndarray, term: np.ndarray, df: np.ndarray, place: np.ndarray,
                 tf: np.ndarray, corpus: Corpus):
        self.no_id = doc_id.is_null().to_numpy(zero_copy_only=False)
        self.id = doc_id.fill_null(0).to_numpy()
        self.size = len(n)
        long = 100 - 25 + (25 * n * corpus.docs) // max(corpus.words, 1)
        tf = tf.astype(np.int64)
        weight = np.repeat(corpus.weights[term], df)
        self.impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * long[place]))
        # A list's postings have keys from term * (documents + 1) on, so one search serves all lists.
        self.keys = np.repeat(term.astype(np.int64), df) * (self.size + 1) + place
        self.starts = np.zeros(len(corpus.weights), np.int64)
        self.ends = np.zeros(len(corpus.weights), np.int64)
        ends = np.cumsum(df)
        self.starts[term], self.ends[term] = ends - df, ends
        # Level l, position i: where the largest impact of positions i .. i + 2**l - 1 is, the first of equal ones.
        levels = [np.arange(len(self.keys), dtype=np.int32)]
        width = 1
        while 2 * width <= max(df, default=0):
            low = levels[-1]
            high = np.concatenate([low[width:], low[len(low) - width :]])
            levels.append(np.where(self.impact[high] > self.impact[low], high, low))
            width *= 2
        self.table = np.concatenate(levels)
        self.log = np.zeros(int(max(df, default=0)) + 1, np.int64)
        for level in range(1, len(levels)):
            self.log[1 << level :] = level

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The position of the largest impact in each interval a .. b - 1 (any where it is empty)."""
        level = self.log[np.maximum(b - a, 0)]
        base, last = level * len(self.keys), len(self.keys) - 1
        left = self.table[base + np.minimum(a, last)]
        right = self.table[base + np.clip(b - (1 << level), 0, last)]
        return np.where(self.impact[right] > self.impact[left], right, left)


class Best:
    """The ``k`` best documents of a query so far: higher scores first, then smaller ids, nulls last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.no_id = np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        ids, no_id = np.concatenate([self.id, ids]), np.concatenate([self.no_id, no_id])
        order = np.lexsort((ids, no_id, -score))[: self.k]
        self.score, self.id, self.no_id = score[order], ids[order], no_id[order]

    def may_enter(self, bound: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Which of the bounds, with the smallest id behind each, can still change the result."""
        if len(self.score) < self.k:
            return bound > 0
        worst = self.score[-1]
        earlier = (no_id < self.no_id[-1]) | ((no_id == self.no_id[-1]) & (ids < self.id[-1]))
        return (bound > worst) | ((bound == worst) & earlier)


def search_block(block: Postings, terms: np.ndarray, repeats: np.ndarray, best: Best) -> int:
    """Best-first search of one query in one block; returns the number of documents scored."""
    known = block.ends[terms] > block.starts[terms]
    terms, repeats = terms[known], repeats[known]
    if len(terms) == 0:
        return 0
    base = terms * (block.size + 1)

    def bounded(a, b, lo):
        at = block.largest(a, b)
        value = np.where(b > a, block.impact[at], 0) * repeats
        bound = value.sum(1)
        row = np.arange(len(a))
        top = value.argmax(1)
        split = block.keys[at[row, top]] - base[top]
        ok = best.may_enter(bound, block.id[lo], block.no_id[lo])
        return [x[ok] for x in (a, b, lo, bound, split)]

    scored = 0
    frontier = bounded(block.starts[terms][None, :], block.ends[terms][None, :], np.zeros(1, np.int64))
    while len(frontier[0]):
        a, b, lo, bound, split = frontier
        if len(a) > BATCH:
            order = np.lexsort((lo, -bound))
            now, later = order[:BATCH], order[BATCH:]
            later = [x[later] for x in frontier]
            a, b, lo, bound, split = (x[now] for x in frontier)
        else:
            later = None
        wanted = base + split[:, None]
        cut = np.searchsorted(block.keys, wanted)
        holds = (cut < b) & (block.keys[np.minimum(cut, len(block.keys) - 1)] == wanted)
        score = (np.where(holds, block.impact[np.minimum(cut, len(block.keys) - 1)], 0) * repeats).sum(1)
        scored += len(score)
        best.add(score[score > 0], block.id[split[score > 0]], block.no_id[split[score > 0]])
        a, b = np.concatenate([a, cut + holds]), np.concatenate([cut, b])
        # What lies behind the last document has no postings and goes with its bound of 0.
        lo = np.minimum(np.concatenate([lo, split + 1]), block.size - 1)
        frontier = bounded(a, b, lo)
        if later is not None:
            still = best.may_enter(later[3], block.id[later[2]], block.no_id[later[2]])
            frontier = [np.concatenate([x, y[still]]) for x, y in zip(frontier, later)]
    return scored


FOUND = "item long, doc_id long, score long"


def _search(index: DataFrame, queries: Queries, corpus: Corpus, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((queries, corpus))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = shared.value
        heaps = [Best(k) for _ in own.items]
        for batch in batches:
            for i in range(batch.num_rows):
                column = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                arrays = {c: column(c).to_numpy() for c in ("n", "term", "df", "place", "tf")}
                if len(arrays["place"]) == 0:
                    continue
                block = Postings(column("doc_id"), corpus=counts, **arrays)
                for terms, repeats, best in zip(own.terms, own.repeats, heaps):
                    search_block(block, terms, repeats, best)
        sizes = [len(h.score) for h in heaps]
        if sum(sizes):
            whole = lambda name: np.concatenate([getattr(h, name) for h in heaps])
            yield pa.record_batch({
                "item": pa.array(np.repeat(np.array(own.items, np.int64), sizes)),
                "doc_id": pa.array(whole("id"), mask=whole("no_id")),
                "score": pa.array(whole("score")),
            })

    return index.mapInArrow(run, FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, query_words: int = 200_000) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each of ``items`` (item_id, text): item_id, rank,
    doc_id, score."""
    stated = materialise(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    out = None
    for queries in query_blocks(stated, query_words):
        if not queries.items:
            continue
        index = materialise(index_blocks(docs, queries))
        found = _search(index, queries, corpus_counts(index, len(queries.hashes)), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(stated.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
