"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the words of a text, so a pattern is a window of consecutive words of a benchmark item
and an occurrence always starts and ends at word borders. For patterns of one length ``m``:

* the shift table gives, for the hash of a block of ``b`` words, how far the search may move on: the
  distance of the block's last occurrence in any pattern from the pattern's end, or ``m - b + 1`` where
  no pattern has it. A position with a positive shift cannot end an occurrence and is skipped past;
* where the shift is zero, the bucket of the block (the suffix hash) holds the patterns that end so;
* each of them is compared with the text directly, first by word hashes and then by the words.

All cursors of a batch move in step: a batch is cut into stretches with one cursor each. An item of fewer
words than the window is one pattern of its own length; each length has its own tables. Benchmarks are
searched in blocks of at most ``block_windows`` patterns (the bound on what a worker holds and on what the
driver collects at a time), one pass over the documents for each.

Nulls: a null text has no words and no hits; items with a null id or text, or without words, are left
out. Repeated items are named once. Repeated document rows are each answered. Columns other than the id
and the text are not read by ``contamination``; ``drop_contaminated`` returns the columns it gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.llm.hashing import ALNUM, U, Words, batch_words, sequences, slices
from steadypace.session import materialise

WINDOW = 10
STRETCH = 256


def _words(text: str) -> Words:
    return batch_words(pa.array([text], pa.string()), ALNUM)


class Tables:
    """Shift table and buckets of all patterns of one length."""

    def __init__(self, patterns: dict[bytes, tuple[np.ndarray, set[str]]], length: int):
        self.length = length
        self.block = min(3, length)
        self.texts = list(patterns)
        self.items = [sorted(patterns[t][1]) for t in self.texts]
        self.words = np.array([patterns[t][0] for t in self.texts], U).reshape(len(self.texts), length)
        self.bits = max(10, int(len(self.texts) * length * 8).bit_length())
        most = length - self.block + 1
        self.shifts = np.full(1 << self.bits, most, np.int16)
        for end in range(self.block, length + 1):
            blocks = np.concatenate(
                [sequences(w[end - self.block : end], self.block) for w in self.words]
            ) if len(self.words) else np.zeros(0, U)
            np.minimum.at(self.shifts, self._slot(blocks), length - end)
        suffix = self._slot(np.array(
            [sequences(w[length - self.block :], self.block)[0] for w in self.words], U))
        self.order = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.order]

    def _slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> U(64 - self.bits)).astype(np.int64)

    def search(self, found: Words) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence, wherever it lies in the batch; occurrences that
        straddle documents are left out."""
        n, b = len(found.hashes), self.block
        if n < self.length:
            return []
        slots = self._slot(sequences(found.hashes, b))  # of the block that starts at a word
        at = np.arange(self.length - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        ends = []
        while len(at):
            shift = self.shifts[slots[at - b + 1]]
            ends.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate(ends)
        firsts = ends - self.length + 1
        owner = np.searchsorted(found.documents, ends, "right")
        inside = np.searchsorted(found.documents, firsts, "right") == owner
        firsts, ends = firsts[inside], ends[inside]
        low = np.searchsorted(self.suffixes, slots[ends - b + 1], "left")
        high = np.searchsorted(self.suffixes, slots[ends - b + 1], "right")
        out = []
        for first, lo, hi in zip(firsts, low, high):
            window = found.hashes[first : first + self.length]
            for pattern in self.order[lo:hi]:
                if (self.words[pattern] == window).all() and self._same(found, first, pattern):
                    out.append((int(first), int(pattern)))
        return out

    def _same(self, found: Words, first: int, pattern: int) -> bool:
        lo, hi = found.starts[first], found.ends[first + self.length - 1]
        return normal(found.data[lo:hi].tobytes()) == self.texts[pattern]


_GAPS = bytes(b if ALNUM[b] else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """Words of lower-cased text with one space between them."""
    return b" ".join(text.translate(_GAPS).split())


def build_tables(items: list[tuple[str, str]], window: int) -> list[Tables]:
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for item, text in items:
        found = _words(text)
        n = len(found.hashes)
        if n == 0:
            continue
        length = min(window, n)
        for first in range(n - length + 1):
            part = found.data[found.starts[first] : found.ends[first + length - 1]].tobytes()
            held = by_length.setdefault(length, {})
            held.setdefault(normal(part), (found.hashes[first : first + length], set()))[1].add(item)
    return [Tables(patterns, length) for length, patterns in sorted(by_length.items())]


def _hits(batch: pa.RecordBatch, tables: list[Tables]):
    """Words of the batch, which of them are hit, and the items of each document."""
    found = batch_words(batch.column("text"), ALNUM)
    # Marks a start with +1 and the word after an end with -1; the running sum covers.
    marks = np.zeros(len(found.hashes) + 1, np.int32)
    items: list[set[str]] = [set() for _ in range(batch.num_rows)]
    for table in tables:
        for first, pattern in table.search(found):
            marks[first] += 1
            marks[first + table.length] -= 1
            items[int(np.searchsorted(found.documents, first, "right")) - 1].update(table.items[pattern])
    return found, np.cumsum(marks[:-1]) > 0, items


def item_blocks(benchmark: DataFrame, block_windows: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``block_windows`` windows, one block at a time on the driver; a single
    longer item is a block by itself. At most one block and one item are held."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna().distinct()
    for row in rows.toLocalIterator():
        words = len(_words(row["text"]).hashes)
        if block and size + words > block_windows:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += words
    yield block


SPANS = "spans array<struct<first: int, last: int>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_windows: int = 500_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (word positions of hit stretches, from 0, last one
    included) and items (ids of the items with an occurring window, sorted)."""
    with_package(docs.sparkSession)
    schema = f"doc_id long, text string, n_words long, {SPANS}"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    frame = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    blocks = item_blocks(benchmark, block_windows)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        tables = build_tables(block, window)
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=following is None):
            for whole in batches:
                for batch in slices(whole, "text"):
                    found, hit, items = _hits(batch, shared.value)
                    spans, named = [], []
                    for i, (lo, hi) in enumerate(zip(found.documents[:-1], found.documents[1:])):
                        own = hit[lo:hi]
                        for old in batch.column("spans")[i].as_py():
                            own[old["first"] : old["last"] + 1] = True
                        edges = np.diff(np.concatenate([[0], own.view(np.int8), [0]]))
                        spans.append([{"first": a, "last": b} for a, b in zip(
                            np.flatnonzero(edges == 1).tolist(),
                            (np.flatnonzero(edges == -1) - 1).tolist())])
                        named.append(sorted(items[i].union(batch.column("items")[i].as_py())))
                    text = batch.column("text")
                    yield pa.record_batch({
                        "doc_id": batch.column("doc_id").cast(pa.int64()),
                        # The text goes on only where another block of items follows.
                        "text": pa.nulls(len(text), pa.string()) if last else text,
                        "n_words": pa.array(found.counts(), pa.int64()),
                        "spans": pa.array(spans, kind),
                        "items": pa.array(named, pa.list_(pa.string())),
                    })

        frame = frame.mapInArrow(run, schema)
        if following is not None:
            frame = materialise(frame)
        block = following
    return frame.drop("text")


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``."""
    hits = F.aggregate("spans", F.lit(0).cast("long"),
                       lambda n, s: n + (s["last"] - s["first"] + 1).cast("long"))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      block_windows: int = 500_000) -> DataFrame:
    """``docs`` with its columns, without the rows that hold a window; one pass for each block."""
    with_package(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark, block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(build_tables(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    found, hit, _ = _hits(batch, shared.value)
                    sums = np.concatenate([[0], np.cumsum(hit)])
                    clean = sums[found.documents[1:]] == sums[found.documents[:-1]]
                    yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
