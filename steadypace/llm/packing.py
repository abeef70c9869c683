"""Harmonic packing of token sequences, one worker at a time.

Lengths fall into classes by how often they fit a sequence: class ``j`` holds lengths in
(capacity / (j + 1), capacity / j], and each of its bins takes exactly ``j`` pieces. A class with length
capacity / j wastes nothing, so documents are first cut into whole sequences and pieces of capacity / 2,
/ 4, ... / ``finest``; the rest, shorter than capacity / ``finest``, goes to its class uncut, where a bin
wastes less than one rest.

A worker fills its bins while it reads its partition and shares nothing with others, so there is no
shuffle and a lost task is simply run again. What is left in unfilled bins at the end of a partition is
cut on by halves down to single tokens; the leftovers of a class of capacity / 2**i then go to bins of
2**n pieces, whose totals are powers of two if the capacity is one. Such sequences need no padding.
At most log2(capacity) + 1 short sequences end each partition.

A null or empty text is the end id alone. Nulls in ``doc_id`` are carried; repeated rows are packed each;
columns other than ``doc_id`` and ``text`` are not read. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm.common import with_package

PIECE = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
         "offset long")
# The pre-tokenisation pattern of the tokenizer file, for texts of simple letters.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Letters that lower-casing and normalisation treat alike everywhere, and common punctuation.
SIMPLE = regex.compile(r"[\x09-\x0d\x20-\x7e¡-įĲ-ňŊ-ž‐-‧€]*")
GENERATION = 400_000


class WordIds(dict):
    """Ids of a word as little-endian bytes; a bounded memory of two generations, of which the older
    is dropped when the younger is full."""

    def __init__(self, encode: Callable[[str], bytes], limit: int = GENERATION):
        super().__init__()
        self.encode, self.limit, self.older = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.encode(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """Ids of whole texts, as the tokenizer file gives them without its special tokens around. Texts of
    simple characters are split at white space and each word is encoded once; every other text, and one
    that holds the content of an added token, goes through the tokenizer as a whole."""

    def __init__(self, path: str, word_memory: int = GENERATION):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.lower() for token in added]
        self.parts = WordIds(self._part, word_memory // 4)
        self.words = WordIds(self._word, word_memory)
        # Bytes stand for themselves or, if not printable, for the characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, PARTS.findall(word)))

    def __call__(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text):
            folded = text.lower()
            if not any(token in folded for token in self.added):
                return b"".join(map(self.words.__getitem__, folded.split()))
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(encoded.ids, "<u4").tobytes()


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, word_memory: int = GENERATION) -> Encoder:
    """One encoder for each worker process, file and size of its memory."""
    if (path, word_memory) not in _ENCODERS:
        _ENCODERS[path, word_memory] = Encoder(path, word_memory)
    return _ENCODERS[path, word_memory]


class Packer:
    """Cuts documents and fills bins; ``take`` gets full bins as soon as they are full."""

    def __init__(self, capacity: int, finest: int, first_sequence: int):
        self.capacity, self.next_sequence = capacity, first_sequence
        self.sizes = [capacity]
        while len(self.sizes) <= np.log2(finest) and self.sizes[-1] > 1:
            self.sizes.append(capacity // 2 ** len(self.sizes))
        self.bins: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        for size in self.sizes:
            while total - at >= size:
                self._place(doc, at, ids[4 * at : 4 * (at + size)], total)
                at += size
        if at < total:
            self._place(doc, at, ids[4 * at :], total)

    def _place(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        fits = self.capacity // (len(ids) // 4)
        held = self.bins.setdefault(fits, [])
        held.append((doc, start, ids, total))
        if len(held) == fits:
            self._close(held)
            del self.bins[fits]

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.out.append((doc, start, length, ids, total, self.next_sequence, offset))
            offset += length
        self.next_sequence += 1

    def finish(self) -> None:
        """Cut what unfilled bins hold by halves and fill bins with as many as there are."""
        left = [piece for _, held in sorted(self.bins.items()) for piece in held]
        self.bins = {}
        halves = [self.capacity >> i for i in range(self.capacity.bit_length())]
        for doc, start, ids, total in left:
            at, length = 0, len(ids) // 4
            for size in halves:
                while length - at >= size > 0:
                    self._place(doc, start + at, ids[4 * at : 4 * (at + size)], total)
                    at += size
        for _, held in sorted(self.bins.items()):
            lo = 0
            while lo < len(held):
                take = 1 << ((len(held) - lo).bit_length() - 1)
                self._close(held[lo : lo + take])
                lo += take
        self.bins = {}

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in PIECE.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*self.out), kinds)]
            self.out = []
            yield pa.record_batch(dict(zip(names, columns)))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1,
         finest: int = 16, word_memory: int = GENERATION) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens (with
    the end id), sequence_id, offset. Every id of a document lies in exactly one piece; a sequence
    holds at most ``capacity`` ids, gapless from offset 0. ``word_memory`` bounds the words whose ids a
    worker remembers (twice that, some 200 bytes each); it changes speed, not results."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path, word_memory)
        # Sequences are numbered apart in each partition: up to 2**33 in each of 2**30.
        packer = Packer(capacity, finest, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc, encode(text.as_py() or "") + end)
                if len(packer.out) >= 2000:
                    yield from packer.drain()
        packer.finish()
        yield from packer.drain()

    with_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def piece_digests(docs: DataFrame, tokenizer_path: str, **options: int) -> DataFrame:
    """``pack`` with the checksum of each piece's ids in their place; ids stay inside the worker."""
    return pack(docs, tokenizer_path, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
        "offset",
    )
