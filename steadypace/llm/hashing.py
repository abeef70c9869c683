"""Words, shingles and character n-grams of whole Arrow batches as numpy arrays of 64-bit hashes.

A slice ``s..e`` of bytes hashes to ``sum(T[b_i] * P**(i - s))`` modulo 2**64. Prefix sums over a block
give the hash of every slice in it at once, so nothing loops over words in Python. Blocks are cut
between words, which bounds the memory beside the batch itself by the block size (or, where one word is
longer than a block, by that word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INVERSE = U(pow(int(_P), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))

_ASCII = np.arange(256)
UPPER = (_ASCII >= 65) & (_ASCII <= 90)
SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
ALNUM = ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_LOWER = np.where(UPPER, _ASCII + 32, _ASCII).astype(np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _P), np.full(n, _P_INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(places) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def blocks(inside: np.ndarray, breaks: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that no run of ``inside`` bytes straddles."""
    lo, n = 0, len(inside)
    while lo < n:
        hi = min(lo + size, n)
        while hi < n:
            seen = np.flatnonzero(~inside[hi : hi + 4096] | breaks[hi : hi + 4096])
            if len(seen):
                hi += int(seen[0])
                break
            hi = min(hi + 4096, n)
        # The cut byte is no word byte, or starts a document.
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


class Words:
    """Words of a batch: hash, byte range, and per document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, prefix: int = 0):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = word_bytes[data]
        breaks = np.zeros(n + 1, bool)
        breaks[offsets] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (breaks[:n] | ~before))
        self.ends = np.flatnonzero(inside & (breaks[1:] | ~after)) + 1
        self.hashes = np.empty(len(self.starts), U)
        # Hash of the first ``prefix`` bytes; 0 for words that are not longer.
        self.prefixes = np.zeros(len(self.starts) if prefix else 0, U)
        for lo, hi in blocks(inside, breaks[:n]):
            up, down = powers(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(_BYTES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            a, b = np.searchsorted(self.starts, (lo, hi))
            s, e = self.starts[a:b] - lo, self.ends[a:b] - lo
            self.hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            if prefix:
                long = np.flatnonzero(e - s > prefix)
                head = s[long]
                self.prefixes[a:b][long] = mix((sums[head + prefix] - sums[head]) * down[head])
        self.documents = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.documents)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def batch_words(column: pa.Array, word_bytes: np.ndarray, fold: bool = True, prefix: int = 0) -> Words:
    data, offsets = text_buffers(column)
    return Words(lower_ascii(data) if fold else data, offsets, word_bytes, prefix)


def slices(batch: pa.RecordBatch, column: str, size: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``size`` bytes of text each, one row at least."""
    _, offsets = text_buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    up, _ = powers(length + 1)
    total = hashes[:n].copy()
    for i in range(1, length):
        total += hashes[i : i + n] * up[i]
    return mix(total + U(length))


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """Distinct shingles of one document, sorted; with fewer words the whole sequence is one."""
    if len(hashes) == 0:
        return np.zeros(0, U)
    return np.unique(sequences(hashes, min(length, len(hashes))))


def ngrams(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...], size: int = BLOCK):
    """Hashes of character n-grams (any characters, inside one document), block by block: yields
    (document of each n-gram, hash). Blocks overlap by the longest n-gram, so none is lost."""
    n = len(data)
    head = (data & 0xC0) != 0x80
    lo = 0
    while lo < n:
        hi = min(lo + size, n)
        while hi < n and not head[hi]:
            hi += 1
        far = min(hi + 4 * max(lengths), n)
        up, down = powers(far - lo + 1)
        sums = np.zeros(far - lo + 1, U)
        np.cumsum(_BYTES[data[lo:far]] * up[: far - lo], out=sums[1:])
        heads = np.append(np.flatnonzero(head[lo:far]), far - lo)
        owner = np.searchsorted(offsets, heads[:-1] + lo, "right") - 1
        own = int(np.searchsorted(heads[:-1], hi - lo))
        for length in lengths:
            s, e = heads[: len(heads) - length], heads[length:]
            s, e = s[:own], e[:own]
            ok = e + lo <= offsets[owner[: len(s)] + 1]
            s, e = s[ok], e[ok]
            yield owner[: len(ok)][ok], mix((sums[e] - sums[s]) * down[s] + U(length))
        lo = hi
