"""BPE encoding over a trie of distinct words, and decoding.

Byte-pair encoding has a state that needs no more than one token: the encoding of a prefix ends with a token
``t`` such that the encoding of what is before it ends with a token that ``t`` may follow. A token may follow
another if the merge rules, run over both together, give the two back; as rules join neighbours only, a sequence
whose neighbours all may follow each other is the encoding of its text, and there is just one. So a word's last
token follows from the last tokens of its prefixes.

The distinct words of a slice of documents are inserted into a trie. A depth-first walk gives every node the last
token of its prefix, from the last tokens of its ancestors: prefixes that words share are encoded once,
and a word's ids are read back from its end by the tokens' lengths. The last character of a word has symbols of its
own where the vocabulary marks word ends, so it is an edge of its own kind.

Each task works alone: no shuffle, nothing between tasks. Memory is bounded by the slice (2 MB of text, or the
longest text), by twice ``word_memory`` words whose ids are remembered over slices (some 250 bytes each), and by
``PAIRS`` remembered pairs.
Whole texts are encoded, cut before white space (which no token spans) into chunks where they are long.

Defined results: a null or empty text has no ids and decodes to an empty text. Repeated rows and null ids of
documents are carried. The content of an added token is its id, as in the library. Other columns are not read.
An empty table gives an empty one.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.llm.hashing import slices
from steadypace.llm.packing import PARTS, SIMPLE

NEVER = 1 << 60
SHORT = (2, 1)
PAIRS = 400_000
WORDS = 250_000
CHUNK = 1 << 20
DEEPEST = 200  # longer words are walked by themselves: a path needs no nodes
WORD_END = "\n"  # no symbol of a byte-level alphabet
WHITE = regex.compile(r"\s")
# The parts of a tokenizer file for which the short way of cutting texts holds.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _lengths(known: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """Lengths of the tokens with the same last three symbols, longest first, then those of shorter ones."""
    found: dict[str, set[int]] = {}
    for text in known:
        if len(text) > 2:
            found.setdefault(text[-3:], set()).add(len(text))
    return {tail: (*sorted(own, reverse=True), *SHORT) for tail, own in found.items()}


class Rules:
    """Vocabulary and merge rules of a tokenizer file, and which token may follow which."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
               if model.get(k)]
        if model["type"] != "BPE" or odd or whole.get("decoder"):
            raise ValueError(f"only plain BPE files without a decoder are handled: {odd or 'type or decoder'}")
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, token = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if token in self.made or max(self.made.get(a, -1), self.made.get(b, -1)) >= rank:
                raise ValueError(f"the rules give {left + right!r} twice, or before its parts")
            self.rank[a, b] = rank
            self.halves[token], self.made[token] = (a, b), rank
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.memory: dict[int, bool] = {}
        # A token that its own text does not encode to is in no encoding.
        sound: set[int] = set()
        for token in sorted(vocabulary.values(), key=lambda t: self.made.get(t, -1)):
            pair = self.halves.get(token)
            if pair is None or (pair[0] in sound and pair[1] in sound and self._stays(*pair, self.made[token])):
                sound.add(token)
        marked = {i for t, i in vocabulary.items() if t.endswith(end)} & sound
        names = {i: t for t, i in vocabulary.items()}
        bare = {t: names[t][: -len(end)] if end and t in marked else names[t] for t in sound}
        self.inner = {bare[t]: t for t in sound if not end or t not in marked}
        self.ends = {bare[t]: t for t in marked}
        self.size = {t: len(bare[t]) for t in sound}
        self.longest = max(self.size.values())
        self.inner_lengths, self.end_lengths = _lengths(self.inner), _lengths(self.ends)
        names |= {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one side of ``token`` while it is made, each with the rank at which it is
        merged into the next."""
        found = self.spines.get((token, side))
        if found is None:
            found, upto = [], NEVER
            while True:
                found.append((token, upto))
                if token not in self.halves:
                    break
                upto, token = self.made[token], self.halves[token][side]
            found.reverse()
            self.spines[found[-1][0], side] = found
        return found

    def _stays(self, first: int, second: int, until: int = NEVER) -> bool:
        """Whether no rule joins anything across the border of two tokens, before rank ``until``."""
        left, right = self._spine(first, 1), self._spine(second, 0)
        i = j = 0
        while True:
            (a, a_goes), (b, b_goes) = left[i], right[j]
            rank = self.rank.get((a, b), NEVER)
            # Of equal rules the leftmost place goes first: a's own merge, but the border before b's.
            if rank < min(a_goes, until) and rank <= b_goes:
                return False
            if a_goes == b_goes == NEVER:
                return True
            if a_goes <= b_goes:
                i += 1
            else:
                j += 1

    def may_follow(self, first: int, second: int) -> bool:
        key = first << 20 | second
        found = self.memory.get(key)
        if found is None:
            if len(self.memory) >= PAIRS:
                self.memory.clear()
            found = self.memory[key] = self._stays(first, second)
        return found

    def last_token(self, text: str, depth: int, last: list[int], known: dict[str, int],
                   lengths: dict[str, tuple[int, ...]]) -> int:
        """The last token of a prefix of ``depth`` symbols that ends with ``text``, from the last tokens of
        shorter ones."""
        memory, get = self.memory, known.get
        for size in lengths.get(text[-3:], SHORT):
            token = get(text[-size:])
            if token is None or size > depth:
                continue
            if size == depth:
                return token
            ok = memory.get(last[depth - size] << 20 | token)
            if ok or ok is None and self.may_follow(last[depth - size], token):
                return token
        raise ValueError(f"the vocabulary has no symbol for the end of {text!r}")

    def _read_back(self, depth: int, token: int, last: list[int]) -> list[int]:
        ids = [token]
        depth -= self.size[token]
        while depth:
            ids.append(last[depth])
            depth -= self.size[ids[-1]]
        ids.reverse()
        return ids

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (symbols of the byte-level alphabet)."""
        root: dict = {}
        found: dict[str, list[int]] = {}
        for word in words:
            if len(word) > DEEPEST:
                found[word] = self._alone(word)
                continue
            node = root
            for symbol in word[:-1]:
                below = node.get(symbol)
                if below is None:
                    below = node[symbol] = {}
                node = below
            node[WORD_END + word[-1]] = None
        last = [0] * (DEEPEST + 1)
        inner, ends, last_token = self.inner, self.ends, self.last_token
        inner_lengths, end_lengths = self.inner_lengths, self.end_lengths
        stack = [(root, "")]
        while stack:
            node, prefix = stack.pop()
            depth = len(prefix)
            if depth:
                last[depth] = last_token(prefix, depth, last, inner, inner_lengths)
            for symbol, below in node.items():
                if below is None:
                    word = prefix + symbol[1]
                    token = last_token(word, depth + 1, last, ends, end_lengths)
                    found[word] = self._read_back(depth + 1, token, last)
                else:
                    stack.append((below, prefix + symbol))
        return found

    def _alone(self, word: str) -> list[int]:
        last = [0] * len(word)
        for depth in range(1, len(word)):
            text = word[max(0, depth - self.longest) : depth]
            last[depth] = self.last_token(text, depth, last, self.inner, self.inner_lengths)
        tail = self.last_token(word[-self.longest :], len(word), last, self.ends, self.end_lengths)
        return self._read_back(len(word), tail, last)


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, cut before white space."""
    at = 0
    while len(text) - at > size:
        cut = WHITE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class TrieEncoder:
    """Ids of whole texts, slice by slice."""

    def __init__(self, path: str, word_memory: int = WORDS):
        from tokenizers import Tokenizer

        self.rules = Rules(path)
        self.word_memory = word_memory
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens with rules of their own are not handled")
        self.added = {t.content: i for i, t in added.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        whole = json.loads(self.library.to_str())
        steps = (whole["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.short_way = (
            [n["type"] for n in (whole["normalizer"] or {}).get("normalizers", [])] == NORMAL
            and steps[0].get("pattern") == {"Regex": SPLIT} and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        )
        # Bytes stand for themselves or, if not printable, for the characters from 256 on, in order.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        self.letters = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _spelled(self, part: str) -> str:
        return part if part.isascii() else "".join([self.letters[b] for b in part.encode()])

    def _parts(self, word: str) -> list[str]:
        if word.isascii() and word.isalpha():
            return [word]
        return [self._spelled(p) for p in PARTS.findall(word)]

    def _cut(self, text: str) -> Iterator[tuple[bool, list]]:
        """A text as (short way, folded words), or else symbols of parts and, as numbers, ids of added tokens."""
        for chunk in chunks(text):
            marks = list(self.marks.finditer(chunk))
            if self.short_way and not marks and SIMPLE.fullmatch(chunk):
                yield True, chunk.lower().split()
                continue
            items: list = []
            at = 0
            for mark in [*marks, None]:
                plain = chunk[at : mark.start() if mark else len(chunk)]
                if plain:
                    normal = self.library.normalizer.normalize_str(plain) if self.library.normalizer else plain
                    items += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
                if mark:
                    items.append(self.added[mark[0]])
                    at = mark.end()
            yield False, items

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [list(self._cut(text)) if text else [] for text in texts]
        seen, loose = set(), set()
        for pieces in cut:
            for short, items in pieces:
                if short:
                    seen.update(items)
                else:
                    loose.update(i for i in items if isinstance(i, str))
        # Two generations of words and parts, of which the older is dropped when the younger is full.
        if len(self.words) > self.word_memory:
            self.older, self.words = self.words, {}
            self.parts = {}
        memory, older = self.words, self.older
        new = {}
        for word in seen:
            if word not in memory:
                if word in older:
                    memory[word] = older[word]
                else:
                    new[word] = self._parts(word)
        coded = self.parts
        fresh = {p for own in new.values() for p in own if p not in coded}
        fresh.update(p for p in loose if p not in coded)
        # One buffer for all new ids, cut by their counts.
        collecting = gc.isenabled()
        gc.disable()  # a trie has no cycles, and the collector would walk its nodes again and again
        try:
            found = self.rules.encode(fresh)
        finally:
            if collecting:
                gc.enable()
        ends = np.cumsum([len(ids) for ids in found.values()]) * 4
        buffer = np.fromiter(chain.from_iterable(found.values()), "<i4").tobytes()
        at = 0
        for part, end in zip(found, ends.tolist()):
            coded[part] = buffer[at:end]
            at = end
        for word, own in new.items():
            memory[word] = coded[own[0]] if len(own) == 1 else b"".join([coded[p] for p in own])
        single = {i: np.array([i], "<i4").tobytes() for i in self.added.values()}
        out = []
        for pieces in cut:
            ids = []
            for short, items in pieces:
                if short:
                    ids.append(b"".join(map(memory.__getitem__, items)))
                else:
                    ids += [coded[i] if isinstance(i, str) else single[i] for i in items]
            out.append(b"".join(ids))
        return out


_ENCODERS: dict[tuple[str, int], TrieEncoder] = {}


def _encoder(path: str, word_memory: int) -> TrieEncoder:
    """One for each worker process, file and size of its memory."""
    if (path, word_memory) not in _ENCODERS:
        _ENCODERS[path, word_memory] = TrieEncoder(path, word_memory)
    return _ENCODERS[path, word_memory]


def _id_lists(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def _texts(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """Token names joined by one space, which is how a file without a decoder decodes."""
    ids = ids.fill_null([]) if ids.null_count else ids
    ends = ids.offsets.to_numpy()
    own = ids.values.slice(ends[0], ends[-1] - ends[0])
    lists = pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64) - ends[0]), names.take(own))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False, word_memory: int = WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int) and, if asked for, what the ids decode to as ``decoded``."""
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, word_memory)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = _id_lists(encoder.encode(batch.column("text").to_pylist()))
                columns = {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": ids}
                if decoded:
                    columns["decoded"] = _texts(ids, encoder.rules.names)
                yield pa.record_batch(columns)

    with_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _encoder(tokenizer_path, WORDS).rules.names
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()),
                                   "text": _texts(batch.column("ids"), names)})

    with_package(encoded.sparkSession)
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Number of ids, and checksums of the ids in decimal and of the decoded text."""
    coded = encode(docs, tokenizer_path, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
