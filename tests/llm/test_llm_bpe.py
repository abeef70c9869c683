"""Trie encoding against the tokenizers library and against plain merging."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from steadypace.llm.bpe_trie import Rules, TrieEncoder, _id_lists, _texts, chunks, decode, digests, encode

SCHEMA = "doc_id long, text string, ids string, decoded string, n_chars long"
ODD = [None, "", " \n\t ", "<|endoftext|>", "a <|startoftext|>b<|endoftext|> c", " <|ENDOFTEXT|> x", "<|endoftext",
       "İstanbul ΣΑΣ ﬁ é é ٣ 12 don't I'LL we're 日本語 😀👍🏽 \x00\x01\x85 x", "́ a ́", "x​qq﻿",
       "A'S''s!?'t", "   x y", "Straße º ª ŉ ĳ", "'", "a" * 3000, "thein" * 90 + " the", "\x1c\x1d a\x1eb"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_words_and_odd_texts(path, library):
    rng = random.Random(3)
    letters = ["ab", "aehilnorst", "éüß", "0a.'"]
    texts = ["".join(rng.choice(letters[k % 4]) for _ in range(rng.randint(1, 15))) for k in range(4000)]
    texts += [t for t in ODD if t] + ["\n".join(texts[:50])]
    encoder = TrieEncoder(path, word_memory=500)  # small, so that generations are dropped
    assert encoder.short_way
    found = []
    for lo in range(0, len(texts), 300):
        found += encoder.encode(texts[lo:lo + 300])
    for text, ids in zip(texts, found):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == expected, text
    decoded = _texts(_id_lists(found), encoder.rules.names).to_pylist()
    assert decoded == [library.decode(np.frombuffer(i, "<i4").tolist(), skip_special_tokens=False) for i in found]


def test_long_texts_are_cut_before_white_space(path, library):
    text = "word " * 30 + "́x " + "long" * 20 + " <|endoftext|> é́ ." * 9
    for size in (1, 7, 50, 1000):
        assert "".join(chunks(text, size)) == text
        ids = [i for c in chunks(text, size) for i in library.encode(c, add_special_tokens=False).ids]
        assert ids == library.encode(text, add_special_tokens=False).ids


def plain(rules, symbols):
    """Merge the pair of the lowest rank, the leftmost of equal ones, until none is left."""
    ids = list(symbols)
    while len(ids) > 1:
        rank, at = min((rules.rank.get(pair, 1 << 61), i) for i, pair in enumerate(zip(ids, ids[1:])))
        if rank == 1 << 61:
            break
        ids[at:at + 2] = [next(t for t, h in rules.halves.items() if h == (ids[at], ids[at + 1]))]
    return ids


@pytest.mark.parametrize("end", ["", "</w>"])
def test_random_rules(tmp_path, end):
    """Small alphabets with random rules, where ties, runs of one letter and unreachable tokens abound."""
    for seed in range(12):
        rng = random.Random(seed)
        vocabulary = {c: i for i, c in enumerate(["a", "b", "c", *([x + end for x in "abc"] if end else [])])}
        merges, inner, ending = [], ["a", "b", "c"], [x + end for x in "abc"]
        while len(merges) < 25:
            left = rng.choice(inner)
            right = rng.choice([*inner, *(ending if end else [])])
            if left + right in vocabulary or len(left + right) > 9:
                continue
            vocabulary[left + right] = len(vocabulary)
            merges.append([left, right])
            (ending if end and right in ending else inner).append(left + right)
        model = {"type": "BPE", "vocab": vocabulary, "merges": merges, "end_of_word_suffix": end or None}
        file = tmp_path / f"{seed}{bool(end)}.json"
        file.write_text(json.dumps({"model": model, "added_tokens": [], "decoder": None}))
        rules = Rules(str(file))
        words = {"".join(rng.choice("aab" if k % 2 else "abc") for _ in range(rng.randint(1, 12))) for k in range(300)}
        words |= {"a" * n for n in range(1, 40)} | {"ab" * 150}
        for word, ids in rules.encode(words).items():
            symbols = [vocabulary[c] for c in word[:-1]] + [vocabulary[word[-1] + end]]
            assert ids == plain(rules, symbols), (seed, word)


def test_files_that_are_not_handled(tmp_path):
    twice = {"type": "BPE", "vocab": {c: i for i, c in enumerate(["a", "b", "ab", "abb", "bb"])},
             "merges": [["a", "b"], ["ab", "b"], ["b", "b"], ["a", "bb"]]}
    for model in (twice, {**twice, "merges": twice["merges"][:1], "byte_fallback": True}):
        file = tmp_path / "odd.json"
        file.write_text(json.dumps({"model": model, "added_tokens": []}))
        with pytest.raises(ValueError):
            Rules(str(file))


def test_frames(spark, path, library):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "The same text.", "", "", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i, len(ids), sha(" ".join(map(str, ids))),
                         sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, digests(docs, path).collect()))) == sorted(map(str, expected))
    coded = encode(docs, path)
    assert coded.columns == ["doc_id", "ids"]
    texts = {r["doc_id"]: r["text"] for r in decode(coded, path).collect()}
    assert texts[4] == library.decode(library.encode(ODD[4], add_special_tokens=False).ids, skip_special_tokens=False)
    assert texts[0] == texts[1] == ""
    assert digests(spark.createDataFrame([], SCHEMA), path).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in decode(nothing, path).collect()] == ["", ""]


def test_lists_of_ids_in_slices(path):
    names = Rules(path).names
    lists = pa.array([[320], None, [], [343, 49407]], pa.list_(pa.int32()))
    assert _texts(lists, names).to_pylist() == ["a</w>", "", "", "x</w> <|endoftext|>"]
    assert _texts(lists.slice(3), names).to_pylist() == ["x</w> <|endoftext|>"]
