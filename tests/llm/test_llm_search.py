"""Ranked search against brute force; sparse tables and the search of one block by themselves."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from steadypace.llm.ranked_search import Best, Corpus, Postings, parse_queries, ranked_search, search_block

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item long, score string, docs string, n long"


def terms_of(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(terms_of(t))) for i, t, *_ in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for (i, bag), n in zip(bags, sizes):
            m = 75 + 25 * n * n_docs // max(n_terms, 1)
            s = sum(weight[t] * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, e[3], -e[0]) for rank, e in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    zipf = 1 / np.arange(1, 120)
    zipf /= zipf.sum()
    word = [f"w{i}" if i % 5 else f"É{i}" for i in range(119)]
    texts = [" ".join(rng.choice(word, int(rng.integers(1, 60)), p=zipf)) for _ in range(500)]
    texts += [texts[7]] * 60 + ["W1, w1; W2.w3"] * 30 + [" ".join(texts[:40])]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " .,- "), (None, texts[7]), (None, "w1"), (3, texts[7]), (3, texts[7])]
    return [(i if i is None else int(i), t, 9, "s", "d", 0) for i, t in rows]


ITEMS = [("a", "w1 w2 W3 w1"), ("b", None), ("c", ""), ("d", "nowhere to be found"), (None, "w17 w21 É25"),
         ("a", "w44"), ("e", " ".join(f"w{i} w{i + 1}" for i in range(60)))]


def test_equals_brute_force(spark, docs):
    items = [*ITEMS, ("copy", docs[7][1]), ("copies", next(r[1] for r in docs if r[0] == 7))]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    asked = spark.createDataFrame(items, "item_id string, text string")
    expected = brute(docs, items)
    assert len(expected) == 20 * 6
    for options in ({}, {"query_words": 3}):
        found = ranked_search(frame, asked, **options)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(str, map(tuple, found.collect()))) == expected
    assert sorted(map(str, map(tuple, ranked_search(frame, asked, k=3).collect()))) == brute(docs, items, 3)


def test_tables_without_rows(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert ranked_search(empty, asked).collect() == []
    some = spark.createDataFrame(docs[:20], SCHEMA)
    assert ranked_search(some, asked.where("false")).collect() == []
    assert ranked_search(some, asked.where("item_id in ('b', 'c', 'd')")).collect() == []


def block_of(lists, size, weights):
    term = np.array([t for t, own in enumerate(lists) if own])
    df = np.array([len(own) for own in lists if own])
    place = np.array([p for own in lists for p, _ in own], np.int64)
    tf = np.array([f for own in lists for _, f in own], np.int64)
    ids = pa.array(np.arange(size) * 2)
    return Postings(ids, np.full(size, 10), term, df, place, tf, Corpus(size, 10 * size, np.array(weights)))


def test_range_maxima():
    rng = np.random.default_rng(4)
    lists = [[(int(p), int(rng.integers(1, 4))) for p in np.flatnonzero(rng.random(200) < share)]
             for share in (0.9, 0.3, 0, 0.02, 1)]
    block = block_of(lists, 200, [5, 40, 1, 300, 7])
    for t, own in enumerate(lists):
        start, end = int(block.starts[t]), int(block.ends[t])
        assert end - start == len(own)
        for a in range(start, end, 7):
            for b in range(a + 1, end + 1, 3):
                at = int(block.largest(np.array([a]), np.array([b]))[0])
                assert a <= at < b and at == a + int(np.argmax(block.impact[a:b]))


def test_bounds_leave_documents_out_and_ties_cost_no_more_than_k():
    lists = [[(p, 1 + (p == 500)) for p in range(4000)], [(p, 1) for p in range(0, 4000, 2)], [(77, 3), (500, 1)]]
    block = block_of(lists, 4000, [3, 10, 800])
    best = Best(20)
    scored = search_block(block, np.array([0, 1, 2]), np.array([1, 2, 1]), best)
    # The two documents of the rare term, then the first of the many equal ones.
    assert best.id.tolist() == [154, 1000, *[4 * i for i in range(18)]] or best.id.tolist()[:2] == [1000, 154]
    assert best.id.tolist()[2:] == [4 * i for i in range(18)]
    assert scored < 400


def test_queries_keep_repeats():
    own = parse_queries([(4, "b a B"), (5, "..."), (9, "c")])
    assert own.items == [4, 9] and [r.tolist() for r in own.repeats][1] == [1]
    assert sorted(own.repeats[0].tolist()) == [1, 2] and len(own.hashes) == 3
