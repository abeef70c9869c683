"""Hard negatives against brute force; products and heaps by themselves."""

import math

import numpy as np
import pytest

from steadypace.llm.hard_negatives import LOWEST, Heaps, Tile, hard_negatives, shifted_labels, strassen

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, score string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (17, 64, 33), (40, 33, 70), (0, 4, 3)])
def test_strassen_is_exact(shape):
    n, k, m = shape
    rng = np.random.default_rng(n + k)
    for size in (3, 1 << 26):
        a, b = rng.integers(-size, size, (n, k)), rng.integers(-size, size, (k, m))
        exact = a.astype(object) @ b.astype(object)
        for leaf in (1, 2, 16):
            assert (strassen(a, b, leaf) == exact).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    entries = [(int(s), int(i), r) for r, (s, i) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 50, 300)))]
    best = sorted(entries, key=lambda e: (-e[0], e[1] == 7, e[1], e[2]))[:5]
    for seed in range(3):
        heaps = Heaps(2, 5)
        order = np.random.default_rng(seed).permutation(300)
        for part in np.array_split(order, 9):
            own = sorted((entries[i] for i in part), key=lambda e: (e[1] == 7, e[1], e[2]))
            ids = np.array([e[1] for e in own])
            tile = Tile(ids, ids == 7, np.array([e[2] for e in own]), ids, ids)
            scores = np.full((2, len(own)), LOWEST)
            scores[1] = [e[0] for e in own]
            heaps.add(scores, tile)
        place, score, found, _, row = heaps.entries()
        assert set(place.tolist()) == {1}
        assert list(zip(score.tolist(), found.tolist(), row.tolist())) == best


def brute(rows):
    kept = []
    for n, r in enumerate(rows):
        i, v, label = r[:3]
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(abs(256 * float(np.float32(x))) >= math.isqrt((1 << 60) // 40) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, m, j, other == label)
                  for m, j, other, w in kept if m != n]
        scored.sort(key=lambda e: e[:4])
        for p in [e for e in scored if e[-1]][:5]:
            near = [e for e in scored if not e[-1] and 80 * -p[0] <= 100 * -e[0] <= 100 * -p[0]][:5]
            out += [(i, p[4], k, e[4], -p[0], -e[0]) for k, e in enumerate(near, 1)]
    return out


def key(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(420):
        # Few directions and small components: many equal scores; a third are copies of one vector.
        v = (rng.integers(-2, 3, 40) / 8).tolist() if i % 3 else [0.25] * 40
        rows.append((i, v, int(rng.integers(0, 4)), "x", "y", "z"))
    odd = [(500, None, 1), (600, [0.5, None] * 20, 1), (700, [float("nan")] + [0.5] * 39, 2),
           (800, [float("inf")] * 40, 2), (900, [0.5] * 40, None), (1000, [], 1), (1100, [0.5] * 7, 1),
           (None, [0.25] * 40, 1), (None, [0.25] * 40, 2), (1200, [1e30] * 40, 1), (1300, [-0.25] * 40, 3)]
    return rows + [(*r, None, None, None) for r in odd] + [rows[100], rows[100], rows[3]]


def test_equals_brute_force(spark, rows):
    expected = brute(rows)
    assert len(expected) > 50
    # One partition keeps the order of rows, by which repeated rows are told apart.
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert key(map(tuple, hard_negatives(shifted_labels(frame)).collect())) == key(expected)
    # Several passes over blocks of anchors, several tasks.
    distinct = [r for r in dict.fromkeys((i, None if v is None else tuple(v), *rest) for i, v, *rest in rows)
                if r[0] is not None]
    frame = spark.createDataFrame([(i, None if v is None else list(v), *rest) for i, v, *rest in distinct], SCHEMA)
    found = hard_negatives(shifted_labels(frame.repartition(7)), anchor_bytes=1000)
    assert key(map(tuple, found.collect())) == key(brute(distinct))


def test_tables_without_results(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives(shifted_labels(empty)).collect() == []
    no_anchor = spark.createDataFrame([r for r in rows if r[0] is None or r[0] % 100], SCHEMA)
    assert hard_negatives(no_anchor).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1, "", "", ""), (101, [0.5], 2, "", "", "")], SCHEMA)
    assert hard_negatives(alone).collect() == []
