"""Text operators against brute force on small hand-made tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from steadypace.llm import quality, toxicity
from steadypace.llm.decontaminate import contamination, drop_contaminated, report
from steadypace.llm.fingerprints import fingerprints
from steadypace.llm.labelled import held_out, training_rows
from steadypace.llm.licenses import known_licenses, scan_licenses, whole_texts
from steadypace.llm.near_dedup import keep_one, keep_one_row, near_duplicates
from steadypace.llm.packing import Encoder, pack, piece_digests
from steadypace.llm.sharding import kd_shards
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string"
SPACES = re.compile(rb"[^\x20\x09-\x0D]+")
TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abdeginorst"), rng.integers(2, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = [None, "", "  \n ", "one", "one two", "one two", "ONE\ttwo", "Ünïcode – “q” 日本", *base]
    for b in base[:4]:
        for i in range(8):
            words = b.split()
            words[int(rng.integers(60))] = f"x{i}"
            texts.append(" ".join(words))
    texts += [base[0]] * 5 + [base[5] + " " + base[6], " ".join(base) * 30]
    rows = [(i, t, "en" if i % 3 else None, "hot" if i % 2 else "s", len(t or ""), "a", "b")
            for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], (None, base[1], None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates_equal_brute_force(docs, empty):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = {}
    for r in rows:
        w = SPACES.findall(fold(r["text"]))
        sets[r["doc_id"]] = {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i:i + 3]) for i in range(len(w) - 2)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = near_duplicates(docs, 3, 85).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == find(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == find(r["doc_id"]))
    kept = keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *map(find, sets)}
    assert near_duplicates(empty, 3, 85).count() == 0


def test_near_copies_that_no_pivot_reaches(spark):
    """A chain: neighbours are similar, ends are not."""
    words = [f"w{i}" for i in range(100)]
    texts = []
    for step in range(12):
        texts.append((step * 7 % 12, " ".join([f"n{i}" for i in range(step * 6)] + words[step * 6:])))
    found = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 1, 85).collect()
    assert {r["component_id"] for r in found} == {0}


def jaccard_links(texts, words, percent):
    sets = []
    for text in texts:
        w = SPACES.findall(fold(text))
        sets.append({tuple(w)} if 0 < len(w) < words else {tuple(w[i:i + words]) for i in range(len(w) - words + 1)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("words, percent", [(1, 85), (3, 80)])
def test_short_texts_of_every_length(spark, words, percent):
    """Whole sets below and around the sketch's size, where few changes decide; partners may be cut."""
    rng = np.random.default_rng(words)
    texts = []
    for n in [*range(1, 30), 40, 52, 54, 55, 60, 62, 63, 64, 65, 70, 74, 75, 80]:
        base = [f"v{n}_{i}" for i in range(n)]
        for change in range(1 + n // 6):
            own = list(base)
            for i in rng.choice(n, change, replace=False):
                own[i] = f"c{change}_{i}"
            texts += [" ".join(own), " ".join(base + [f"e{i}" for i in range(change)])]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words, percent)
    expected = jaccard_links(texts, words, percent)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(expected))


def near_copies(n, seed=5):
    """Texts made from three bases by 0 to 15 edits, with edits that several share; two bases share a passage."""
    rng = np.random.default_rng(seed)
    bases = [[f"b{j}_{i}" for i in range(120)] for j in range(3)]
    bases[1][:60] = bases[0][:60]
    texts = []
    for _ in range(n):
        words = list(bases[int(rng.choice(3, p=[0.7, 0.2, 0.1]))])
        for _ in range(int(rng.integers(16))):
            at, new = int(rng.integers(len(words))), f"e{rng.integers(20)}"
            words[at:at + 1] = ([], [new], [words[at], new])[int(rng.integers(3))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("meet, pivots", [(2, 2), (4, 4), (32, 4)])
def test_long_lists_of_near_copies_are_cut_without_a_loss(spark, monkeypatch, meet, pivots):
    from steadypace.llm import near_dedup

    monkeypatch.setattr(near_dedup, "MEET", meet, raising=False)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    cuts, cut = [], near_dedup._differing_lists
    monkeypatch.setattr(near_dedup, "_differing_lists", lambda *a: cuts.append(1) or cut(*a))
    texts = near_copies(400, meet)
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)
    found = {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert found == dict(enumerate(jaccard_links(texts, 3, 85)))
    assert cuts or meet == 32


def test_a_group_of_near_copies_makes_no_square_of_pairs(spark, monkeypatch):
    """Near copies that are not similar to each other stand in the same lists: these lists are cut, so that the
    pairs a list compares stay a few for each entry."""
    from steadypace.llm import near_dedup

    seen, met = [], near_dedup._met

    def count(entries, *rest):
        lists = entries.groupBy("value").count().selectExpr("sum(count)", "sum(count * (count - 1) / 2)").first()
        seen.append(tuple(x or 0 for x in lists))
        return met(entries, *rest)

    monkeypatch.setattr(near_dedup, "_met", count)
    first, opened = [], near_dedup._open_lists

    def lists(*a):
        out = near_dedup.materialise(opened(*a))
        first.append(out.groupBy("value").count().selectExpr("sum(count)", "sum(count * (count - 1) / 2)").first())
        return out

    monkeypatch.setattr(near_dedup, "_open_lists", lists)
    texts = near_copies(2500)
    near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).count()
    entries, pairs = first[0]
    assert pairs > 100 * entries and len(seen) > 1
    assert sum(x[1] for x in seen) < 32 * entries


def test_two_texts_of_one_id_keep_their_own_links(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " y"), (4, text("c")),
            (7, text("d")), (7, text("e")), (5, text("e") + " z"), (None, text("a")), (6, None), (6, text("c") + " w")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85).collect()
    ids = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found)
    assert ids == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 1, (7, 7, True): 1,
                           (7, 5, False): 1, (5, 5, True): 1, (None, None, True): 1, (6, 6, True): 1, (6, 4, False): 1})


def test_templated_lines_do_not_meet_all_others(spark):
    """Lines of one template share most shingles with thousands, but are not similar: by the template's own words they
    would make n * (n - 1) / 2 pairs; only values of a field bring lines together."""
    from steadypace.llm import near_dedup

    counts = {}
    for n in (1000, 4000):
        lines = spark.range(n).selectExpr(
            "id AS doc_id",
            "concat_ws(' ', 'user', hash(id, 1) % 300, 'opened file', hash(id, 2) % 300, 'from host', hash(id, 3) % 300,"
            " 'with code', hash(id, 4) % 300, 'and went away') AS text")
        signed = near_dedup.signatures(lines, 3)
        nodes = near_dedup.materialise(signed.selectExpr("doc_id AS node", "n_shingles", "sketch"))
        lists = near_dedup._prefixes(nodes, 85, 64).where("tight")
        lists = near_dedup.materialise(near_dedup._can_meet(lists, 85))
        other = lists.selectExpr("value", "node AS other_node", "size AS other_size", "rest AS other_rest")
        met = lists.join(other, "value").where("node < other_node").where(near_dedup._order_fits(85))
        counts[n] = met.count()
        assert near_duplicates(lines, 3, 85).where("not kept").count() == 0
    assert counts[1000] <= 1000 and counts[4000] <= 2 * 4000


def test_values_shared_with_many_documents_once_list_no_node(spark):
    """Each text shares all its words, every one with another text: none has a partner, so none is in a list. Copies
    that share them with one text are."""
    from steadypace.llm import near_dedup

    texts = [" ".join(f"w{min(i, j)}_{max(i, j)}" for j in range(50) if i != j) for i in range(50)]
    texts += [texts[7] + " more", texts[30] + " other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_dedup.materialise(near_dedup.signatures(docs, 1).selectExpr("doc_id AS node", "n_shingles", "sketch"))
    listed = {r["node"] for r in near_dedup._prefixes(nodes, 85, 64).select("node").collect()}
    assert listed >= {7, 30, 50, 51} and len(listed) < 10
    found = near_duplicates(docs, 1, 85).where("not kept").collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(50, 7), (51, 30)}


def test_texts_are_not_shuffled_to_drop_rows(spark):
    rows = [(i, " ".join(f"a{i % 40}_{j}" for j in range(30))) for i in range(80)]
    kept = keep_one_row(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def test_a_clashing_column_is_kept(spark):
    schema = "doc_id long, text string, _row string, _ROW_ string, component_id long"
    rows = [(i, "one two three four five six", f"r{i}", f"s{i}", 9 - i) for i in range(3)]
    kept = keep_one_row(spark.createDataFrame(rows, schema), 3, 80)
    assert kept.columns == ["doc_id", "text", "_row", "_ROW_", "component_id"]
    assert [tuple(r) for r in kept.collect()] == [rows[0]]


def test_one_row_of_each_group_stays(spark, empty):
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, text("a"))] * 40 + [(None, text("b"))] * 30 + [(None, text("c")), (9, text("c")), (3, text("c"))]
    rows += [(7, text("d")), (7, text("e")), (6, text("d")), (8, None), (8, None), (None, ""), (2, text("f") + " z"),
             (2, text("f")), (1, text("g"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = [(5, text("a")), (None, text("b")), (3, text("c")), (6, text("d")), (7, text("e")), (8, None), (8, None),
            (None, ""), (2, text("f")), (1, text("g"))]
    assert Counter(map(tuple, keep_one_row(docs, 3, 80).collect())) == Counter(kept)
    assert keep_one_row(empty, 3, 80).count() == 0


def test_packing_covers_every_id_once(spark, docs, empty):
    import public_tokenizers

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = Encoder(path).tokenizer
    expected = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        expected[(r["doc_id"], ids)] += 1
    for capacity in (2048, 100):
        rows = pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path, capacity).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append(r)
            assert r["length"] * 4 == len(r["ids"]) > 0
        for doc, pieces in by_doc.items():
            pieces.sort(key=lambda r: r["start"])
            joined = b"".join(r["ids"] for r in pieces)
            assert (doc, joined) in expected
            assert pieces[0]["doc_tokens"] * 4 == len(joined)
        for pieces in by_sequence.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= capacity
    assert piece_digests(empty, path).count() == 0
    digests = piece_digests(docs, path).where("doc_id = 3").collect()
    ids = np.array([*plain.encode("one", add_special_tokens=False).ids, 1], "<u4").tobytes()
    lengths = [(r["start"], r["length"]) for r in digests]
    assert sum(n for _, n in lengths) * 4 == len(ids)
    assert {r["ids_crc32"] for r in digests} == {zlib.crc32(ids[4 * s:4 * (s + n)]) for s, n in lengths}


def test_packing_knows_the_tokens_of_the_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    texts = ["end here <|endoftext|> next", "<|startoftext|>a b<|endoftext|>", "x<|endoftext|>é 日 <|startoftext|>",
             "<|ENDOFTEXT|> <|endof text|>", "no marker", "<|endoftext|>"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for i, text in enumerate(texts):
        pieces = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist()
        assert ids == [*plain.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("bound", [500_000, 3])
def test_contamination_equals_brute_force(spark, docs, empty, bound):
    rows = docs.collect()
    long = rows[9]["text"].split()
    items = [("7", " ".join(long[5:30]).upper()), ("8", "one-two"), ("9", "  "), ("10", None), ("11", "absent"),
             (None, "one"), ("7", " ".join(long[5:30]).upper()), ("12", " ".join(long[40:52]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for item, text in items:
        w = TERMS.findall(fold(text))
        for i in range(max(1, len(w) - 9) if w and item else 0):
            windows[tuple(w[i:i + 10])].add(item)
    expected = []
    for r in rows:
        w = TERMS.findall(fold(r["text"]))
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i:i + n])]
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        expected.append((r["doc_id"], len(w), len(hit), len(named), digest, bool(hit)))
    found = contamination(docs, bench, block_windows=bound)
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, report(found).collect()), key=key) == sorted(expected, key=key)
    assert any(t[5] for t in expected)
    clean = drop_contaminated(docs, bench, block_windows=bound)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not t[5] for t in expected)
    assert report(contamination(empty, bench)).count() == 0
    assert drop_contaminated(docs, bench.where("false")).count() == docs.count()


def test_fingerprints_of_neighbours(spark, docs, empty):
    for ranges in (2, 7):
        rows = sorted(docs.collect(),
                      key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"] or ""))
        found = fingerprints(docs, 0.02, 0.9, ranges).collect()
        assert len(found) == len(rows)
        expected = Counter()
        for r, following in zip(rows, rows[1:] + rows[:1]):
            a, b = r["text"] or "", following["text"] or ""
            edited = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
            expected[(r["doc_id"], len(a), hashlib.sha256(edited.encode()).hexdigest())] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
        prints = defaultdict(set)
        texts = {r["doc_id"]: r["text"] or "" for r in rows}
        for r in found:
            prints[texts[r["doc_id"]]].add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert all(len(p) == 1 for p in prints.values())
    assert fingerprints(empty).count() == 0


def test_shards_are_even_whole_and_gapless(spark, docs, empty):
    dimensions = {"length": F.length("text"), "lang_key": F.crc32(F.col("lang").cast("binary"))}
    found = kd_shards(docs, dimensions, shards=5).collect()
    assert len(found) == docs.count()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
                    for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == texts
    slots, home = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        home[r["text_crc32"]].add(r["shard"])
    assert set(slots) <= set(range(5))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(id as string), 5)").alias("text"))
    sizes = [r[0] for r in kd_shards(even, {"n": F.length("text")}, shards=16).groupBy("shard").agg(
        F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)
    assert kd_shards(empty, dimensions, target_bytes=10).count() == 0


def test_licenses_of_lines_and_whole_texts(spark, empty):
    rows = [(1, "Text.\nReleased under the MIT  LICENCE\nmore"), (2, "(c) 2020 Me\nAll rights reserved"), (3, None),
            (4, ""), (5, "plain"), (None, "All rights reserved."),
            (6, "Released under the MIT License.\nAll rights reserved.")]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in found}
    assert got == {1: (None, "MIT"), 2: ("All-Rights-Reserved", "All-Rights-Reserved"), 3: (None, ""), 4: (None, ""),
                   5: (None, ""), None: ("All-Rights-Reserved", "All-Rights-Reserved"),
                   6: (None, "All-Rights-Reserved,MIT")}
    assert scan_licenses(empty, known_licenses(spark)).count() == 0


def test_licenses_of_rows_that_share_an_id(spark):
    rows = [(None, "a\nReleased under the MIT License."), (None, "plain"), (7, "Licensed under CC BY 4.0."), (7, "plain"),
            (7, "x\n\nReleased under the MIT License.\n\ny"), (None, None), (None, "Licensed under CC BY 4.0.\nz")]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), known_licenses(spark))
    assert Counter((r["doc_id"], r["license"], r["licenses"]) for r in found.collect()) == Counter([
        (None, None, "MIT"), (None, None, ""), (7, "CC-BY-4.0", "CC-BY-4.0"), (7, None, ""), (7, None, "MIT"),
        (None, None, ""), (None, None, "CC-BY-4.0")])


def test_the_first_word_leaves_nothing_out(spark, monkeypatch):
    """Forms whose first word only the canonical form gives, with and without the cheap test."""
    from steadypace.llm import licenses

    known = [("A", "Sublicensing is fine."), ("B", "Version 2 of this."), ("C", "Non-infringement of x"), ("D", "//x.org/y terms"),
             ("E", "License text here"), ("F", "Copyright owner says so"), ("G", "Plain first words"), ("H", "été libre"),
             ("I", "One block.\n\nCopyright 1999 Me\n\nTwo block.")]
    texts = ["sub-licensing is fine", "v2 of this", "V 2, of this", "version2 of this", "NonInfringement of X",
             "https://x.org/y terms", "http://x.org/y - terms", "LICENCE text here", "Copyright holders say so",
             "copyright holder says so", "** plain first words", "Été libre", "© 2020 Me", "(c) 2020 Me\nplain first words",
             "a\n\nOne block.\n\n(c) 2000 You\n\n© 2001 Her\n\ntwo block\n\nb", "a\n\n-\n© Me\nplain first words\n\nb"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, f"Before.\n{t}\nafter") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(known, "license string, text string")
    get = lambda: sorted(map(str, scan_licenses(docs, table).collect()))
    quick = get()
    monkeypatch.setattr(licenses, "FIRST_WORDS", 0)
    assert get() == quick
    found = {r["doc_id"]: r["licenses"] for r in scan_licenses(docs, table).collect()}
    assert [found[i] for i in range(16)] == ["A", "B", "B", "B", "C", "D", "D", "E", "", "F", "G", "H", "", "G", "I", "G"]
    assert [found[100 + i] for i in range(12)] == ["A", "B", "B", "B", "C", "D", "D", "E", "", "F", "G", "H"]


def test_licenses_in_full(spark):
    import textwrap

    texts = dict(reversed(whole_texts()))
    mit = [" ".join(p.split()) for p in texts["MIT"].split("\n\n")[-3:]]
    wrapped = "\n\n".join(textwrap.fill(p, 50) for p in mit)
    rows = [(1, "MIT License\r\n\r\nCopyright (c) 2031 Someone Else\r\n\r\n" + wrapped.replace("\n", "\r\n")),
            (2, "# About\n\nA tool.\n\n## Licence\n\nCopyright 2001 A\n" + wrapped + "\n\nThe end."),
            (3, "Before.\n\nReleased under the\nMIT License.\n\nAfter."),
            (4, wrapped[: wrapped.rindex("\n\n")] + "\n\nother words"), (5, texts["GPL-3.0"]), (6, "x\n\n" + texts["BSD-2-Clause"]),
            (7, "\n" * 9000 + "plain")]
    rows += [(100 + i, text) for i, text in enumerate(texts.values())]
    short = ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]
    for i, name in enumerate(short):
        for width in range(30, 90):
            folded = "\n\n".join(textwrap.fill(p, width) for p in texts[name].split("\n\n"))
            rows.append((1000 * (i + 1) + width, f"Copyright 1999 The Owners\n{folded}\n\nmore"))
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()
    got = {r["doc_id"]: (r["license"], r["licenses"]) for r in found}
    assert got[1] == ("MIT", "MIT") and got[2] == (None, "MIT") and got[3] == (None, "MIT") and got[4] == (None, "")
    assert got[5] == ("GPL-3.0", "GPL-3.0") and got[6] == (None, "BSD-2-Clause") and got[7] == (None, "")
    for i, name in enumerate(short):
        assert {got[1000 * (i + 1) + width][1] for width in range(30, 90)} == {name}
    assert len(texts) >= 15 and [got[100 + i][0] for i in range(len(texts))] == list(texts)


def test_classifiers_on_held_out_rows(spark, folder, docs, empty):
    folder = folder.replace("0.001", "0.01")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for module, label, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.9)):
        model = module.train(table, labels)
        scored = module.score(table, model).join(labels, "doc_id").where("held_out")
        assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least
        odd = module.score(docs, model).collect()
        assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
        assert module.score(empty, model).count() == 0
        assert module.keep(docs, model).columns == docs.columns
        blank = module.train(empty, labels.where("false"))
        assert module.keep(docs, blank).count() == docs.count()


def test_training_rows_vote_as_all_documents_do(spark, folder):
    """Every occurrence counts for a vote, also of words a text repeats."""
    from steadypace.llm.hashing import ALNUM, batch_words

    texts = ["idiot " * 3 + "word " * 900, "word " * 900 + "idiot", "alpha beta idiot", "", None, "Idiots! " + "x " * 50]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = np.sort(batch_words(toxicity.pa.array(["idiot", "word"]), ALNUM).hashes)
    fixed = np.sort(np.array([toxicity._hash(w) for w in toxicity.INSULTS], np.uint64))
    none = np.zeros(0, np.uint64)
    voters = toxicity.Voters(hashes[:1], np.zeros(1, np.int64), none, np.zeros(0, np.int64), fixed)
    found = {r["doc_id"]: np.frombuffer(r["votes"], np.int8).tolist() for r in toxicity._votes(table, voters).collect()}
    whole = voters.votes(batch_words(toxicity.pa.array([t or "" for t in texts]), ALNUM, prefix=toxicity.PREFIX))
    assert found == {i: row.tolist() for i, row in enumerate(whole)}


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark):
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y0"))
    docs = spark.range(2900, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    docs = docs.where("doc_id % 2 = 0 or doc_id % 10 = 1")
    rows = training_rows(docs, labels, "y0", 20).collect()
    there = docs.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id") % 2).count().collect()
    counts = {r[0]: r[1] for r in there}
    assert Counter(r["y"] for r in rows) == {y: min(20, n) for y, n in counts.items()}
    share = counts[1] / (counts[0] + counts[1])
    assert {(r["y"], round(r["weight"], 9)) for r in rows} == {(1, round(2 * share, 9)), (0, round(2 - 2 * share, 9))}
