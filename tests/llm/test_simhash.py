from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from granary.llm import shingle_sets, simhash
from granary.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_whole_table_matches_brute_force(spark, sample):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in sample], "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in sample}
    roots = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {i: (signed(fps[i]), roots[i]) for i in fps}


def brute_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_copies(texts):
    """Components by two bits of the fingerprint or a similarity of 0.8 of the sets."""
    fps, sets = {i: brute_fingerprint(t) for i, t in texts.items()}, {i: brute_set(t) for i, t in texts.items()}
    return brute_components(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0))


def test_near_copies_match_brute_force(spark, sample):
    texts = {i: t for i, t, *_ in sample}
    rng = random.Random(8)
    for i, t in [(i, t) for i, t in texts.items() if len(t.split()) > 60][:40]:
        for j, every in enumerate((300, 150, 90, 40, 12)):  # similarities from about 0.97 down to 0.4
            words = t.split()
            for k in range(rng.randrange(every), len(words), every):
                words[k] = f"w{rng.randrange(10**6)}"
            texts[100_000 + 10 * i + j] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_copies(texts)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()} == want
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs, similarity=0.8).collect()) == sorted(set(want.values()))
    plain = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert len(set(want.values())) < plain < len(texts)


def test_copies_that_meet_only_through_a_text_with_a_middle_id(spark):
    rng = random.Random(21)
    base = [f"b{k}" for k in range(300)]
    texts = {500: " ".join(base)}
    for i in (i for i in range(1001) if i != 500):
        words = list(base)
        for k in rng.sample(range(2, 298, 5), 6):  # six words five apart or more: a similarity of 0.816 to the base, less to each other
            words[k] = f"e{i}x{k}"
        texts[i] = " ".join(words)
    sets = {i: brute_set(t) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(500, i) for i in texts) and not any(alike(i, j) for i in (0, 1000) for j in range(1, 1000) if j != 500)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    edges = shingle_sets.alike(docs, shingle_sets.sketches(docs))
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    # a pair shares a band with a chance of 0.9992, so nearly every copy is linked
    assert sum(roots.get(i) == roots[500] for i in texts) >= 995


def test_sets_of_short_and_empty_texts(spark):
    rows = [(1, "a b"), (2, "A  b\n"), (3, "b a"), (4, ""), (5, None), (6, " \t"), (7, "a b c d e"), (8, "a b c d e"), (None, "a b"), (7, "a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edges = shingle_sets.alike(docs, shingle_sets.sketches(docs)).collect()
    assert sorted(tuple(r) for r in edges) == [(2, 1), (8, 7)]
    assert shingle_sets.alike(docs.limit(0), shingle_sets.sketches(docs.limit(0))).count() == 0


def test_pairs_within_two_bits_meet_in_sparse_and_dense_cells(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres)
    for c in centres:
        for _ in range(12):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    want = brute_components(list(range(len(fps))), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for dense in (1, 64):
        roots = {r["node"]: r["root"] for r in connected_components(simhash.linked(table, dense=dense)).collect()}
        assert {n: roots.get(n, n) for n in want} == want


def test_nulls_empties_ties_and_repeats(spark):
    rows = [(5, None, 1), (3, "", 2), (9, " \t ", 3), (2, "one", 4), (2, "one", 4), (None, "one", 5), (None, "lone words here now", 6), (7, "a b c " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("component_id", F.lit("x"))
    for find in (simhash.near_duplicates, simhash.near_copies):
        got = sorted(((r["doc_id"], r["component_id"]) for r in find(docs).collect()), key=str)
        assert got == sorted([(5, 3), (3, 3), (9, 3), (2, 2), (2, 2), (None, 2), (None, None), (7, 7)], key=str)


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "fp", "component_id"] and out.count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (4, 4)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
