from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from granary.llm import topk as K

VECTORS = "vec_id long, embedding array<float>"


def brute(rows, every=50, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(tuple(r) for r in K.search(spark.createDataFrame(rows, VECTORS).repartition(3), **options).collect())


def random_rows(n=300, dims=20, seed=0):
    rng = random.Random(seed)
    # eighths, so that floats and doubles agree and scores tie
    return [(i, [rng.randint(-8, 8) / 8 for _ in range(dims)]) for i in range(n)]


def test_matches_brute_force_with_ties(spark):
    rows = random_rows()
    assert got(spark, rows, every=7) == brute(rows, every=7)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    rows = random_rows(120)
    vectors = K.integers(spark.createDataFrame(rows, VECTORS).repartition(6))
    for pack, blocks, shards in ((4, 7, 1000), (3, 1000, 11), (5, 9, 13), (2048, 1 << 16, None)):
        monkeypatch.setattr(K, "PACK", pack)
        found = K.top_k(vectors, vectors.where("vec_id % 3 = 0"), 5, query_block=blocks, shard_rows=shards)
        assert sorted(tuple(r) for r in found.collect()) == brute(rows, every=3)


def test_nulls_ties_lengths_repeats_and_other_columns(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [9.0, 9.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [3.0]), (9, [0.0, -1.5, 4.0]), (50, [-0.001, 0.0])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], VECTORS + ", rank int, score string")
    assert sorted(tuple(r) for r in K.search(docs).collect()) == brute(rows)


def test_few_candidates_and_empty_tables(spark):
    assert got(spark, [(0, [1.0])]) == []
    assert got(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert got(spark, []) == []


def test_matches_the_sql(spark):
    rows = random_rows(200, 8, seed=4)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert got(spark, rows) == sorted(con.sql(K.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("scale", [1, 1 << 24])
@pytest.mark.parametrize("falling", [False, True])
def test_a_shard_reads_less_and_is_exact(scale, falling):
    rng = np.random.default_rng(1)
    rows = rng.integers(-20, 20, (500, 40)) * scale  # the larger sums don't fit a double
    if falling:
        rows = rows // (1 + np.arange(40)) ** 2
    shard = K.Shard((np.arange(at, at + 100), rows[at : at + 100]) for at in range(0, 500, 100))
    for q in range(0, 500, 25):
        ids, scores = shard.best(rows[q], q, 5)
        all_scores = (rows @ rows[q]).astype(np.int64)
        want = sorted((-s, i) for i, s in enumerate(all_scores) if i != q)[:5]
        assert [(-s, i) for s, i in zip(scores, ids)] == want
    assert shard.read < (0.5 if falling else 1) * 20 * rows.size


def test_the_border_follows_bounds_and_the_score_to_beat():
    left = np.array([10, 6, 3, 1, 0])  # what the terms from each place on can add
    assert [K.border(left, f) for f in (None, 11, 10, 7, 4, 2, 1, 0, -5)] == [4, 1, 1, 1, 2, 3, 4, 4, 4]


def test_a_score_to_beat_leaves_few_candidates(spark, monkeypatch):
    """Rows before the ranking, and copies of the vectors, counted."""
    monkeypatch.setattr(K, "PACK", 16)
    rows = random_rows(1600, 12, seed=7)
    vectors = K.integers(spark.createDataFrame(rows, VECTORS).repartition(8))
    queries = vectors.where("vec_id % 50 = 0")
    met, copies = K._met, []
    monkeypatch.setattr(K, "_met", lambda asked, packs, n_blocks, shards, k: copies.append((n_blocks, len(shards))) or met(asked, packs, n_blocks, shards, k))
    found = K.candidates(vectors, queries, 5, shard_rows=25)  # 64 shards, of which 4 go first
    assert copies == [(1, 4), (1, 60)]  # one block of queries: each vector is moved once
    n = found.groupBy("query_id").count().agg({"count": "avg"}).first()[0]
    assert n < 0.4 * 5 * 64  # without a score to beat five rows of nearly every shard
    assert sorted(tuple(r) for r in K._ranked(found, 5).select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)


def test_packs_take_the_fewest_bytes_and_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(K, "PACK_ENTRIES", 64)
    rows = [(0, [1.0] * 8), (1, [2.0] * 3), (2, [200.0]), (3, [1e9] * 200), (4, [1.0])]
    packs = K.packed(K.integers(spark.createDataFrame(rows, VECTORS).coalesce(1))).collect()
    assert len({r["width"] for r in packs}) > 1
    assert all(r["n"] * r["dims"] <= 64 or r["n"] == 1 for r in packs) and sum(r["n"] for r in packs) == 5
    back = {int(i): v for r in packs for i, v in zip(*K._unpacked(r.asDict()))}
    assert back[3].tolist() == [256 * 10**9] * 200 and back[1][:3].tolist() == [512] * 3 and not back[1][3:].any()
