from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing as M

DOCUMENTS = "doc_id long, text string, source string"


def brute_targets(sizes, weights=M.WEIGHTS, most=M.MOST_REPEATS):
    """Give by weight, stop at the caps, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def random_rows(seed, n=400, sources=("b", "a", None, "é", "Z", "tiny", "hot")):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 40, 700]))), "hot" if rng.random() < 0.4 else rng.choice(sources)) for i in range(n)]
    return [*rows, (n, "a b", "tiny two"), (n + 1, None, "none at all"), (n + 2, "", "none at all")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, monkeypatch, seed):
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    rows = random_rows(seed)
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    turns, taken = M.mixed(docs)
    got = taken.join(docs.select("doc_id", "source"), "doc_id").collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = defaultdict(int)
    for i, _, s in rows:
        sizes[s] += size[i]
    target = brute_targets(sizes)
    given = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        given[r["source"]] += r["taken"]
    assert len(got) == len(rows)
    assert all(abs(given[s] - target[s]) <= 0.5 for s in sizes)
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, M.mixed(docs.repartition(7))[1].collect()))
    # The schedule: turns hold a block each, and any stretch of it is close to the shares.
    by_turn = defaultdict(Counter)
    for r in turns.collect():
        by_turn[r["turn"]][r["sid"]] += r["words"]
    assert all(len(c) == 1 and sum(c.values()) <= M.BLOCK_WORDS for c in by_turn.values())
    order = [next(iter(by_turn[t])) for t in sorted(by_turn)]
    share = {k: v / len(order) for k, v in Counter(order).items()}
    for n in range(1, len(order)):
        seen = Counter(order[:n])
        assert all(abs(seen[k] - n * share[k]) <= 3 + n**0.5 / 2 for k in share)


def test_matches_the_sql(spark):
    rows = random_rows(5) + [(7, "same id again", "a"), (7, "same id again", "a")]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    con = duckdb.connect()
    frame = docs.toPandas()
    con.execute("create table documents as select doc_id::bigint doc_id, text, source from frame")
    want = Counter(con.sql(M.ORACLE_SQL).fetchall())
    assert Counter(tuple(r) for r in M.mixed(docs)[1].collect()) == want


def test_rows_of_the_mix(spark):
    rows = [(1, "a b c", "x"), (2, "d e", "x"), (2, "d e", "x"), (None, "f g h i", "y"), (5, None, "y"), (6, "", "z")]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({"size": F.lit("keep"), "id": F.lit(1), "n": F.col("doc_id")})
    taken = Counter()
    for r in M.mixed(docs)[1].collect():
        if r["taken"]:
            taken[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    out = M.mix_rows(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +taken
    assert {r["size"] for r in out.collect()} == {"keep"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCUMENTS)
    turns, taken = M.mixed(empty)
    assert taken.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert turns.count() == taken.count() == M.mix_rows(empty).count() == 0


def test_only_words_less_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, " ", "a")], DOCUMENTS)
    assert sorted((tuple(r) for r in M.mixed(docs)[1].collect()), key=str) == sorted([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)], key=str)


def test_rows_without_ids_and_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    monkeypatch.setattr(M, "_WIDE_BITS", 1)
    rows = [(None, "w w", "a")] * 300 + [(7, "w w", "a")] * 300 + [(1, "w " * 400_000, "b"), (None, None, None), (2, "", "b")]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(4).withColumn("n", F.lit(5)).withColumn("by", F.lit("x"))
    out = M.mix_rows(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["source"]) for r in out.select("doc_id", "source").collect())
    _, taken = M.mixed(docs)
    words = {r["source_size"]: r["w"] for r in taken.groupBy("source_size").agg(F.sum("taken").alias("w")).collect()}
    assert 2 * (got[None, "a"] + got[7, "a"]) == words[1200] == 3600 and got[1, "b"] == round(words[400_000] / 400_000)
