from __future__ import annotations

import zlib
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from granary.llm import sharding

SF = "/root/testdata/sf0.001"


def walk(point, bits):
    """The curve's place of a point, by the table."""
    n = len(point)
    number, after = sharding.curve(n)
    state = index = 0
    for level in reversed(range(bits)):
        at = state << n | sum((c >> level & 1) << j for j, c in enumerate(point))
        state, index = after[at], index << n | number[at]
    return index


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_all_cells_by_steps_of_one(dims, bits):
    path = sorted(product(range(1 << bits), repeat=dims), key=lambda p: walk(p, bits))
    assert [walk(p, bits) for p in path] == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_spark_walks_the_same_curve(spark):
    points = spark.range(512).select(*(F.shiftright("id", 3 * j).bitwiseAND(7).cast("int").alias(c) for j, c in enumerate("abc")))
    got = points.withColumn("h", sharding.curve_index([F.col(c) for c in "abc"], 3)).collect()
    assert all(r["h"] == walk((r["a"], r["b"], r["c"]), 3) for r in got)


def test_given_table_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(e.oracle_sql()["op13_sharding"])
    got = e.queries()["op13_sharding"](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 200


def brute(rows, shards):
    """{row: (shard, slot)} of (doc_id, text, lang, source) rows that are all different."""
    sizes = [(r[3], r[2], len((r[1] or "").encode()) + 8) for r in rows]
    cell = lambda j, v: sum(1 for s in sizes if s[j] is not None and (v is None or s[j] < v)) * 64 // len(rows)
    key = lambda i: (walk([cell(j, sizes[i][j]) for j in range(3)], 6), zlib.crc32((rows[i][1] or "").encode()), rows[i][0] is None, rows[i][0] or 0)
    out, taken = {}, Counter()
    for rank, i in enumerate(sorted(range(len(rows)), key=key)):
        shard = rank * shards // len(rows)
        out[rows[i]] = (shard, taken[shard])
        taken[shard] += 1
    return out


def test_brute_force_on_nulls_and_a_hot_group(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)  # many ranges
    rows = [(i, "the same text", "en", "hot") for i in range(60)] + [(100 + i, "größer " * (i % 17), ("en", "de", None)[i % 3], ("a", None, "b", "c")[i % 4]) for i in range(70)]
    rows += [(None, "no id", "en", "a"), (500, None, "en", "a"), (501, "", None, None), (502, "long " * 50000, "de", "b")]
    found = sharding.sharded(documents(*rows), 7).collect()
    placed = {(r["doc_id"], r["lang"], r["source"]): (r["shard"], r["slot"]) for r in found}
    assert placed == {(r[0], r[2], r[3]): at for r, at in brute(rows, 7).items()}
    counts = Counter(r["shard"] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(found) == len(rows)
    for s, n in counts.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))


def test_repeated_rows_few_rows_and_empty_tables(spark, documents):
    same = documents(*[(1, "twice", "en", "a")] * 5)
    assert sorted((r["shard"], r["slot"]) for r in sharding.sharded(same, 2).collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert len({r["shard"] for r in sharding.sharded(same, 24).collect()}) == 5
    assert sharding.sharded(same.limit(0)).count() == 0
    clash = same.selectExpr("*", "1 AS shard", "2 AS slot", "3 AS `a.b`", "4 AS size")
    assert sharding.sharded(clash, 2).count() == 5


def test_shards_of_nearly_equal_bytes(spark, documents):
    docs = documents(*[(i, "w" * (1 + i * 37 % 300), "en", f"s{i % 5}") for i in range(900)], (1000, None, "en", "s1"))
    total = Counter()
    for r in sharding.sharded(docs, 6, law="bytes").collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 6 and max(total.values()) - min(total.values()) <= 2 * 308


def test_other_columns_keep_their_names_and_values(spark):
    rows = spark.range(40).selectExpr("id", "id % 3 AS `a.b`", "struct(id AS `c d`) AS s", "cast(id % 7 AS double) AS x")
    out = sharding.arranged(rows, ["a.b", "x"], ["id"], 4)
    assert out.columns == [*rows.columns, "shard", "slot"]
    assert sorted(r["id"] for r in out.collect() if r["s"]["c d"] == r["id"] and r["a.b"] == r["id"] % 3) == list(range(40))


def test_files_are_pruned_by_any_dimension(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = sharding.stored(docs)
    read = 0
    for limits in ({"source": ("src3", "src3")}, {"lang": ("de", "de")}, {"size": (0, 300)}):
        rows, shards = sharding.read_within(spark, path, **limits)
        (name, (low, high)), = limits.items()
        want = docs.withColumn("size", F.octet_length("text") + 8).where(F.col(name).between(low, high))
        assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in want.collect())
        read += len(shards)
    assert read < 2 * 24  # of 3 * 24
    _, shards = sharding.read_within(spark, path, source=("src3", "src5"), size=(0, 300))
    assert len(shards) < 12
