from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as e
from granary.llm import lexical

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score), plainly: every item against every document."""
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c, n in counted:
            m = 75 + 25 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            found += [(-s, doc_id is None, doc_id or 0, doc_id)] * (s > 0)
        out += [(item_id, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_given_tables_match_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = sorted(con.sql(e.oracle_sql()["op12_lexical_search"]).fetchall())
    got = sorted(tuple(r) for r in e.queries()["op12_lexical_search"](spark, SF).collect())
    assert got == want and len(got) == 800


@pytest.mark.parametrize("block_pairs", [1 << 16, 3])
def test_brute_force_on_ties_nulls_and_repeats(spark, documents, block_pairs):
    docs = [(i, f"Alpha beta {'gamma ' * (i % 4)} x{i % 5} Ünïcode") for i in range(90)]  # many equal scores
    docs += [(7, "alpha beta x2"), (7, "alpha beta x2"), (None, "alpha beta gamma x2"), (None, None), (95, ""), (96, " -- ... "), (97, "the rest " * 40000), (98, "b" * 3_000_000 + " rare")]
    items = [(1, "ALPHA, gamma; gamma-x3"), (2, None), (3, ""), (4, "nowhere found"), (5, "the rest of it"), (5, "the rest of it"), (None, "rare ünïcode Ünïcode"), (6, "b" * 3_000_000)]
    got = lexical.ranked(documents(*docs), spark.createDataFrame(items, ITEMS), block_pairs=block_pairs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items)
    assert {r["item_id"] for r in got} == {1, 5, None, 6}


def test_empty_tables_and_other_columns(spark, documents):
    docs, items = documents((1, "a b"), (2, "c")), spark.createDataFrame([(1, "a")], ITEMS)
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    more = docs.selectExpr("*", "1 AS `a.b`", "'x' AS `key`", "2 AS score", "3 AS n")
    asked = items.selectExpr("*", "'x' AS `key`", "9 AS rank")
    assert [tuple(r) for r in lexical.ranked(more, asked).collect()] == [(1, 1, 1, brute([(1, "a b"), (2, "c")], [(1, "a")])[0][3])]


def test_parts_stay_below_the_bound_and_add_up():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 50, (70, 6))
    weights[11, 2] = 1234  # alone above the bound
    parts = lexical.exact_parts(weights, most_rows=16, most=100)
    back = np.zeros_like(weights)
    for span, part in parts:
        assert part.sum(axis=0).max() <= 100 and len(part) <= 16
        back[span] += part.astype(np.int64)
    assert (back == weights).all()
    # At the bound itself a product is still exact.
    top = np.array([[(lexical.EXACT - 1) // lexical._MOST_IMPACT]])
    (_, part), = lexical.exact_parts(top)
    assert int((np.array([[float(lexical._MOST_IMPACT)]]) @ part)[0, 0]) == int(top[0, 0]) * lexical._MOST_IMPACT


def test_the_best_keep_all_ties_in_order():
    best = lexical.Best(2, 3)
    rng = np.random.default_rng(5)
    ids, scores = rng.permutation(200), rng.integers(0, 4, (200, 2))
    for at in range(0, 200, 32):
        best.add(0, scores[at : at + 32], ids[at : at + 32], np.zeros(len(ids[at : at + 32]), dtype=bool))
    for j in (0, 1):
        want = sorted((-s, i) for s, i in zip(scores[:, j], ids) if s > 0)[:3]
        own = best.item == j
        assert list(zip(-best.score[own], best.doc[own])) == want


def test_lumps_of_a_text_hold_the_same_terms(monkeypatch):
    text = ("Wort größe 12,5 " * 50 + "x" * 100 + " end").encode()
    whole = [t for part in lexical.terms(text) for t in part]
    monkeypatch.setattr(lexical, "_LUMP", 17)
    assert [t for part in lexical.terms(text) for t in part] == whole == [w.encode() for w in words(text.decode())]
