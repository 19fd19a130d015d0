from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as e
from granary.llm import whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>"


def table(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def brute(rows, most=8):
    """n, {row number: deviation}, eigenvalues, whitened (rows x components) by numpy's own eigen-solver."""
    kept = [(i, v) for i, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in kept)
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in kept])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values.sum()).sum()))
    return n, deviation, values / values.sum(), centred @ vectors[:, :k] / np.sqrt(values[:k])


def compare(rows, got):
    n, deviation, shares, white = brute(rows)
    by = defaultdict(dict)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
        by[r["component"]].setdefault((r["vec_id"], r["deviation"]), []).append(r["whitened"])
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    assert sorted(by) == list(range(1, white.shape[1] + 1))
    for k, found in by.items():
        want = defaultdict(list)
        for (vec_id, _), d, w in zip(kept, deviation, white[:, k - 1]):
            want[vec_id, d].append(float(w))
        assert found.keys() == want.keys()
        top = max(want, key=lambda i: abs(want[i][0]))
        sign = 1 if found[top][0] * want[top][0] > 0 else -1
        for i in want:
            assert sorted(sign * w for w in found[i]) == pytest.approx(sorted(want[i]), abs=1e-7)


def test_given_table_matches_the_other_solver(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = e.queries()["op11_whitening"](spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(rows, got.collect())


def test_nulls_repeats_ragged_and_hot_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * (5, 4, 3, 2, 1, 0.5)]) for i in range(60)]
    rows += [(7, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])] * 40  # a third of all
    rows += [(None, [0.5] * 6), (200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [1.0, 2.0]), (205, [])]
    df = table(spark, rows).selectExpr("*", "1 AS component", "'x' AS w", "2 AS `a.b`")
    compare(rows, whitening.whitened(df.repartition(5)).collect())


def test_no_variance_few_components_and_empty_tables(spark):
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, [])])).count() == 0
    line = [(i, [float(i), 0.0, 2.0 * i]) for i in range(9)]
    got = whitening.whitened(table(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and got[0]["explained"] == pytest.approx(1)
    compare(line, got)


def test_deviations_are_exact_or_null(spark):
    big = [(1, [5e5, 0.0]), (2, [-5e5, 3.0]), (3, [0.0, 1.0]), (4, [3.0e38, 1.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(table(spark, big[:3])).collect()}
    assert got == dict(zip((1, 2, 3), brute(big[:3])[1])) and max(got.values()) > 1 << 53
    assert {r["deviation"] for r in whitening.whitened(table(spark, big)).collect()} == {None}


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_components_of_hard_matrices(n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    for values in (rng.random(n), np.exp(-1.0 * np.arange(n)), np.repeat([5.0, 3.0, 1.0], n)[:n], np.ones(n), np.zeros(n), 1 + 1e-9 * np.arange(n), np.eye(n)[0]):
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        found, vectors = whitening.components(v, 8)
        scale = max(np.abs(values).max(), 1e-300)
        assert found == pytest.approx(np.linalg.eigvalsh(v)[::-1][:8], abs=1e-13 * scale)
        assert np.abs(v @ vectors - vectors * found).max() <= 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-13


def test_the_polar_factor_is_the_matrix_sign():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((9, 9)))
    values = np.array([3, 1, 1e-8, 1e-14, -1e-12, -1e-3, -2, -5, 4])
    assert np.abs(whitening.polar((q * values) @ q.T)[:, :] @ q - q * np.sign(values))[:, [0, 1, 2, 5, 6, 7, 8]].max() < 1e-7


def test_too_long_vectors_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMS", 3)
    with pytest.raises(ValueError):
        whitening.whitened(table(spark, [(1, [1.0] * 4)]))
    with pytest.raises(ValueError):
        whitening.whitened(table(spark, [(1, [1.0] * 2), (2, [1.0] * 5_000_000), (3, [2.0])]))
