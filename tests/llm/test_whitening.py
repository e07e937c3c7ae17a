"""Whitening against numpy on one machine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import whitening


def brute(vectors, most=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(axis=0)
    apart = n * x - total
    y = apart.astype(float) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, (apart**2).sum(axis=1), y @ q, e, np.trace(v)


def check(rows, ids, vectors):
    n, deviation, projected, e, trace = brute(vectors)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    k = len(e)
    for c in range(1, k + 1):
        sign = 0
        for i, vec_id in enumerate(ids):
            r = got[vec_id, c][0]
            assert r.n == n and r.deviation == deviation[i]
            assert r.explained == pytest.approx(e[c - 1] / trace, rel=1e-6, abs=1e-9)
            if r.whitened is None:
                assert e[c - 1] < 1e-9 * e[0]
                continue
            want = projected[i, c - 1] / np.sqrt(e[c - 1])
            if not sign and abs(want) > 1e-3:
                sign = np.sign(want * r.whitened)
            assert r.whitened == pytest.approx((sign or 1) * want, abs=1e-7)
            assert r.identity_error < 1e-4
    assert len(rows) == len(ids) * k


def test_whitening_against_numpy(spark, noisy):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    p = d.toPandas()
    rows = noisy(d).withColumns({c: F.lit("own") for c in ("x", "index", "part", "values", "component", "whitened")})
    check(whitening.whitened(rows.repartition(6)).collect(), p["vec_id"].tolist(), p["embedding"].tolist())


def test_strips_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STRIP", 16)
    monkeypatch.setattr(whitening, "STRIPS", 2)
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(150, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])).tolist()
    v[70:] = [v[3]] * 80  # one vector holds half of all rows
    check(whitening.whitened(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").repartition(7)).collect(), list(range(150)), v)


def test_rows_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, -3.0], [2.5, -1.0, 0.25], [1.0, 0.0, 4.0], [-2.0, 0.7, 0.1]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1e300, 0.0, 0.0], [1.0, 2.0]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], "vec_id long, embedding array<double>")
    rows = whitening.whitened(d).collect()
    assert {r.vec_id for r in rows} == set(range(len(good)))
    check(rows, list(range(len(good))), good)
    assert whitening.whitened(d.where("false")).collect() == []
    assert whitening.whitened(d.where("vec_id >= 5 AND vec_id < 11")).collect() == []


def test_components_without_deviation(spark):
    v = [[float(k), 2.0 * k, 7.0] for k in range(9)]
    rows = whitening.whitened(spark.createDataFrame([(None if k == 4 else k, x) for k, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 27 and sum(r.vec_id is None for r in rows) == 3
    assert all((r.whitened is None) == (r.component > 1) for r in rows)
    assert rows[0].identity_error < 1e-9
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 for r in same)


def test_large_numbers_stay_exact_or_are_null(spark):
    v = [[2.0**39, 0.0], [-(2.0**39), 1.0], [0.0, 0.5]]
    rows = whitening.whitened(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).collect()
    want = brute(v)[1]
    for r in rows:
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None)
