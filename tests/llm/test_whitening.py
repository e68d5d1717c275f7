"""TSQR whitening against a covariance in exact integers and numpy's eigenvectors."""

import math

import numpy as np
import pytest

from pagelathe.llm import whitening


def brute(rows: dict[int, list[float]], k: int = 8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in rows.values()], object)
    n, s = len(x), x.sum(axis=0)
    y = x * n - s  # exact
    deviation = (y * y).sum(axis=1)
    cov = (y.T @ y).astype(float) / n**3
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:k]
    e, v, trace = e[order], v[:, order], np.trace(cov)
    white = (y / n).astype(float) @ v / np.sqrt(e)
    return n, deviation, white, e / trace


def planted(n=700, d=12, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(0.9, 0.02, d)
    base[:, 1] += 0.5 * base[:, 0]
    return {i: base[i].tolist() for i in range(n)}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_against_exact_covariance(spark, parts):
    rows = planted()
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>").repartition(parts)
    got = whitening.components(df).collect()
    n, deviation, white, explained = brute(rows)
    assert len(got) == n * 8 and {r["n"] for r in got} == {n}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for j in range(8):
        ours = np.array([by[i, j + 1]["whitened"] for i in rows])
        sign = np.sign(ours[0] * white[0, j])
        assert np.allclose(ours * sign, white[:, j], atol=1e-8)
        assert math.isclose(by[0, j + 1]["explained"], explained[j], rel_tol=1e-9)
    assert [by[i, 1]["deviation"] for i in rows] == list(deviation)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_what_cannot_be_used_is_dropped(spark):
    rows = planted(40, 3)
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0]), (None, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<double>")
    got = whitening.components(df).collect()
    assert {r["vec_id"] for r in got} == {*rows, None} and {r["n"] for r in got} == {41}
    assert {r["component"] for r in got} == {1, 2, 3}


def test_no_variance_no_component_and_empty_table(spark):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], schema)
    assert whitening.components(same).collect() == []
    kept, model, _ = whitening.whiten(same)
    assert kept.count() == 5 and model.n == 5 and {r["deviation"] for r in kept.collect()} == {0}
    assert whitening.components(spark.createDataFrame([], schema)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], schema)  # rank one
    assert {r["component"] for r in whitening.components(line).collect()} == {1}


def test_huge_entries_and_clashing_names(spark):
    rows = [(i, [1e12 * i, -3e300 if i == 3 else 0.1 * i], "x", 1) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string, n int")
    kept, model, _ = whitening.whiten(df)
    assert model.wide and kept.columns == ["vec_id", "embedding", "n", "deviation", "whitened"] and kept.count() == 6
    assert whitening.components(df).where("vec_id = 3 and deviation is not null").count() == 0  # more than a long holds


def test_repeated_rows_count_each(spark):
    rows = planted(60, 4)
    twice = spark.createDataFrame([*rows.items()] * 2, "vec_id long, embedding array<double>")
    got = whitening.components(twice)
    assert got.count() == 60 * 2 * 4 and got.first()["n"] == 120
