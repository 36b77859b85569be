"""Whitening against a dense solve, and its edge cases."""

import numpy as np
import pytest

from framewright.llm import whitening
from framewright.llm.queries import QUERIES


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def table(spark):
    pick = np.random.default_rng(3)
    mixed = pick.normal(size=(300, 7)) @ pick.normal(size=(7, 7)) + 5
    rows = [(i, [float(c) for c in v], "x", 1.0) for i, v in enumerate(mixed.astype(np.float32))]
    rows += [(1000 + i, rows[3][1], "y", 2.0) for i in range(150)]  # a hot vector
    rows += [(2000, None, "n", 0.0), (2001, [1.0] * 6 + [None], "n", 0.0), (2002, [float("nan")] + [1.0] * 6, "n", 0.0)]
    rows += [(2003, [float("inf")] + [1.0] * 6, "n", 0.0), (2004, [1.0, 2.0], "short", 0.0), (2005, [], "empty", 0.0)]
    rows += [(None, rows[5][1], "no id", 0.0), (7, rows[7][1], "again", 0.0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n double").repartition(4), rows


def dense(rows, d):
    x = np.array([np.floor(np.array(r[1], float) * 256) for r in rows if usable(r[1]) and len(r[1]) == d])
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    return x, fit, values[::-1], vectors.T[::-1]


def test_against_a_dense_solve(table):
    df, rows = table
    _, fit, values, vectors = dense(rows, 7)
    model = whitening.fit_whitening(df, most=4)
    assert model.n == len(fit) and (model.sums == fit.sum(0)).all()
    assert np.allclose(model.values, values[:4], rtol=1e-12)
    assert np.allclose(np.abs((model.components * vectors[:4]).sum(1)), 1, atol=1e-13)
    assert np.allclose(model.explained, values[:4] / values.sum(), rtol=1e-12) and model.identity_error < 1e-10
    found = whitening.whiten(df, model).collect()
    assert len(found) == 300 + 150 + 2  # the pair of ids at the end, no unusable row
    mean = fit.sum(0) / len(fit)
    by_id = {r[0]: r[1] for r in rows if usable(r[1])}
    for r in found:
        x = np.floor(np.array(by_id[r["vec_id"]] if r["vec_id"] is not None else rows[5][1], float) * 256)
        assert np.allclose(r["whitened"], (x - mean) @ model.components.T / np.sqrt(model.values), atol=1e-10)
        assert r["deviation"] == sum(int(v) ** 2 for v in len(fit) * x - fit.sum(0))


def test_whitened_fit_list_is_white(table):
    _, rows = table
    _, fit, _, _ = dense(rows, 7)
    values, vectors = whitening.components(np.cov(fit.T, bias=True) * len(fit))
    z = (fit - fit.mean(0)) @ vectors.T / np.sqrt(values / len(fit))
    assert np.abs(np.cov(z.T, bias=True) - np.eye(7)).max() < 1e-11


@pytest.mark.parametrize("d", [1, 2, 5, 8, 33])
def test_factor_and_rotation(d):
    pick = np.random.default_rng(d)
    half = pick.normal(size=(d, d)) * 10.0 ** pick.uniform(-2, 2, d)
    a = half @ half.T
    factor, order = whitening.cholesky(a)
    assert np.allclose(factor @ factor.T, a[order][:, order], rtol=1e-10, atol=1e-12 * np.abs(a).max())
    turned = whitening.rotated(factor)
    gram = turned.T @ turned
    norms = np.sqrt(gram.diagonal())
    assert np.abs(gram / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13
    assert np.allclose(np.sort(whitening.components(a)[0])[::-1][:1], np.linalg.eigvalsh(a)[-1:], rtol=1e-12)


def test_lost_rank_and_equal_eigenvalues(spark):
    flat = [(i, [float(i), float(i), 0.0]) for i in range(20)]  # rank one
    model = whitening.fit_whitening(spark.createDataFrame(flat, "vec_id long, embedding array<double>"))
    assert len(model.values) == 1 and model.explained[0] == pytest.approx(1) and model.identity_error < 1e-12
    corners = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    model = whitening.fit_whitening(spark.createDataFrame(corners, "vec_id long, embedding array<double>"))
    assert np.allclose(model.values, 256.0**2) and model.identity_error < 1e-12


def test_nothing_to_fit(spark):
    schema = "vec_id long, embedding array<float>, deviation string"
    for rows in ([], [(1, None, "a")], [(1, [1.0, 2.0], "a"), (2, [1.0, 2.0], "b")]):
        df = spark.createDataFrame(rows, schema)
        model = whitening.fit_whitening(df)
        out = whitening.whiten(df, model)
        assert out.count() == (2 if len(rows) == 2 else 0) and sum(len(r["whitened"]) for r in out.collect()) == 0


def test_large_entries(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [5e12, 2.0])], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, whitening.fit_whitening(df)).collect()}
    assert found == {1: None, 2: None, 3: None}  # no long holds them


def test_query(spark, tmp_path, table):
    table[0].write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    assert len(rows) == 4 * 452 and {r["component"] for r in rows} == {1, 2, 3, 4}
    assert len({r["identity_error"] for r in rows}) == 1 and len({(r["component"], r["explained"]) for r in rows}) == 4
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    empty.write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op12_embedding_whitening"](spark, f"{tmp_path}/none").count() == 0
