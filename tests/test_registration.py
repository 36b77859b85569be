"""Triangles, votes, estimators, consensus, the model ladder and recovery on planted catalogues."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import registration

TRUE = {
    "translation": [1, 0, 12.5, 0, 1, -7.0, 0, 0, 1],
    "euclidean": [math.cos(0.2), -math.sin(0.2), 30.0, math.sin(0.2), math.cos(0.2), -12.0, 0, 0, 1],
    "similarity": [1.1 * math.cos(-0.1), 1.1 * math.sin(0.1), 8.0, 1.1 * math.sin(-0.1), 1.1 * math.cos(-0.1), 3.0, 0, 0, 1],
    "affine": [1.02, -0.05, 4.0, 0.08, 0.97, 9.0, 0, 0, 1],
    "homography": [1.01, -0.04, 4.0, 0.05, 0.98, 9.0, 3e-5, -2e-5, 1],
}


def moved(m, x, y):
    w = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def planted(spark, m, n=60, outliers=0.4, noise=0.0, frames=(1, 2), seed=1):
    pick, rows = random.Random(seed), []
    for frame in frames:
        for k in range(n):
            x, y = pick.uniform(0, 1000), pick.uniform(0, 800)
            tx, ty = moved(m, x, y)
            if k < n * outliers:
                tx, ty = pick.uniform(0, 1000), pick.uniform(0, 800)
            rows.append((frame, k, 1000 + k, x, y, tx + pick.gauss(0, noise), ty + pick.gauss(0, noise)))
    return spark.createDataFrame(rows, "frame int, a long, b long, rx double, ry double, tx double, ty double")


def error(m, true):
    return max(math.dist(moved(m, x, y), moved(true, x, y)) for x in (0, 500, 1000) for y in (0, 400, 800))


@pytest.mark.parametrize("model", registration.MODELS)
def test_fit_of_exact_matches(spark, model):
    for r in registration.fitted(planted(spark, TRUE[model], outliers=0), model).collect():
        assert error(r["m"], TRUE[model]) < 1e-6 and r["n"] == 60


@pytest.mark.parametrize("model", registration.MODELS)
def test_consensus_among_outliers(spark, model):
    """Four of ten matches are wrong, the others are off by a tenth of a pixel."""
    rows = registration.consensus(planted(spark, TRUE[model], noise=0.1), model, 0.6, seed=3).collect()
    assert len(rows) == 2
    for r in rows:
        assert error(r["m"], TRUE[model]) < (1.0 if model == "homography" else 0.35), r
        assert 33 <= r["inliers"] <= 40 and r["rms"] < 0.3 and r["hypotheses"] <= sum(registration.ROUNDS)


def test_same_seed_same_transforms(spark):
    pairs = planted(spark, TRUE["affine"], noise=0.2, frames=(1,))
    once = [tuple(r["m"]) for r in registration.consensus(pairs, "affine", 1.0, seed=5).collect()]
    again = [tuple(r["m"]) for r in registration.consensus(pairs.repartition(3), "affine", 1.0, seed=5).collect()]
    assert np.allclose(once, again, rtol=1e-9)


def test_confident_matches_are_drawn_first(spark):
    """Nine of ten are wrong, but the right ones are the most confident: the first samples are among them."""
    pairs = planted(spark, TRUE["similarity"], n=200, outliers=0.8, frames=(1,)).withColumn("confidence", F.when(F.col("a") >= 160, 1.0).otherwise(0.1))
    r = registration.consensus(pairs, "similarity", 0.5, seed=1).first()
    assert error(r["m"], TRUE["similarity"]) < 1e-6 and r["inliers"] >= 40


def test_drawn_numbers_differ(spark):
    df = spark.range(2000).selectExpr("1 AS frame", "id AS h", "4 + id % 5 AS pool").select("pool", registration._drawn(4, F.col("pool"), 9).alias("d"))
    rows = df.collect()
    assert all(len(set(r["d"])) == 4 and 0 <= min(r["d"]) and max(r["d"]) < r["pool"] for r in rows)
    assert len({tuple(sorted(r["d"])) for r in rows if r["pool"] == 8}) == math.comb(8, 4)


@pytest.mark.parametrize("model", ["euclidean", "affine"])
def test_ladder_takes_the_simplest(spark, model):
    rows = registration.model_ladder(planted(spark, TRUE[model], noise=0.02, frames=(1,)), 0.6, bar=0.1).collect()
    assert [r["model"] for r in rows] == [model]


def test_too_few_matches(spark):
    few = planted(spark, TRUE["affine"], n=2, outliers=0)
    assert registration.consensus(few, "affine", 1.0).count() == 0 and registration.fitted(few, "affine").count() == 0
    same = few.withColumns({c: F.lit(1.0) for c in ("rx", "ry", "tx", "ty")})
    assert registration.fitted(same, "similarity").count() == 0 and registration.fitted(same, "homography").count() == 0
    assert registration.consensus(few.filter("false"), "euclidean", 1.0).count() == 0


def catalogues(spark, m, n=40, lost=0.15, noise=0.05, seed=2):
    pick, left, right = random.Random(seed), [], []
    for k in range(n):
        x, y, flux = pick.uniform(0, 1000), pick.uniform(0, 800), pick.uniform(10, 99)
        if pick.random() > lost:
            left.append((1, k, x, y, flux))
        if pick.random() > lost:
            tx, ty = moved(m, x, y)
            right.append((1, 500 + k, tx + pick.gauss(0, noise), ty + pick.gauss(0, noise), flux))
    schema = "frame int, star long, x double, y double, flux double"
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def brute_triangles(stars, k):
    found = set()
    for p in stars:
        near = sorted((q for q in stars if q[0] != p[0]), key=lambda q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, q[0]))[:k]
        found |= {tuple(sorted([p, a, b])) for a, b in itertools.combinations(near, 2)}
    out = {}
    for c in found:
        sides = sorted((math.dist(c[i][1:], c[j][1:]), c[3 - i - j]) for i, j in ((0, 1), (1, 2), (0, 2)))
        (s, p), (m, q), (t, r) = sides
        turn = (q[1] - p[1]) * (r[2] - p[2]) - (q[2] - p[2]) * (r[1] - p[1])
        if t / s <= 10 and abs(turn) > 1e-3:
            out[p[0], q[0], r[0]] = (s / t, m / t, turn > 0)
    return out


def test_triangles_and_votes_against_plain_python(spark):
    left, right = catalogues(spark, TRUE["similarity"])
    counts = registration.neighbour_counts(left, right, 25)
    k = counts.first()["k"]
    sides, want = [], []
    for df in (left, right):
        few = sorted(((r["star"], r["x"], r["y"], r["flux"]) for r in df.collect()), key=lambda s: (-s[3], s[0]))[:25]
        want.append(brute_triangles([s[:3] for s in few], k))
        sides.append(registration.triangles(df, counts, 25))
        got = {(r["v0"], r["v1"], r["v2"]): (r["r0"], r["r1"], r["ccw"]) for r in sides[-1].collect()}
        assert got.keys() == want[-1].keys() and all(np.allclose(got[t][:2], want[-1][t][:2]) and got[t][2] == want[-1][t][2] for t in got)
    votes = {}
    for ta, (a0, a1, ac) in want[0].items():
        for tb, (b0, b1, bc) in want[1].items():
            if ac == bc and abs(a0 - b0) < 0.01 and abs(a1 - b1) < 0.01:
                for pair in zip(ta, tb):
                    votes[pair] = votes.get(pair, 0) + 1
    assert {(r["a"], r["b"]): r["votes"] for r in registration.triangle_votes(*sides).collect()} == votes


def test_mirrored_catalogues_get_no_votes_by_orientation(spark):
    left, _ = catalogues(spark, TRUE["similarity"], lost=0)
    right = left.withColumn("x", -F.col("x"))
    counts = registration.neighbour_counts(left, right, 25)
    shapes = [registration.triangles(df, counts, 25) for df in (left, right)]
    same = lambda oriented: registration.triangle_votes(*shapes, tolerance=1e-6, oriented=oriented).count()
    assert same(True) == 0 and same(False) > 0


def test_from_catalogues_to_all_matches(spark):
    """Triangles, votes, consensus and recovery give the transform and every star that both catalogues have."""
    left, right = catalogues(spark, TRUE["similarity"], n=60)
    voted = registration.match_catalogues(left, right, among=30)
    fit = registration.consensus(voted, "similarity", 0.5, seed=1)
    assert error(fit.first()["m"], TRUE["similarity"]) < 0.3
    at, found = registration.recovered(left, right, fit, voted, 0.5, "similarity")
    both = {r["star"] for r in left.collect()} & {r["star"] - 500 for r in right.collect()}
    assert {(r["a"], r["b"]) for r in found.collect()} == {(k, 500 + k) for k in both}
    assert error(at.first()["m"], TRUE["similarity"]) < 0.1


def test_recovery_never_ends_with_fewer(spark):
    left, right = catalogues(spark, TRUE["translation"], n=10, lost=0)
    wrong = spark.createDataFrame([(1, k, 509 - k) for k in range(10)], "frame int, a long, b long")
    m = spark.createDataFrame([(1, [float(c) for c in TRUE["affine"]])], "frame int, m array<double>")
    at, found = registration.recovered(left, right, m, wrong, 0.01, "translation")
    assert found.count() >= 10 and at.count() == 1


def test_catalogue_faults(spark):
    rows = [(1, 1, 1.0, 2.0, 3.0), (1, 2, None, 2.0, 3.0), (1, 3, 1.0, float("nan"), 3.0), (1, 4, 1.0, 2.0, None), (1, 5, 1.0, 2.0, float("inf"))]
    bad = registration.valid_catalogue(spark.createDataFrame(rows, "frame int, star int, x double, y double, fwhm double"))
    assert {(r["star"], r["fault"]) for r in bad.collect()} == {(2, "position"), (3, "position"), (4, "fwhm"), (5, "fwhm")}
