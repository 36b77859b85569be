"""Drizzle kernels against plain NumPy, and what every kernel must keep."""

import numpy as np
import pytest

from framewright.operators import drizzling, raster

MAPS = {1: (1.0, 0.02, 0.3, -0.03, 0.99, -0.4), 2: (0.95, -0.1, 1.2, 0.1, 1.02, 0.25)}


def frames_of(spark, frames):
    rows = [(f, y, x, float(v)) for f, image in frames.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "frame int, y int, x int, v double")


def maps_of(spark, maps):
    return spark.createDataFrame([(f, *m) for f, m in maps.items()], "frame int, a double, b double, c double, d double, e double, f double")


def cut(polygon, inside, crossing):
    out = []
    for p, q in zip(polygon, polygon[1:] + polygon[:1]):
        if inside(p):
            out.append(p)
        if inside(p) != inside(q):
            out.append(crossing(p, q))
    return out


def clipped_area(polygon, oy, ox):
    """Area of a polygon cut to a cell side by side."""
    for axis, at, sign in ((0, ox - 0.5, 1), (0, ox + 0.5, -1), (1, oy - 0.5, 1), (1, oy + 0.5, -1)):
        inside = lambda p, axis=axis, at=at, sign=sign: sign * (p[axis] - at) >= 0

        def crossing(p, q, axis=axis, at=at):
            t = (at - p[axis]) / (q[axis] - p[axis])
            return tuple(a + t * (b - a) for a, b in zip(p, q))

        polygon = cut(polygon, inside, crossing)
        if not polygon:
            return 0.0
    return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(polygon, polygon[1:] + polygon[:1]))) / 2


def brute(frames, maps, kernel, scale, drop):
    h, w = next(iter(frames.values())).shape
    rows, columns = int(h * scale), int(w * scale)
    total, weight, squares = (np.zeros((rows, columns)) for _ in range(3))
    for f, image in frames.items():
        a, b, c, d, e, g = maps[f]
        to = lambda x, y, m=maps[f]: ((m[0] * x + m[1] * y + m[2] + 0.5) * scale - 0.5, (m[3] * x + m[4] * y + m[5] + 0.5) * scale - 0.5)
        area = abs(a * e - b * d)
        for (y, x), v in np.ndenumerate(image):
            cx, cy = to(x, y)
            for oy in range(rows):
                for ox in range(columns):
                    if abs(oy - cy) > 5 or abs(ox - cx) > 5:
                        continue
                    near = lambda c: int(np.floor(abs(c) + 0.5) * np.sign(c))
                    if kernel == "point":
                        k = float((oy, ox) == (near(cy), near(cx))) / area
                    elif kernel == "turbo":
                        half = drop * scale / 2
                        sides = [max(min(c + half, o + 0.5) - max(c - half, o - 0.5), 0) for c, o in ((cx, ox), (cy, oy))]
                        k = sides[0] * sides[1] / (4 * half * half) / area
                    elif kernel == "square":
                        half = drop / 2
                        corners = [to(x + dx, y + dy) for dx, dy in ((-half, -half), (half, -half), (half, half), (-half, half))]
                        k = clipped_area(corners, oy, ox) / (area * (drop * scale) ** 2)
                    else:
                        if kernel == "gaussian":
                            s = drop * scale / 2.3548
                            far, of = int(np.ceil(3 * s)), lambda d, s=s: np.exp(-d * d / (2 * s * s))
                        else:
                            far, of = 3, lambda d: np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
                        if abs(oy - near(cy)) > far or abs(ox - near(cx)) > far:
                            continue
                        i = np.arange(-far, far + 1)
                        k = float(of(oy - cy) * of(ox - cx) / (of(near(cy) + i - cy).sum() * of(near(cx) + i - cx).sum())) / area
                    total[oy, ox] += k * v
                    weight[oy, ox] += k
                    squares[oy, ox] += k * k
    return total, weight, squares


@pytest.mark.parametrize("kernel,scale,drop", [("square", 2.0, 0.8), ("turbo", 2.0, 0.8), ("point", 2.0, 0.8), ("gaussian", 2.0, 0.8), ("lanczos3", 1.0, 1.0), ("square", 1.5, 1.0)])
def test_kernels(spark, kernel, scale, drop):
    r = np.random.default_rng(4)
    frames = {f: r.uniform(0.1, 1, (8, 9)) for f in MAPS}
    total, weight, squares = brute(frames, MAPS, kernel, scale, drop)
    got = drizzling.drizzled(frames_of(spark, frames), maps_of(spark, MAPS), 8, 9, kernel, scale, drop, gate=0.1, border=-1.0).collect()
    seen = np.zeros(weight.shape, dtype=bool)
    for q in got:
        y, x = q["y"], q["x"]
        seen[y, x] = True
        assert q["weight"] == pytest.approx(weight[y, x], abs=1e-7)
        filled = weight[y, x] >= 0.1 * weight.max()
        if filled:
            assert q["v"] == pytest.approx(total[y, x] / weight[y, x] if kernel != "lanczos3" else max(total[y, x] / weight[y, x], 0), abs=1e-6)
            assert q["noise_gain"] == pytest.approx(squares[y, x] / weight[y, x] ** 2, abs=1e-6)
            assert 1 <= q["coverage"] <= 2
        else:
            assert q["v"] == -1
    assert not (np.abs(weight[~seen]) > 1e-7).any()


def test_turbo_is_the_plain_operator(spark):
    image = np.random.default_rng(1).uniform(0.1, 1, (6, 6))
    plain = {(r["oy"], r["ox"]): r["v"] for r in raster.drizzle(frames_of(spark, {1: image}), 0.25, 0.5).collect()}
    for r in drizzling.drizzled(frames_of(spark, {1: image}), maps_of(spark, {1: (1.0, 0.0, 0.25, 0.0, 1.0, 0.5)}), 6, 6, gate=0.0).collect():
        assert r["v"] == pytest.approx(plain[r["y"], r["x"]])


def test_weights_and_what_deposits_nothing(spark):
    flat = frames_of(spark, {1: np.full((4, 4), 1.0), 2: np.full((4, 4), 5.0), 3: np.full((4, 4), 9.0)})
    same = maps_of(spark, {1: (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 2: (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), 3: (1.0, 1.0, 0.0, 1.0, 1.0, 0.0)})
    weights = same.selectExpr("*", "CASE frame WHEN 1 THEN 3.0D WHEN 2 THEN 1.0D ELSE 1.0D END AS weight")  # 3 has no area
    rows = drizzling.drizzled(flat, weights, 4, 4, "square", 1.0, 1.0).collect()
    assert len(rows) == 16 and all(r["v"] == pytest.approx(2.0) and r["coverage"] == 2 for r in rows)
    masked = flat.selectExpr("*", "CASE WHEN frame = 2 AND x = 0 THEN 0.0D WHEN frame = 2 AND x = 1 THEN NULL ELSE 1.0D END AS w")
    rows = drizzling.drizzled(masked, same, 4, 4, "point", 1.0, 1.0).collect()
    assert {r["x"]: r["v"] for r in rows} == {0: 1.0, 1: 1.0, 2: 3.0, 3: 3.0}
    holes = flat.selectExpr("frame", "y", "x", "CASE WHEN frame = 2 THEN double('NaN') WHEN x = 3 THEN NULL ELSE v END AS v")
    rows = drizzling.drizzled(holes, same, 4, 4, "gaussian", 1.0, 1.0).collect()
    assert rows and all(r["v"] == pytest.approx(1.0) or r["v"] == 0 for r in rows)
    assert drizzling.drizzled(flat.limit(0), same, 4, 4).count() == 0
    for kernel, scale in (("other", 2.0), ("lanczos3", 2.0)):
        with pytest.raises(ValueError):
            drizzling.drizzled(flat, same, 4, 4, kernel, scale)
