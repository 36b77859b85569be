"""Registration of star catalogues: triangles and votes, transform estimators, sample consensus, the model ladder, recovery.

Catalogues are (frame, star, x, y, flux, ...); matches are (frame, a, b, rx, ry, tx, ty) with the places that a transform
takes (rx, ry) from and (tx, ty) to. Triangles are made of the brightest stars of a frame, so a frame has a bounded number of
them; they meet by an equi-join on cells of their shape. Estimators need sums only: every model is solved from the same 24
sums of products, by frame or by frame and hypothesis, so hypotheses are scored and refitted by aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .catalog import brightest, greedy

#: Neighbours that make triangles with a star, the stars to each of them, least side, least squared area and
#: most elongated shape of a triangle, and the least turn of its corners as a share of the squared longest side.
FEWEST, MOST, STARS_EACH = 5, 10, 3
LEAST_SIDE, LEAST_AREA, ELONGATED, LEAST_TURN = 1e-10, 1e-6, 10.0, 1e-10
#: Shapes nearer than this in both ratios are alike; a match needs so many votes.
TOLERANCE, LEAST_VOTES = 0.01, 3


def valid_catalogue(stars: DataFrame) -> DataFrame:
    """(frame, star, fault): stars that a registration can't use: a place or a width that is missing or not finite."""
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    fault = F.when(~(finite("x") & finite("y")), "position").when(~finite("fwhm"), "fwhm")
    return stars.select("frame", "star", fault.alias("fault")).filter("fault IS NOT NULL")


def neighbour_counts(left: DataFrame, right: DataFrame, among: int) -> DataFrame:
    """(frame, k): how many neighbours make triangles, from the smaller of a frame's two catalogues."""
    count = lambda df, n: df.groupBy("frame").agg(F.least(F.count("*"), F.lit(among)).alias(n))
    both = count(left, "n").join(count(right, "m"), "frame")
    share = F.floor(F.least("n", "m") / STARS_EACH)
    return both.filter("n >= 3 AND m >= 3").select("frame", F.greatest(F.least(share, F.lit(MOST)), F.lit(FEWEST)).cast("int").alias("k"))


def triangles(stars: DataFrame, counts: DataFrame, among: int = 50) -> DataFrame:
    """(frame, v0, v1, v2, r0, r1, ccw): triangles of each of the ``among`` brightest stars with two of its ``k`` nearest,
    once each. v0 to v2 lie opposite the shortest, middle and longest side; r0 and r1 are the shorter sides as shares of the
    longest; ccw is whether v0, v1, v2 turn with the axes. Flat and elongated ones are left out."""
    few = brightest(stars, among).select("frame", F.struct("star", "x", "y").alias("p"))
    square = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    pairs = few.join(few.withColumnRenamed("p", "q"), "frame").filter("p.star <> q.star")  # at most ``among`` squared a frame
    order = Window.partitionBy("frame", "p.star").orderBy("d2", "q.star")
    near = pairs.withColumn("d2", square(F.col("p"), F.col("q"))).withColumn("rank", F.row_number().over(order))
    near = near.join(counts, "frame").filter("rank <= k").groupBy("frame", "p").agg(F.array_sort(F.collect_list("q")).alias("q"))
    ends = F.transform("q", lambda a, i: F.transform(F.slice("q", i + 2, F.size("q")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    each = near.select("frame", "p", F.explode(F.flatten(ends)).alias("e"))
    each = each.select("frame", F.array_sort(F.array("p", "e.a", "e.b")).alias("c")).distinct()
    corner = lambda i: F.get("c", F.lit(i))
    side = lambda i, j, k: F.struct(F.sqrt(square(corner(i), corner(j))).alias("d"), *(corner(k)[n].alias(n) for n in ("star", "x", "y")))
    sides = each.select("frame", F.array_sort(F.array(side(0, 1, 2), side(1, 2, 0), side(0, 2, 1))).alias("s"))
    role = lambda i, n: F.get("s", F.lit(i))[n]
    short, middle, long = (role(i, "d") for i in range(3))
    half = (short + middle + long) / 2
    area = half * (half - short) * (half - middle) * (half - long)
    turn = (role(1, "x") - role(0, "x")) * (role(2, "y") - role(0, "y")) - (role(1, "y") - role(0, "y")) * (role(2, "x") - role(0, "x"))
    whole = (short >= LEAST_SIDE) & (long / short <= ELONGATED) & (area >= LEAST_AREA) & (F.abs(turn) >= LEAST_TURN * long * long)
    named = sides.filter(whole).select("frame", *(role(i, "star").alias(f"v{i}") for i in range(3)), (short / long).alias("r0"), (middle / long).alias("r1"), (turn > 0).alias("ccw"))
    return named


def triangle_votes(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE, oriented: bool = True) -> DataFrame:
    """(frame, a, b, votes): how often a star of ``left``'s triangles has the place of one of ``right``'s in a triangle of like
    shape. Shapes meet by the cell of both ratios, cells being as wide as the tolerance; a left shape goes to the nine around."""
    cell = lambda c: F.floor(F.col(c) / tolerance).cast("int")
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.withColumn("n", F.explode(near)).withColumns({"c0": cell("r0") + F.col("n.i"), "c1": cell("r1") + F.col("n.j")}).drop("n")
    b = right.withColumns({"c0": cell("r0"), "c1": cell("r1")})
    b = b.select("frame", "c0", "c1", *(F.col(c).alias(f"o_{c}") for c in ("v0", "v1", "v2", "r0", "r1", "ccw")))
    alike = (F.abs(F.col("r0") - F.col("o_r0")) < tolerance) & (F.abs(F.col("r1") - F.col("o_r1")) < tolerance)
    if oriented:
        alike &= F.col("ccw") == F.col("o_ccw")
    pairs = a.join(b, ["frame", "c0", "c1"]).filter(alike)
    named = F.array(*(F.struct(F.col(f"v{i}").alias("a"), F.col(f"o_v{i}").alias("b")) for i in range(3)))
    return pairs.select("frame", F.explode(named).alias("p")).groupBy("frame", "p.a", "p.b").agg(F.count("*").alias("votes"))


def matches_by_votes(votes: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """(frame, a, b, votes, confidence): one-to-one matches by falling votes (ties by a, b) of at least ``least``; confidence is
    the share of the frame's most voted match."""
    found = greedy(votes.filter(F.col("votes") >= least).select("frame", "a", "b", "votes"), (-F.col("votes")).alias("rank"))
    most = found.groupBy("frame").agg(F.max("votes").alias("most"))
    return found.join(most, "frame").select("frame", "a", "b", "votes", (F.col("votes") / F.col("most")).alias("confidence"))


def match_catalogues(left: DataFrame, right: DataFrame, among: int = 50, least: int = LEAST_VOTES) -> DataFrame:
    """Matches of two catalogues of each frame by triangles and votes, with both places."""
    counts = neighbour_counts(left, right, among)
    votes = triangle_votes(triangles(left, counts, among), triangles(right, counts, among))
    return with_places(matches_by_votes(votes, least), left, right)


def with_places(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("frame", F.col("star").alias("a"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    b = right.select("frame", F.col("star").alias("b"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return matches.join(a, ["frame", "a"]).join(b, ["frame", "b"])


#: Models from fewest to most degrees of freedom, with the matches that fix one.
MODELS = {"translation": 1, "euclidean": 2, "similarity": 2, "affine": 3, "homography": 4}
#: Products of a place (x, y, 1), and what they are weighted by: 1, u, v, u * u + v * v for the place (u, v) of the other side.
_PRODUCTS = ("xx", "xy", "yy", "x", "y", "1")


def _sums() -> Column:
    x, y, u, v = (F.col(c) for c in ("x", "y", "u", "v"))
    products = (x * x, x * y, y * y, x, y, F.lit(1.0))
    return F.array(*(F.sum(p * w) for w in (F.lit(1.0), u, v, u * u + v * v) for p in products))


def solve(sums: np.ndarray, model: str) -> np.ndarray:
    """3x3 transforms (rows of nine) from rows of the 24 sums; NaN where they fix none. Numbers should be near one."""
    s = sums.reshape(-1, 4, 6)
    n = s[:, 0, 5]
    out = np.full((len(s), 9), np.nan)
    matrix = lambda part: s[:, part][:, [0, 1, 3, 1, 2, 4, 3, 4, 5]].reshape(-1, 3, 3)
    with np.errstate(all="ignore"):
        mx, my, mu, mv = s[:, 0, 3] / n, s[:, 0, 4] / n, s[:, 1, 5] / n, s[:, 2, 5] / n
        spread = (s[:, 0, 0] + s[:, 0, 2]) / n - mx * mx - my * my
        if model == "translation":
            out = np.stack([1 + 0 * n, 0 * n, mu - mx, 0 * n, 1 + 0 * n, mv - my, 0 * n, 0 * n, 1 + 0 * n], 1)
        elif model in ("euclidean", "similarity"):
            cos = (s[:, 1, 3] + s[:, 2, 4]) / n - mx * mu - my * mv
            sin = (s[:, 2, 3] - s[:, 1, 4]) / n - mx * mv + my * mu
            size = np.hypot(cos, sin) if model == "euclidean" else spread
            c, d = cos / size, sin / size
            out = np.stack([c, -d, mu - c * mx + d * my, d, c, mv - d * mx - c * my, 0 * n, 0 * n, 1 + 0 * n], 1)
            out[(spread < 1e-12) | (np.hypot(cos, sin) < 1e-12)] = np.nan
        elif model == "affine":
            p = matrix(0)
            good = np.linalg.cond(np.where(np.isfinite(p), p, 0)) < 1e12
            right = np.stack([s[:, 1, [3, 4, 5]], s[:, 2, [3, 4, 5]]], 2)
            rows = np.linalg.solve(p[good], right[good])
            out[good] = np.concatenate([rows[:, :, 0], rows[:, :, 1], np.tile([0.0, 0.0, 1.0], (good.sum(), 1))], 1)
        else:
            zero = np.zeros_like(matrix(0))
            p, qu, qv, r = (matrix(k) for k in range(4))
            normal = np.block([[p, zero, -qu], [zero, p, -qv], [-qu, -qv, r]])
            good = np.isfinite(normal).all((1, 2))
            values, vectors = np.linalg.eigh(normal[good])
            h = vectors[:, :, 0]
            unique = (values[:, 1] > 1e-12 * values[:, 8]) & (np.abs(h[:, 8]) > 1e-10)
            out[np.flatnonzero(good)[unique]] = h[unique] / h[unique, 8:]
    out[n < MODELS[model]] = np.nan
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def _solved(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``m``, the transform of their ``sums`` (without that column); those that fix none are left out."""
    kept = rows.drop("sums")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept.schema.fields)}, m array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, 24)
            found = solve(sums, model)
            good = ~np.isnan(found).any(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(good.sum() + 1, dtype=np.int32) * 9), pa.array(found[good].ravel()))
            part = batch.filter(pa.array(good)).drop_columns(["sums"])
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "m"])

    return rows.mapInArrow(run, schema)


def _placed(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda i: F.get(m, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return F.try_divide(at(0) * x + at(1) * y + at(2), w), F.try_divide(at(3) * x + at(4) * y + at(5), w)


def transformed_by(stars: DataFrame, transforms: DataFrame) -> DataFrame:
    """Stars at the places to which their frame's transform (frame, m) takes them; null where it takes them to infinity."""
    x, y = _placed(F.col("_m"), F.col("x"), F.col("y"))
    moved = stars.join(transforms.select("frame", F.col("m").alias("_m")), "frame")
    return moved.withColumns({"x": x, "y": y}).drop("_m")


def normalised(matches: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(matches with x, y, u, v and the right side's scale t; frames' scales): places about their frame's centre, of mean
    distance sqrt(2) on both sides, or by one scale for models without a scale of their own."""
    matches = matches.drop("x", "y", "u", "v", "r", "t")
    centres = matches.groupBy("frame").agg(*(F.avg(c).alias(f"c{c}") for c in ("rx", "ry", "tx", "ty")))
    off = matches.join(centres, "frame")
    away = lambda a, b: F.avg(F.hypot(F.col(a) - F.col(f"c{a}"), F.col(b) - F.col(f"c{b}")))
    keys = ["frame", *(f"c{c}" for c in ("rx", "ry", "tx", "ty"))]
    right = ("rx", "ry") if model in ("translation", "euclidean") else ("tx", "ty")
    scales = off.groupBy(*keys).agg(away("rx", "ry").alias("r"), away(*right).alias("t"))
    unit = lambda c: F.when(F.col(c) < 1e-10, 1.0).otherwise(F.try_divide(F.lit(math.sqrt(2)), F.col(c))).alias(c)
    scales = stored(scales.select(*keys, unit("r"), unit("t")))
    place = lambda c, s: (F.col(c) - F.col(f"c{c}")) * F.col(s)
    near = matches.join(scales, "frame").withColumns({"x": place("rx", "r"), "y": place("ry", "r"), "u": place("tx", "t"), "v": place("ty", "t")})
    return near.drop(*keys[1:], "r"), scales


def _plain(rows: DataFrame, scales: DataFrame) -> DataFrame:
    """Transforms between normalised places as transforms between places: to normalised ones of the left side, on to those of
    the right side, and back from there."""
    r, t, cx, cy, cu, cv = (F.col(c) for c in ("r", "t", "crx", "cry", "ctx", "cty"))
    m = lambda i: F.get("m", F.lit(i))
    to = [[m(3 * i) * r, m(3 * i + 1) * r, m(3 * i + 2) - m(3 * i) * r * cx - m(3 * i + 1) * r * cy] for i in range(3)]
    back = [[to[0][j] / t + cu * to[2][j] for j in range(3)], [to[1][j] / t + cv * to[2][j] for j in range(3)], to[2]]
    joined = rows.join(scales, "frame").withColumn("m", F.array(*(c for row in back for c in row)))
    joined = joined.filter(F.abs(m(8)) > 1e-12).withColumn("m", F.transform("m", lambda c: c / F.get("m", F.lit(8))))
    return joined.drop("r", "t", "crx", "cry", "ctx", "cty")


def fitted(matches: DataFrame, model: str) -> DataFrame:
    """(frame, n, m): each frame's least-squares transform as nine numbers, rows first; a homography by direct linear
    transform. Frames whose matches fix none are left out."""
    near, scales = normalised(matches.select("frame", "rx", "ry", "tx", "ty"), model)
    sums = near.groupBy("frame").agg(F.count("*").alias("n"), _sums().alias("sums"))
    return _plain(_solved(sums, model), scales)


#: Hypotheses of each round; and shares of all hypotheses, with the share of the matches, most confident first, that those
#: up to there draw from.
ROUNDS = (64, 192, 256)
POOLS = ((0.1, 0.25), (0.3, 0.5), (1.0, 1.0))


def _drawn(size: int, pool: Column, seed: int) -> Column:
    """``size`` different numbers below ``pool``, which is at least that: each is drawn below a limit that rises by one, and
    the limit itself stands for one that is there already."""
    found: list[Column] = []
    for j in range(size):
        limit = pool - size + j
        one = F.pmod(F.xxhash64(F.lit(seed), "frame", "h", F.lit(j)), limit + 1)
        for before in list(found):
            one = F.when(one == before, limit).otherwise(one)
        # the limit is new: all before are below it
        found.append(one)
    return F.array(*found)


def _scored(hypotheses: DataFrame, matches: DataFrame) -> DataFrame:
    """(frame, h, m, score, inliers, r2): score is the sum over matches of how far inside the threshold their squared
    residuals lie, as a share of it; r2 the sum of the inliers'."""
    joined = hypotheses.join(matches.select("frame", "x", "y", "u", "v", "bound"), "frame")
    px, py = _placed(F.col("m"), F.col("x"), F.col("y"))
    square = (px - F.col("u")) * (px - F.col("u")) + (py - F.col("v")) * (py - F.col("v"))
    inside = joined.withColumn("s", F.coalesce(square, F.lit(float("inf")))).withColumn("inside", F.col("s") <= F.col("bound"))
    gain = F.sum(F.when(F.col("inside"), 1 - F.col("s") / F.col("bound")).otherwise(0.0))
    found = inside.groupBy("frame", "h").agg(F.first("m").alias("m"), gain.alias("score"), F.count_if("inside").alias("inliers"), F.sum(F.when(F.col("inside"), F.col("s"))).alias("r2"))
    return found


def _refitted(best: DataFrame, matches: DataFrame, model: str) -> DataFrame:
    """The least-squares transforms of the inliers of ``best``, scored."""
    joined = matches.join(best.select("frame", "h", "m"), "frame")
    px, py = _placed(F.col("m"), F.col("x"), F.col("y"))
    inside = (px - F.col("u")) * (px - F.col("u")) + (py - F.col("v")) * (py - F.col("v")) <= F.col("bound")
    sums = joined.filter(inside).groupBy("frame", "h").agg(_sums().alias("sums"))
    return _scored(_solved(sums, model), matches)


def _best(rows: DataFrame) -> DataFrame:
    """Of each frame the row of the best score, the first hypothesis on ties."""
    order = F.struct("score", (-F.col("h")).alias("h"))
    return rows.groupBy("frame").agg(F.max_by(F.struct("h", "m", "score", "inliers", "r2"), order).alias("b")).select("frame", "b.*")


def consensus(matches: DataFrame, model: str, threshold: float, seed: int = 0, confidence: float = 0.999) -> DataFrame:
    """(frame, n, inliers, rms, hypotheses, m): the transform that most of a frame's matches agree with to ``threshold``.

    Each round draws samples for each frame by a hash of the seed, from the more confident matches first (``confidence``
    column, if there is one), scores the samples' transforms over all the frame's matches, and refits the best one twice to its
    inliers. A frame is done when its share of inliers makes it as likely as ``confidence`` that a sample without outliers
    was drawn. The same seed gives the same transforms. Frames whose matches fix none are left out.

    A frame should have a bounded number of matches, as those of the brightest stars are.
    """
    size = MODELS[model]
    told = F.col("confidence") if "confidence" in matches.columns else F.lit(1.0)
    near, scales = normalised(matches.select("frame", "a", "b", "rx", "ry", "tx", "ty", told.alias("told")), model)
    order = Window.partitionBy("frame").orderBy(F.desc("told"), "a", "b")
    bound = F.pow(F.col("t") * threshold, F.lit(2.0)).alias("bound")
    near = stored(near.select("frame", (F.row_number().over(order) - 1).cast("long").alias("pos"), "x", "y", "u", "v", bound))
    frames = stored(near.groupBy("frame").agg(F.count("*").alias("n")).filter(F.col("n") >= size))
    done, best = None, None
    for k, many in enumerate(ROUNDS):
        if frames.isEmpty():
            break
        tried = sum(ROUNDS[: k + 1])
        number = F.explode(F.sequence(F.lit(tried - many).cast("long"), F.lit(tried - 1).cast("long")))
        share = F.lit(None)
        for upto, part in POOLS:
            share = F.coalesce(share, F.when(F.col("h") < upto * sum(ROUNDS), part))
        drawn = frames.select("frame", "n", number.alias("h"))
        drawn = drawn.withColumn("pool", F.greatest(F.ceil(F.col("n") * share), F.lit(size)).cast("long"))
        drawn = drawn.select("frame", "h", F.explode(_drawn(size, F.col("pool"), seed)).alias("pos"))
        sums = drawn.join(near, ["frame", "pos"]).groupBy("frame", "h").agg(_sums().alias("sums"))
        found = stored(_best(_scored(_solved(sums, model), near)))
        for _ in range(2):
            found = found.unionByName(_refitted(found, near, model))
            found = stored(_best(found))
        best = found if best is None else stored(_best(best.join(frames.select("frame"), "frame", "left_semi").unionByName(found)))
        share = F.col("inliers") / F.col("n")
        clean = F.pow(share, F.lit(float(size)))
        needed = F.when(clean >= 1, 1.0).otherwise(F.try_divide(F.lit(math.log(1 - confidence)), F.log1p(-clean)))
        judged = frames.join(best, "frame", "left").withColumn("hypotheses", F.lit(tried))
        over = F.lit(True) if k == len(ROUNDS) - 1 else F.coalesce(needed <= F.col("hypotheses"), F.lit(False))
        judged = stored(judged.withColumn("over", over))
        ready = judged.filter("over AND m IS NOT NULL").drop("over")
        done = ready if done is None else done.unionByName(ready)
        frames = judged.filter("NOT over").select("frame", "n")
    if done is None:
        empty = "frame long, n long, inliers long, rms double, hypotheses int, m array<double>"
        return near.sparkSession.createDataFrame([], empty)
    rms = F.sqrt(F.col("r2") / F.col("inliers")) / F.col("t")
    with_rms = done.filter(F.col("inliers") >= size).join(scales.select("frame", "t"), "frame").withColumn("rms", rms)
    return _plain(with_rms.select("frame", "n", "inliers", "rms", "hypotheses", "m"), scales)


#: Fixed value: a model is good enough if its inliers' root mean square residual is at most so many pixels.
GOOD_RMS = 0.5
#: A model that fewer of the matches agree with fits a part of them only.
LEAST_SHARE = 0.3


def model_ladder(matches: DataFrame, threshold: float, bar: float = GOOD_RMS, seed: int = 0) -> DataFrame:
    """(frame, model, n, inliers, rms, hypotheses, m): of each frame the simplest model that fits to ``bar``; if none does, the most
    general one that ``LEAST_SHARE`` of the matches agree with."""
    left, found, fallback = stored(matches), None, None
    for model in ("euclidean", "similarity", "affine", "homography"):
        fits = consensus(left, model, threshold, seed).filter(F.col("inliers") >= LEAST_SHARE * F.col("n"))
        fits = stored(fits.withColumn("model", F.lit(model)))
        good = fits.filter(F.col("rms") <= bar)
        found = good if found is None else found.unionByName(good)
        if fallback is not None:
            fallback = fallback.join(fits.select("frame"), "frame", "left_anti").unionByName(fits)
        else:
            fallback = fits
        left = left.join(good.select("frame"), "frame", "left_anti")
    rest = fallback.join(found.select("frame"), "frame", "left_anti")
    return found.unionByName(rest).select("frame", "model", "n", "inliers", "rms", "hypotheses", "m")


#: Fixed value: passes of recovery at most.
PASSES = 5


def recovered(left: DataFrame, right: DataFrame, transforms: DataFrame, matches: DataFrame, threshold: float, model: str) -> tuple[DataFrame, DataFrame]:
    """(transforms (frame, m), matches (frame, a, b)) after stars that no match has are matched by their places.

    In each pass a free left star goes to the right star nearest to its transformed place, if that is within ``threshold`` and
    free; of several the one with the smallest star has it. Matches that the transform puts farther apart go, and if the number
    of matches changed, the transform is fitted to them again. A frame that would end with fewer matches than it had at first
    stays as it was.
    """
    from .catalog import within

    first = stored(matches.select("frame", "a", "b"))
    start = stored(transforms.select("frame", "m"))
    held, at, moving = first, start, start.select("frame")
    for _ in range(PASSES):
        free_left = left.join(moving, "frame", "left_semi").join(held.select("frame", F.col("a").alias("star")), ["frame", "star"], "left_anti")
        near = within(transformed_by(free_left, at).filter("x IS NOT NULL AND y IS NOT NULL"), right, threshold)
        nearest = near.groupBy("frame", "a").agg(F.min(F.struct("distance", "b")).alias("n")).select("frame", "a", F.col("n.b").alias("b"))
        nearest = nearest.join(held.select("frame", "b"), ["frame", "b"], "left_anti")
        new = nearest.groupBy("frame", "b").agg(F.min("a").alias("a")).select("frame", "a", "b")
        every = with_places(held.unionByName(new), left, right).join(at, "frame")
        px, py = _placed(F.col("m"), F.col("rx"), F.col("ry"))
        square = (px - F.col("tx")) * (px - F.col("tx")) + (py - F.col("ty")) * (py - F.col("ty"))
        kept = stored(every.filter(square <= threshold * threshold).drop("m"))
        count = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
        changed = stored(moving.join(count(held, "was"), "frame", "left").join(count(kept, "n"), "frame", "left").filter(F.coalesce("was", F.lit(0)) != F.coalesce("n", F.lit(0))).select("frame"))
        still = held.join(moving, "frame", "left_anti")
        held = stored(kept.join(moving, "frame", "left_semi").select("frame", "a", "b").unionByName(still))
        if changed.isEmpty():
            break
        again = fitted(kept.join(changed, "frame", "left_semi"), model).select("frame", "m")
        at = stored(at.join(again.select("frame"), "frame", "left_anti").unionByName(again))
        moving = changed
    was, now = (df.groupBy("frame").agg(F.count("*").alias(n)) for df, n in ((first, "was"), (held, "n")))
    worse = stored(was.join(now, "frame", "left").filter(F.coalesce("n", F.lit(0)) < F.col("was")).select("frame"))
    pick = lambda before, after: after.join(worse, "frame", "left_anti").unionByName(before.join(worse, "frame", "left_semi"))
    return pick(start, at), pick(first, held)
