"""Measuring stars: stamps around peaks, iterated weighted centroids, windowed covariances, sky rings, profile fits, metrics.

Pixels are (frame, y, x, v, sky, noise); peaks are (frame, star, py, px). Frames go in tiles with a border as wide as a stamp
reaches, so a pixel is shuffled once or a few times near an edge, however many stars lie near it, and a frame is never in one
task. A tile's stamps are cut out of its grid a few at a time and measured at once, each on its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.imaging import FWHM_OF_SIGMA

#: Stamp radius as a multiple of the width, and its bounds; the ring around the stamp reaches half as far again.
STAMP_OF_WIDTH, LEAST_RADIUS, MOST_RADIUS, RING = 1.75, 4, 15, 1.5
#: The centroid's window as a share of the profile's, its least size, and when its steps end.
WINDOW, LEAST_SIGMA, SMALL_STEP, STEPS = 0.8, 1.0, 1e-4, 10
#: Bounds of a window's variance, when its steps end, and their number.
LEAST_VARIANCE, MOST_VARIANCE, SAME_VARIANCE, WINDOWS = 0.25, 100.0, 1e-3, 4
#: Clipping of a ring's pixels, its rounds, and the pixels that it needs.
RING_CLIP, RING_ROUNDS, RING_LEAST = 3.0, 2, 10
#: Side of a tile, and stamps that are measured at once.
TILE, AT_ONCE = 64, 256
_EPSILON = 2.220446049250313e-16


def stamp_radius(fwhm: float) -> int:
    return int(min(max(np.ceil(STAMP_OF_WIDTH * fwhm), LEAST_RADIUS), MOST_RADIUS))


@dataclass
class Stamps:
    """``v``, ``sky``, ``noise``: (star, line, column); ``py``, ``px``: the place of the middle."""

    v: np.ndarray
    sky: np.ndarray
    noise: np.ndarray
    py: np.ndarray
    px: np.ndarray

    @staticmethod
    def cut(grids: list[np.ndarray], py: np.ndarray, px: np.ndarray, top: int, left: int, reach: int) -> Stamps:
        """The stamps around places out of the grids of v, sky and noise, whose first pixel is at (top, left)."""
        span = np.arange(-reach, reach + 1)
        at = ((py - top)[:, None, None] + span[:, None], (px - left)[:, None, None] + span)
        return Stamps(*(g[at] for g in grids), py, px)

    @property
    def reach(self) -> int:
        return self.v.shape[1] // 2

    def around(self, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, Stamps]:
        """(whether all its pixels are there, stamp) of ``radius`` about the pixel nearest to each place."""
        cy, cx = (np.floor(c + 0.5).astype(int) for c in (y, x))
        off = np.stack([cy - self.py, cx - self.px]) + self.reach - radius
        room = 2 * (self.reach - radius)
        good = ((off >= 0) & (off <= room)).all(0) & np.isfinite(x) & np.isfinite(y)
        off = np.where(good, off, 0)
        span = np.arange(2 * radius + 1)
        at = (np.arange(len(x))[:, None, None], off[0][:, None, None] + span[:, None], off[1][:, None, None] + span)
        cut = Stamps(self.v[at], self.sky[at], self.noise[at], cy, cx)
        return good & np.isfinite(cut.v).all((1, 2)), cut

    def offsets(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of its columns and lines from a place."""
        span = np.arange(self.v.shape[1]) - self.reach
        return span + (self.px - x)[:, None], span + (self.py - y)[:, None]


def centroids(found: Stamps, fwhm: float, radius: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): centres of light above the sky under a round window that follows them; NaN for stars whose stamp leaves the
    frame, without light, or whose centre runs off."""
    sigma = min(max(fwhm / FWHM_OF_SIGMA * WINDOW, LEAST_SIGMA), radius * 0.5)
    x, y = found.px.astype(float), found.py.astype(float)
    moving = np.ones(len(x), bool)
    for _ in range(steps):
        good, cut = found.around(x, y, radius)
        dx, dy = cut.offsets(x, y)
        light = np.maximum(cut.v - cut.sky, 0)
        weight = light * np.exp(-dy * dy / (2 * sigma * sigma))[:, :, None] * np.exp(-dx * dx / (2 * sigma * sigma))[:, None, :]
        with np.errstate(all="ignore"):
            total = weight.sum((1, 2))
            sx, sy = (weight * dx[:, None, :]).sum((1, 2)) / total, (weight * dy[:, :, None]).sum((1, 2)) / total
            far = (2 * radius + 1) / 4
            lost = moving & (~good | ~(total >= _EPSILON) | ~(np.abs(sx) <= far) | ~(np.abs(sy) <= far))
            small = sx * sx + sy * sy < SMALL_STEP * SMALL_STEP
        x, y = np.where(moving, x + sx, x), np.where(moving, y + sy, y)
        x, y = np.where(lost, np.nan, x), np.where(lost, np.nan, y)
        moving &= ~lost & ~small
    return x, y


def _inverse(xx, yy, xy):
    det = xx * yy - xy * xy
    with np.errstate(all="ignore"):
        return np.abs(det) >= 1e-12, yy / det, xx / det, -xy / det


def covariances(light: np.ndarray, dx: np.ndarray, dy: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(xx, yy, xy): second moments under a round window matched to them, the window then taken out again; NaN where no window
    gives a positive covariance."""
    best = np.full((3, len(light)), np.nan)
    window = np.clip(start, LEAST_VARIANCE, MOST_VARIANCE)
    moving = np.isfinite(window)
    for _ in range(WINDOWS):
        with np.errstate(all="ignore"):
            weight = light * np.exp(-dy * dy / (2 * window[:, None]))[:, :, None] * np.exp(-dx * dx / (2 * window[:, None]))[:, None, :]
            total = weight.sum((1, 2))
            xx = (weight * (dx * dx)[:, None, :]).sum((1, 2)) / total
            yy = (weight * (dy * dy)[:, :, None]).sum((1, 2)) / total
            xy = (weight * dy[:, :, None] * dx[:, None, :]).sum((1, 2)) / total
            fine, ixx, iyy, ixy = _inverse(xx, yy, xy)
            sharp, cxx, cyy, cxy = _inverse(ixx - 1 / window, iyy - 1 / window, ixy)
            moving &= (total >= _EPSILON) & fine & sharp & (cxx * cyy - cxy * cxy > 0) & (cxx + cyy > 0)
            best[:, moving] = np.stack([cxx, cyy, cxy])[:, moving]
            new = np.clip((cxx + cyy) / 2, LEAST_VARIANCE, MOST_VARIANCE)
            still = np.abs(new - window) < SAME_VARIANCE * window
        window = np.where(moving, new, window)
        moving &= ~still
    return tuple(best)


def rings(found: Stamps, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(sky, noise): clipped median and deviation of the pixels between the stamp's radius and half as far again; NaN where
    there are too few."""
    outer = int(np.ceil(radius * RING))
    cy, cx = np.floor(y + 0.5), np.floor(x + 0.5)
    span = np.arange(found.v.shape[1]) - found.reach
    r2 = ((span + (found.py - cy)[:, None]) ** 2)[:, :, None] + ((span + (found.px - cx)[:, None]) ** 2)[:, None, :]
    values = np.where((r2 >= radius * radius) & (r2 <= outer * outer), found.v, np.nan).reshape(len(x), -1)
    enough = np.isfinite(values).sum(1) >= RING_LEAST
    values[~enough] = np.nan
    centre = spread = np.full(len(x), np.nan)
    rows = np.flatnonzero(enough)
    if len(rows):
        part, centre, spread = values[rows], centre.copy(), spread.copy()
        for _ in range(RING_ROUNDS + 1):
            m = np.nanmedian(part, 1)
            d = np.nanmedian(np.abs(part - m[:, None]), 1) * 1.4826022
            centre[rows], spread[rows] = m, d
            part = np.where(np.abs(part - m[:, None]) <= RING_CLIP * np.maximum(d, 1e-30)[:, None], part, np.nan)
    return centre, spread


#: Rounds of a fit, its first damping and how this changes, and the step at which it has converged.
FIT_ROUNDS, DAMPING, MORE, LESS, FIT_STEP = 60, 1e-3, 10.0, 0.1, 1e-4
#: Fixed value: widths of a profile are at least so much, and at most twice the stamp's radius.
LEAST_WIDTH = 0.5


def _least_squares(model, start: np.ndarray, data: np.ndarray, limits) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, converged) by damped Gauss-Newton steps of many stars at once. ``model(p)``: values and derivatives as
    (star, pixel) and (star, pixel, parameter); a step counts for the stars whose squares it lessens."""
    p, damping = start.copy(), np.full(len(start), DAMPING)
    value, slope = model(p)
    error = ((data - value) ** 2).sum(1)
    done = ~np.isfinite(error)
    converged = np.zeros(len(p), bool)
    for _ in range(FIT_ROUNDS):
        if done.all():
            break
        normal = slope.transpose(0, 2, 1) @ slope
        right = (slope * (data - value)[:, :, None]).sum(1)
        size = normal.diagonal(axis1=1, axis2=2)
        damped = normal + np.eye(p.shape[1]) * (damping[:, None] * np.maximum(size, 1e-12))[:, None, :]
        step = np.linalg.solve(np.where(np.isfinite(damped), damped, np.eye(p.shape[1])), right[:, :, None])[:, :, 0]
        new = limits(np.where(done[:, None], p, p + step))
        new_value, new_slope = model(new)
        with np.errstate(all="ignore"):
            new_error = ((data - new_value) ** 2).sum(1)
            better = ~done & (new_error <= error)
            small = better & (np.abs(new[:, 1:3] - p[:, 1:3]).max(1) < FIT_STEP) & (error - new_error <= 1e-6 * error + 1e-20)
        p = np.where(better[:, None], new, p)
        value, slope = np.where(better[:, None], new_value, value), np.where(better[:, None, None], new_slope, slope)
        error = np.where(better, new_error, error)
        damping = np.where(better, damping * LESS, damping * MORE)
        converged |= small
        done |= small | (damping > 1e12)
    return p, converged


def fit_gaussians(found: Stamps, x: np.ndarray, y: np.ndarray, radius: int, sigma: float, sky: np.ndarray) -> dict[str, np.ndarray]:
    """Amplitude, place, width along both axes and sky of an elliptic Gaussian for each star."""
    good, cut = found.around(x, y, radius)
    n, size = len(x), cut.v.shape[1] ** 2
    gx, gy = (np.broadcast_to(g, (n, cut.v.shape[1], cut.v.shape[1])).reshape(n, size) for g in _grid(cut))
    data = np.where(good[:, None], cut.v.reshape(n, size), 0.0)

    def model(p: np.ndarray):
        a, x0, y0, sx, sy, bg = (c[:, None] for c in p.T)
        dx, dy = gx - x0, gy - y0
        shape = np.exp(-0.5 * (dx * dx / (sx * sx) + dy * dy / (sy * sy)))
        lit = a * shape
        return lit + bg, np.stack([shape, lit * dx / (sx * sx), lit * dy / (sy * sy), lit * dx * dx / sx**3, lit * dy * dy / sy**3, np.ones_like(lit)], 2)

    def limits(p: np.ndarray) -> np.ndarray:
        p = p.copy()
        p[:, 0] = np.maximum(p[:, 0], 1e-9)
        p[:, 3:5] = np.clip(p[:, 3:5], LEAST_WIDTH, 2.0 * radius)
        return p

    start = np.stack([np.maximum(data.max(1) - sky, 1e-6), np.nan_to_num(x), np.nan_to_num(y), np.full(n, sigma), np.full(n, sigma), np.nan_to_num(sky)], 1)
    p, converged = _least_squares(model, start, data, limits)
    converged &= good & (np.hypot(p[:, 1] - x, p[:, 2] - y) <= radius)
    return {"x": p[:, 1], "y": p[:, 2], "amplitude": p[:, 0], "sigma_x": p[:, 3], "sigma_y": p[:, 4], "sky": p[:, 5], "converged": converged}


def fit_moffats(found: Stamps, x: np.ndarray, y: np.ndarray, radius: int, fwhm: float, beta: float, sky: np.ndarray) -> dict[str, np.ndarray]:
    """Amplitude, place, scale and sky of a round profile (1 + r^2 / alpha^2) ** -beta, of a given beta, for each star."""
    good, cut = found.around(x, y, radius)
    n, size = len(x), cut.v.shape[1] ** 2
    gx, gy = (np.broadcast_to(g, (n, cut.v.shape[1], cut.v.shape[1])).reshape(n, size) for g in _grid(cut))
    data = np.where(good[:, None], cut.v.reshape(n, size), 0.0)

    def model(p: np.ndarray):
        a, x0, y0, alpha, bg = (c[:, None] for c in p.T)
        dx, dy = gx - x0, gy - y0
        base = 1 + (dx * dx + dy * dy) / (alpha * alpha)
        shape = base**-beta
        slope = 2 * beta * a * shape / base / (alpha * alpha)
        return a * shape + bg, np.stack([shape, slope * dx, slope * dy, slope * (dx * dx + dy * dy) / alpha, np.ones_like(shape)], 2)

    def limits(p: np.ndarray) -> np.ndarray:
        p = p.copy()
        p[:, 0] = np.maximum(p[:, 0], 1e-9)
        p[:, 3] = np.clip(p[:, 3], LEAST_WIDTH, 2.0 * radius)
        return p

    alpha = fwhm / (2 * np.sqrt(2 ** (1 / beta) - 1))
    start = np.stack([np.maximum(data.max(1) - sky, 1e-6), np.nan_to_num(x), np.nan_to_num(y), np.full(n, alpha), np.nan_to_num(sky)], 1)
    p, converged = _least_squares(model, start, data, limits)
    converged &= good & (np.hypot(p[:, 1] - x, p[:, 2] - y) <= radius)
    return {"x": p[:, 1], "y": p[:, 2], "amplitude": p[:, 0], "fwhm": 2 * p[:, 3] * np.sqrt(2 ** (1 / beta) - 1), "sky": p[:, 4], "converged": converged}


def _grid(cut: Stamps) -> tuple[np.ndarray, np.ndarray]:
    span = np.arange(cut.v.shape[1]) - cut.reach
    return (cut.px[:, None] + span)[:, None, :], (cut.py[:, None] + span)[:, :, None]


METRICS = "x double, y double, flux double, fwhm double, eccentricity double, snr double, peak double, sharpness double, ground double, sround double"


def _metrics(found: Stamps, x: np.ndarray, y: np.ndarray, radius: int, ring: tuple[np.ndarray, np.ndarray] | None) -> dict[str, np.ndarray]:
    good, cut = found.around(x, y, radius)
    dx, dy = cut.offsets(np.nan_to_num(x), np.nan_to_num(y))
    sky = cut.sky if ring is None else np.where(np.isfinite(ring[0])[:, None, None], ring[0][:, None, None], cut.sky)
    signed = cut.v - sky
    light = np.maximum(signed, 0)
    with np.errstate(all="ignore"):
        flux = light.sum((1, 2))
        xx, yy = (light * (dx * dx)[:, None, :]).sum((1, 2)) / flux, (light * (dy * dy)[:, :, None]).sum((1, 2)) / flux
        xy = (light * dy[:, :, None] * dx[:, None, :]).sum((1, 2)) / flux
        good &= flux >= _EPSILON
        windowed = covariances(signed, dx, dy, np.where(good, np.maximum((xx + yy) / 2, LEAST_VARIANCE), np.nan))
        plain = np.isnan(windowed[0])
        xx, yy, xy = (np.where(plain, p, w) for p, w in zip((xx, yy, xy), windowed))
        trace, det = xx + yy, xx * yy - xy * xy
        root = np.sqrt(np.maximum(trace * trace - 4 * det, 0))
        large, small = (trace + root) / 2, (trace - root) / 2
        eccentricity = np.where(large > _EPSILON, np.clip(np.sqrt(np.maximum(1 - small / large, 0)), 0, 1), 0.0)
        core = light[:, radius - 1 : radius + 2, radius - 1 : radius + 2].sum((1, 2))
        sharpness = np.where(core > _EPSILON, np.clip(light.max((1, 2)) / core, 0, 1), 1.0)
        columns, lines = light.sum(1), light.sum(2)
        span = np.arange(2 * radius + 1) - radius
        outer = span[:, None] ** 2 + span**2 > (radius - 2) ** 2
        noise = cut.noise[:, outer].mean(1)
        if ring is not None:
            noise = np.where(np.isfinite(ring[0]), ring[1], noise)
        snr = flux / np.sqrt(np.maximum((2 * radius + 1) ** 2 * noise * noise, 1.1920929e-7))
        tall, wide = lines.max(1), columns.max(1)
        ground = np.where(tall + wide > _EPSILON, (wide - tall) / (wide + tall), 0.0)
        lopsided = lambda before, after: np.where(before + after > _EPSILON, (after - before) / (before + after), 0.0)
        sround = np.clip(np.hypot(*(lopsided(m[:, :radius].sum(1), m[:, radius + 1 :].sum(1)) for m in (columns, lines))), 0, 1)
    return {"flux": flux, "fwhm": FWHM_OF_SIGMA * np.sqrt(np.maximum(trace / 2, 0)), "eccentricity": eccentricity, "snr": snr,
            "peak": cut.v.max((1, 2)), "sharpness": sharpness, "ground": ground, "sround": sround, "good": good}


def measured_stars(pixels: DataFrame, peaks: DataFrame, fwhm: float, method: str = "moments", beta: float = 2.5, steps: int = STEPS, ring: bool = False, tile: int = TILE) -> DataFrame:
    """(frame, star, x, y, flux, fwhm, eccentricity, snr, peak, sharpness, ground, sround): the stars around ``peaks`` whose
    stamps lie in the frame.

    ``method``: centres by windowed moments, or by a ``gaussian`` or ``moffat`` profile from two of their steps, whose widths then
    count, too, where the fit converges. ``ring``: the sky and noise of a ring around the stamp instead of the pixels' own.
    Results don't depend on ``tile``.
    """
    if method not in ("moments", "gaussian", "moffat"):
        raise ValueError(f"unknown method {method}")
    radius = stamp_radius(fwhm)
    reach = int(np.ceil(radius * RING)) + radius // 2 + 1
    names = [f.split()[0] for f in METRICS.split(", ")]

    def measured(found: Stamps) -> tuple[np.ndarray, list[np.ndarray]]:
        x, y = centroids(found, fwhm, radius, steps if method == "moments" else 2)
        around = rings(found, np.nan_to_num(x), np.nan_to_num(y), radius) if ring else None
        fit = None
        if method != "moments":
            at = found.around(x, y, radius)[1]
            level = at.sky[:, radius, radius] if around is None else np.where(np.isfinite(around[0]), around[0], at.sky[:, radius, radius])
            level = np.nan_to_num(level)
            fit = fit_gaussians(found, x, y, radius, fwhm / FWHM_OF_SIGMA, level) if method == "gaussian" else fit_moffats(found, x, y, radius, fwhm, beta, level)
            x, y = np.where(fit["converged"], fit["x"], x), np.where(fit["converged"], fit["y"], y)
        out = _metrics(found, x, y, radius, around) | {"x": x, "y": y}
        if fit is not None:
            wide = fit["fwhm"] if method == "moffat" else FWHM_OF_SIGMA * np.sqrt(fit["sigma_x"] * fit["sigma_y"])
            out["fwhm"] = np.where(fit["converged"], wide, out["fwhm"])
        if method == "gaussian":
            low, high = np.minimum(fit["sigma_x"], fit["sigma_y"]), np.maximum(fit["sigma_x"], fit["sigma_y"])
            out["eccentricity"] = np.where(fit["converged"], np.sqrt(np.clip(1 - (low / high) ** 2, 0, 1)), out["eccentricity"])
        return out["good"] & np.isfinite(x), [out[n] for n in names]

    def run(wanted: pa.Table, found: pa.Table) -> pa.Table:
        done = [(np.zeros(0, bool), [np.zeros(0)] * len(names))]
        if len(wanted) and len(found):
            top, left = (wanted[c][0].as_py() * tile - reach for c in ("ty", "tx"))
            grids = [np.full((tile + 2 * reach, tile + 2 * reach), np.nan) for _ in range(3)]
            for grid, c in zip(grids, ("v", "sky", "noise")):
                grid[found["_y"].to_numpy() - top, found["_x"].to_numpy() - left] = found[c].to_numpy()
            py, px = (wanted[c].to_numpy().astype(int) for c in ("py", "px"))
            done += [measured(Stamps.cut(grids, py[i : i + AT_ONCE], px[i : i + AT_ONCE], top, left, reach)) for i in range(0, len(py), AT_ONCE)]
        good, *values = (np.concatenate(c) for c in zip(*((g, *v) for g, v in done)))
        rows = wanted.select(["frame", "star"]).slice(0, len(good))
        return pa.table([*rows.columns, *values], ["frame", "star", *names]).filter(pa.array(good))

    given = lambda c: F.floor(F.col(c) / tile).cast("int")
    asked = peaks.filter("frame IS NOT NULL AND py IS NOT NULL AND px IS NOT NULL").select("frame", "star", "py", "px").distinct()
    asked = asked.select("frame", given("py").alias("ty"), given("px").alias("tx"), "star", "py", "px")
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile).cast("int"), F.floor((F.col(c) + reach) / tile).cast("int")))
    source = pixels.filter("y IS NOT NULL AND x IS NOT NULL").withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))
    source = source.select(F.col("frame").alias("_frame"), "_ty", "_tx", F.col("y").alias("_y"), F.col("x").alias("_x"), *(F.col(c).cast("double").alias(c) for c in ("v", "sky", "noise")))
    kinds = dict(peaks.dtypes)
    out = asked.groupBy("frame", "ty", "tx").cogroup(source.groupBy("_frame", "_ty", "_tx"))
    return out.applyInArrow(run, f"frame {kinds['frame']}, star {kinds['star']}, {METRICS}")
