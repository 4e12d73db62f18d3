"""Instrument drift from lines of the Earth's atmosphere.

Water lines stand still while the Sun's own line moves with its rotation, so
they tell the instrument's flexure from velocity, and the slit's own velocity
from its curvature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import numeric as N

H_ALPHA = 6562.801
#: Distances from H alpha, in Angstrom, of strong water lines and of the Sun's lines among them.
WATER = np.array([-18.891, -14.181, -10.171, -5.631, -4.651, -2.301, -1.701, 1.409, 2.729, 6.009, 9.279])
SOLAR = np.array([-16.561, -11.121, -3.221, 6.409])


@dataclass(frozen=True)
class Flexure:
    series: np.ndarray
    lines: int
    offsets: tuple[float, ...]
    dispersion: float


def dip_places(x: np.ndarray, rows: np.ndarray, x0: float, core: float = 2.5) -> np.ndarray:
    """Place of the dip near x0 in each row after its flanks are flattened by
    a robust parabola; NaN where there is none inside."""
    out = np.full(len(rows), np.nan)
    flank = np.abs(x - x0) > core
    if flank.sum() < 5:
        return out
    inner = np.flatnonzero(np.abs(x - x0) <= core + 1)
    for i, row in enumerate(rows):
        base = N.fit_robust(x[flank], row[flank], 2, 3)
        if base is None:
            continue
        level = N.evaluate(base, x)
        ratio = np.where(level > 1e-9, row / np.where(level > 1e-9, level, 1), 1.0)
        k = int(inner[ratio[inner].argmin()])
        if 0 < k < len(x) - 1 and ratio[k - 1] - 2 * ratio[k] + ratio[k + 1] > 1e-12:
            out[i] = x[k] + (x[1] - x[0]) * N.vertex(ratio[k - 1], ratio[k], ratio[k + 1], 0.8)
    return out


def nearest(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.abs(values[None] - at[:, None]).min(1)


def anchors(mean: np.ndarray, offset: np.ndarray, core_sigma: float) -> np.ndarray:
    """Places of minima 1.5 % deep or more beside the line's own core."""
    ratio = mean / np.maximum(N.loess(mean, 25, 3), 1e-9)
    k = np.arange(2, len(mean) - 2)
    low = (ratio[k] < 0.985) & (np.abs(offset[k]) >= max(4 * core_sigma, 8))
    for d in (-2, -1, 1, 2):
        low &= ratio[k] < ratio[k + d]
    return k[low]


def best_dispersion(places: np.ndarray) -> float:
    """Angstrom a pixel that brings the anchors closest to known lines."""
    tries = np.arange(0.03, 0.25 + 1e-9, 0.0005)
    known = np.concatenate([WATER, SOLAR])
    return float(tries[np.array([nearest(known, places * d).sum() for d in tries]).argmin()])


def flexure(spectra: np.ndarray, offset: np.ndarray, core_sigma: float) -> Flexure | None:
    """Drift of each frame from frame spectra (t, m) on offsets from the line."""
    t, m = spectra.shape
    light = spectra.sum(1)
    good = np.flatnonzero(light > 0.3 * light.max(initial=0))
    if t < 100 or m < 30 or len(good) < 100:
        return None
    at = anchors(spectra[good].mean(0), offset, core_sigma)
    if not len(at):
        return None
    d = best_dispersion(offset[at])
    water = nearest(WATER, offset[at] * d)
    at = at[(water < 0.15) & (water < nearest(SOLAR, offset[at] * d))]
    moved = []
    for k in at.tolist():
        lo, hi = max(1, k - 7), min(m - 1, k + 8)
        if hi - lo <= 9:
            continue
        s = np.full(t, np.nan)
        s[good] = dip_places(offset[lo:hi], spectra[good, lo:hi], float(offset[k])) - offset[k]
        if np.isfinite(s).sum() >= 50:
            moved.append(s - np.nanmedian(s))
    if not moved:
        return None
    with np.errstate(all="ignore"):
        middle = np.nanmedian(np.array(moved), 0)
    series = N.smooth(N.nearest_fill(middle), 2)
    series = series - series.mean()
    return Flexure(np.where(np.abs(series) <= 0.005, 0.0, series), len(moved), tuple(offset[at].tolist()), d)


def slit_velocity(mean: np.ndarray, centre: np.ndarray, first: int, last: int, offsets: tuple[float, ...]) -> np.ndarray | None:
    """Line shift along the slit that the fitted curvature has swallowed: the
    slope of the line's path against the water lines', averaged over them."""
    h, w = mean.shape
    margin = int(np.clip((last - first) // 20, 5, 40))
    rows = np.arange(first + margin, last - margin)
    if len(rows) <= 60 or not offsets:
        return None
    slopes = []
    for off in offsets:
        ys, xs = [], []
        for y in rows.tolist():
            x0 = centre[y] + off
            lo, hi = max(int(x0 - 7), 1), min(int(x0 + 8), w - 2)
            if hi - lo > 9:
                p = dip_places(np.arange(lo, hi, dtype=float), mean[y, lo:hi][None], x0)[0]
                if np.isfinite(p):
                    ys.append(y)
                    xs.append(p)
        if len(ys) < 60:
            continue
        curve = N.fit_robust(np.array(ys, float), np.array(xs), 2, 4)
        line = N.fit_robust(rows.astype(float), centre[rows] - N.evaluate(curve, rows.astype(float)) + off, 1, 3)
        slopes.append(line[1])
    return float(np.mean(slopes)) * (np.arange(h) - rows.mean()) if slopes else None


def wing_difference(blue: np.ndarray, red: np.ndarray) -> np.ndarray:
    """(red - blue) / (red + blue) where both wings are lit, else 0."""
    total = red + blue
    lit = total > 0.5 * N.percentile(blue, 80)
    return np.where(lit, (red - blue) / np.where(lit, total, 1), 0.0)
