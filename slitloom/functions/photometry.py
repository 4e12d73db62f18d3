"""Gains of columns and rows, bursts, temporal means and column demixing."""

from __future__ import annotations

import numpy as np

from . import numeric as N


def disk_threshold(img: np.ndarray) -> float:
    return 0.35 * N.percentile(img, 80)


def column_flux(img: np.ndarray, least: int = 30) -> np.ndarray:
    """Median of each column's lit pixels; NaN with `least` or fewer."""
    lit = img > disk_threshold(img)
    return np.array([np.median(img[lit[:, x], x]) if lit[:, x].sum() > least else np.nan for x in range(img.shape[1])])


def transparency_gains(flux: np.ndarray, deadband: float = 0.012) -> np.ndarray:
    """Gain of each column: its flux over a robust trend of 121 columns, within
    .7 to 1.06, drawn to 1 by the deadband.  It tapers where the local flux is
    under .55 of the trend's maximum, to nothing at .35; columns without a
    measurement have 1, and all have with fewer than 20 measured."""
    good = np.isfinite(flux)
    if good.sum() < 20:
        return np.ones(len(flux))
    filled = N.nearest_fill(flux)
    trend = N.loess(filled, 121)
    local = N.robust_trend(filled, 4, 3.0)
    taper = np.clip((local / max(trend.max(), 1e-9) - 0.35) / 0.2, 0, 1)
    raw = np.clip(filled / np.where(trend > 1e-9, trend, np.inf), 0.7, 1.06)
    return np.where(good & (trend > 1e-9), 1 + N.soft_deadband(taper * (raw - 1), deadband), 1.0)


def divide_columns(img: np.ndarray, gain: np.ndarray) -> np.ndarray:
    return img / np.where(np.abs(gain - 1) > 1e-4, gain, 1.0)[None]


def row_gains(img: np.ndarray, window: int, deadband: float = 0.004) -> np.ndarray | None:
    """Gain of each row: median of its lit pixels over a robust trend, within .8
    to 1.25, drawn to 1 by the deadband.  Rows of fewer than 41 lit pixels or of
    a chord under .45 of the longest have 1; the others taper to 1 over the
    window's rows (12 at least) at both ends of the measured ones.  None with
    fewer than 40 measured rows."""
    lit = img > disk_threshold(img)
    chord = lit.sum(1)
    good = (chord > 40) & (chord >= int(0.45 * chord.max()))
    if good.sum() < 40:
        return None
    flux = np.array([np.median(img[y, lit[y]]) if good[y] else np.nan for y in range(img.shape[0])])
    filled = N.nearest_fill(flux)
    trend = N.loess(filled, window | 1)
    at, y = np.flatnonzero(good), np.arange(len(flux))
    edge = np.clip(np.minimum(y - at[0], at[-1] - y) / max(window, 12.0), 0, 1)
    raw = np.clip(filled / np.where(trend > 1e-6, trend, np.inf), 0.8, 1.25)
    return np.where(good & (trend > 1e-6), 1 + N.soft_deadband(edge * (raw - 1), deadband), 1.0)


def correct_rows(img: np.ndarray, deadband: float = 0.004) -> np.ndarray:
    """Dust stripes at two scales, 17 rows and 61."""
    for window in (17, 61):
        gain = row_gains(img, window, deadband)
        if gain is None:
            return img
        img = img / np.where(np.abs(gain - 1) > 1e-4, gain, 1.0)[:, None]
    return img


def correct_rows_plain(img: np.ndarray) -> np.ndarray:
    """The plain form: Savitzky-Golay trends, and counts rounded in between."""
    for window in (17, 61):
        lit = img > disk_threshold(img)
        flux = np.array([np.median(r[k]) if k.sum() > 40 else np.nan for r, k in zip(img, lit, strict=True)])
        if np.isfinite(flux).sum() < 30:
            return img
        filled = N.nearest_fill(flux)
        img = np.round(np.clip(img * (N.savgol(filled, window) / np.maximum(filled, 1e-9))[:, None], 0, 65535))
    return img


def lagrange(img: np.ndarray, x: int, near: list[int]) -> np.ndarray:
    """Column x as the polynomial through the columns in `near`."""
    out = np.zeros(img.shape[0])
    for i in near:
        w = np.prod([(x - j) / (i - j) for j in near if j != i])
        out += w * img[:, i]
    return out


def column_contrast(img: np.ndarray) -> np.ndarray:
    """Median absolute slope of each column's lit pixels; NaN with fewer than 24."""
    lit = img > 0.20 * N.percentile(img, 80)
    padded = np.pad(img, ((1, 1), (0, 0)), mode="edge")
    slope = np.abs(padded[2:] - padded[:-2]) / 2
    return np.array([np.median(slope[lit[:, x], x]) if lit[:, x].sum() >= 24 else np.nan for x in range(img.shape[1])])


def hysteresis(severity: np.ndarray, measured: np.ndarray, high: float) -> np.ndarray:
    """Seeds above `high`, grown into neighbours above 1 + .6 (high - 1); ends are not grown into."""
    flag = (severity > high) & measured
    ok = (severity > 1 + 0.6 * (high - 1)) & measured
    ok[[0, -1]] = False
    while True:
        grown = flag.copy()
        grown[1:] |= flag[:-1] & ok[1:]
        grown[:-1] |= flag[1:] & ok[:-1]
        if (grown == flag).all():
            return flag
        flag = grown


def repair_bursts(img: np.ndarray, high: float = 1.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image, flags, severity): blurred columns replaced, as far as they are
    blurred, by what sharp neighbours predict; untouched if over a quarter is flagged."""
    w = img.shape[1]
    contrast = column_contrast(img)
    none = np.zeros(w, bool)
    if np.isfinite(contrast).sum() < 100:
        return img, none, np.ones(w)
    filled = N.nearest_fill(contrast)
    severity = N.running_median(filled, 50) / np.maximum(filled, 1e-9)
    flag = hysteresis(severity, np.isfinite(contrast), high)
    predicted: dict[int, np.ndarray] = {}
    for x in np.flatnonzero(flag).tolist():
        near = [k for k in range(x - 1, max(-1, x - 16), -1) if not flag[k]][:2] + [k for k in range(x + 1, min(w, x + 16)) if not flag[k]][:2]
        if len(near) < 3:
            flag[x] = False
            continue
        guess = lagrange(img, x, near)
        sharp = column_contrast(np.stack([guess] * 2, 1))[0]
        if not np.isfinite(sharp) or contrast[x] / max(sharp, 1e-9) >= 1 / (0.75 + 0.25 * high):
            flag[x] = False
        else:
            predicted[x] = guess
    if not flag.any() or flag.sum() > w // 4:
        return img, none, severity
    out = img.copy()
    for x, guess in predicted.items():
        keep = 0.5 * np.clip((high + 0.8 - severity[x]) / 0.8, 0, 1)
        out[:, x] = np.maximum(keep * img[:, x] + (1 - keep) * guess, 0)
    return out, flag, severity


def stride_noise(img: np.ndarray) -> tuple[float, float] | None:
    """(threshold, sigma) from differences of neighbouring columns on a stride; None if too few."""
    thresh = 0.15 * N.percentile(img, 80)
    a, b = img[::3, 8:-1:13], img[::3, 9::13]
    n = min(a.shape[1], b.shape[1])
    d = np.abs(b[:, :n] - a[:, :n])[a[:, :n] > thresh]
    return (thresh, 1.4826 / np.sqrt(2) * float(np.median(d))) if d.size >= 1000 else None


def temporal_nlm(img: np.ndarray, thresh: float, sigma: float, radius: int = 3, h: float = 1.8, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Non-local mean over frames +-radius with vertical patches of 7, of columns lo..hi."""
    height, width = img.shape
    hi = width if hi is None else hi
    rows = np.clip(np.arange(height)[:, None] + np.arange(-3, 4), 0, height - 1)
    total, weight = np.zeros((height, hi - lo)), np.zeros((height, hi - lo))
    own = np.arange(lo, hi)
    for o in range(-radius, radius + 1):
        x = own + o
        ok = (x >= 0) & (x < width)
        other = img[:, np.clip(x, 0, width - 1)]
        d2 = ((img[:, lo:hi] - other)[rows] ** 2).mean(1)
        k = np.exp(-np.maximum(d2 - 2 * sigma**2, 0) / (h * sigma) ** 2) * ok
        total += k * other
        weight += k
    out = total / np.maximum(weight, 1e-12)
    return np.where(img[:, lo:hi] > thresh, out, img[:, lo:hi])


_RIDGE = np.diag([2.0, 12.0, 12.0, 20.0, 20.0, 4.0])
_LIMIT = np.array([0.10, 0.40, 0.40, 0.20, 0.20, 0.10])


def demix_columns(img: np.ndarray, strength: float = 1.0, halo: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(image, states): per-column gain, shifts, blurs and offset against what
    neighbours 1 to 8 columns away predict; unchanged without enough evidence."""
    h, w = img.shape
    strength = float(np.clip(strength, 0, 1))
    states = np.zeros((w, 6))
    if w < 9 or h < 256 or strength == 0:
        return img, states
    level = max(N.percentile(img, 80), 1.0)
    thresh = 0.18 * level
    at = lambda o: np.pad(img, ((0, 0), (halo, halo)), mode="edge")[:, halo + o : halo + o + w]
    pred = 0.35 * (2 / 3 * (at(1) + at(-1)) - 1 / 6 * (at(2) + at(-2))) + 0.65 * (2 / 3 * (at(4) + at(-4)) - 1 / 6 * (at(8) + at(-8)))
    up, down = np.pad(pred, ((1, 1), (0, 0)), mode="edge")[:-2], np.pad(pred, ((1, 1), (0, 0)), mode="edge")[2:]
    left, right = np.pad(pred, ((0, 0), (1, 1)), mode="edge")[:, :-2], np.pad(pred, ((0, 0), (1, 1)), mode="edge")[:, 2:]
    dx, dy, cx, cy = (right - left) / 2, (down - up) / 2, right - 2 * pred + left, down - 2 * pred + up
    bright = (pred > thresh) & (img > 0.25 * thresh)
    features = [np.clip(pred / level, 0, 8)] + [np.clip(f / level, -4, 4) for f in (dx, dy, cx, cy)]
    features = np.stack([f * bright for f in features] + [np.ones_like(pred)], -1)
    rest = (img - pred) / level
    seen = (pred > 0.02 * thresh) | (img > 0.02 * thresh)
    limb = np.clip(np.abs(dy) / level, 0, 1)
    base = seen * np.where(bright, 1 + 2 * limb, 0.20)
    weight = base.copy()
    c = np.zeros((w, 6))
    for _ in range(3):
        r = rest - np.einsum("hwk,wk->hw", features, c)
        u = r / (0.12 + 0.25 * limb)
        weight = base * np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
        a = np.einsum("hw,hwi,hwj->wij", weight, features, features) + _RIDGE
        b = np.einsum("hw,hwi,hw->wi", weight, features, rest)
        c = np.linalg.solve(a, b[..., None])[..., 0]
    c = np.clip(c, -_LIMIT, _LIMIT)
    c[(weight > 0.05).sum(0) < 128] = 0
    c[:halo] = c[-halo:] = 0
    need = max(w // 120, 12)
    limit = np.array([0.003, 0.020, 0.020, 0.025, 0.025, 0.002]) / max(strength, 0.25)
    if not ((np.abs(c) > limit).sum(0) >= need).any():
        return img, states
    v = img - strength * c[:, 5] * level
    v = np.where(pred > 0.35 * thresh, v / np.maximum(1 + strength * c[:, 0], 0.8), v)
    v = v - strength * (c[:, 1] * dx + c[:, 2] * dy + c[:, 3] * cx + c[:, 4] * cy)
    out = img.copy()
    out[:, halo:-halo] = np.maximum(v, 0)[:, halo:-halo]
    return out, c
