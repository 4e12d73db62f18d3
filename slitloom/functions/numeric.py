"""Numeric kernels: statistics, fits, smoothing and splines on NumPy arrays."""

from __future__ import annotations

import numpy as np

TUKEY = 4.685


def percentile(v: np.ndarray, p: float) -> float:
    """Nearest-rank element at round(p / 100 * (n - 1)), halves up; NaN if empty."""
    v = np.asarray(v).ravel()
    if not v.size:
        return float("nan")
    k = int(np.floor(p / 100.0 * (v.size - 1) + 0.5))
    return float(np.partition(v, k)[k])


def median(v: np.ndarray) -> float:
    v = np.asarray(v).ravel()
    return float(np.median(v)) if v.size else float("nan")


def mad(v: np.ndarray, floor: float = 1e-9) -> float:
    return max(1.4826 * median(np.abs(v - median(v))), floor)


def fit_polynomial(x: np.ndarray, y: np.ndarray, degree: int, weight: np.ndarray | None = None) -> np.ndarray | None:
    """Ascending coefficients of a weighted least-squares polynomial, solved on
    x scaled to -1..1; None with fewer usable points than coefficients."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones_like(x) if weight is None else np.asarray(weight, float)
    ok = w > 0
    if ok.sum() <= degree:
        return None
    mid, half = (x[ok].max() + x[ok].min()) / 2, max((x[ok].max() - x[ok].min()) / 2, 1e-12)
    root = np.sqrt(w[ok])
    basis = np.vander((x[ok] - mid) / half, degree + 1, increasing=True)
    scaled = np.linalg.lstsq(basis * root[:, None], y[ok] * root, rcond=None)[0]
    out = np.polynomial.Polynomial(scaled, domain=[mid - half, mid + half], window=[-1, 1])
    return np.pad(out.convert().coef, (0, degree + 1))[: degree + 1]


def evaluate(c: np.ndarray, x: np.ndarray | float) -> np.ndarray:
    return np.polynomial.polynomial.polyval(x, c)


def fit_robust(x: np.ndarray, y: np.ndarray, degree: int, rounds: int = 4, weight: np.ndarray | None = None) -> np.ndarray | None:
    """fit_polynomial reweighted by Tukey's biweight of the residuals."""
    base = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    c = fit_polynomial(x, y, degree, base)
    for _ in range(rounds):
        if c is None:
            return None
        r = np.asarray(y, float) - evaluate(c, np.asarray(x, float))
        u = r / (TUKEY * max(1.4826 * median(np.abs(r)), 1e-9))
        new = fit_polynomial(x, y, degree, base * np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0))
        if new is None:
            return c
        c = new
    return c


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Index -i for i below 0 and 2 (n - 1) - i beyond the end, then clamped."""
    i = np.where(i < 0, -i, i)
    i = np.where(i > n - 1, 2 * (n - 1) - i, i)
    return np.clip(i, 0, n - 1)


def smooth(v: np.ndarray, sigma: float, axis: int = -1) -> np.ndarray:
    """Gaussian of radius ceil(3 sigma), borders mirrored."""
    if sigma <= 0 or v.shape[axis] == 0:
        return np.array(v, float)
    radius = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    n = v.shape[axis]
    out = np.zeros(v.shape, float)
    base = np.arange(n)
    for o, w in zip(range(-radius, radius + 1), k, strict=True):
        out += w * np.take(v, mirrored(base + o, n), axis=axis)
    return out


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    return smooth(smooth(img, sigma, 1), sigma, 0)


def running_median(v: np.ndarray, half: int) -> np.ndarray:
    """Median of up to `half` values on each side; the window shrinks at the ends."""
    v = np.asarray(v, float)
    padded = np.pad(v, half, constant_values=np.nan)
    with np.errstate(all="ignore"):
        return np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)


def robust_trend(v: np.ndarray, half: int, sigma: float) -> np.ndarray:
    return smooth(running_median(v, half), sigma)


def loess(v: np.ndarray, window: int, rounds: int = 3) -> np.ndarray:
    """Local quadratic with tricube weights, at each place, reweighted by Tukey's
    biweight with the median residual of the place's own window.  All places
    are solved together, as 3x3 systems; one that has no fit keeps its value."""
    v = np.asarray(v, float)
    n, half = len(v), max(window // 2, 3)
    offset = np.arange(-half, half + 1)
    at = np.arange(n)[:, None] + offset
    inside = (at >= 0) & (at < n)
    y = v[np.clip(at, 0, n - 1)]
    base = np.maximum((1 - (np.abs(offset) / (half + 1)) ** 3) ** 3, 1e-6) * inside
    basis = np.stack([np.ones_like(offset), offset / half, (offset / half) ** 2], 1).astype(float)
    w, fitted = base, np.ones(n, bool)
    for k in range(rounds + 1):
        fitted &= (w > 0).sum(1) >= 3
        a = np.einsum("nk,ki,kj->nij", w, basis, basis) + np.eye(3) * 1e-12
        c = np.linalg.solve(a, np.einsum("nk,ki,nk->ni", w, basis, y)[..., None])[..., 0]
        if k < rounds:
            rest = y - c @ basis.T
            with np.errstate(all="ignore"):
                spread = np.nanmedian(np.where(inside, np.abs(rest), np.nan), axis=1)
            u = rest / (TUKEY * 1.4826 * np.maximum(spread, 1e-9))[:, None]
            w = base * np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
    return np.where(fitted, c[:, 0], v)


def soft_deadband(x: np.ndarray, width: float) -> np.ndarray:
    """x drawn towards 0 by width, and 0 within it."""
    return np.sign(x) * np.maximum(np.abs(x) - width, 0)


def savgol(v: np.ndarray, window: int) -> np.ndarray:
    """Unweighted moving quadratic at its centre, windows cut at the ends."""
    v = np.asarray(v, float)
    half = max(window // 2, 2)
    out = np.empty(len(v))
    for i in range(len(v)):
        lo, hi = max(0, i - half), min(len(v), i + half + 1)
        c = fit_polynomial(np.arange(lo, hi) - i, v[lo:hi], min(2, hi - lo - 1))
        out[i] = c[0]
    return out


def nearest_fill(v: np.ndarray) -> np.ndarray:
    """NaN takes the nearest finite value, the lower place of two as near."""
    v = np.asarray(v, float)
    good = np.flatnonzero(np.isfinite(v))
    if not len(good):
        return v.copy()
    at = np.arange(len(v))
    right = np.searchsorted(good, at)
    lo, hi = good[np.clip(right - 1, 0, len(good) - 1)], good[np.clip(right, 0, len(good) - 1)]
    take_low = (at - lo <= hi - at) & (lo <= at) | (hi < at)
    return v[np.where(take_low, lo, hi)]


_POLE = np.sqrt(3.0) - 2.0


def spline_coefficients(v: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the last axis, mirrored ends."""
    c = np.array(v, float) * 6.0
    n = c.shape[-1]
    if n < 2:
        return np.array(v, float)
    terms = min(n, 30)
    c[..., 0] = (c[..., :terms] * _POLE ** np.arange(terms)).sum(-1)
    for i in range(1, n):
        c[..., i] += _POLE * c[..., i - 1]
    c[..., n - 1] = _POLE / (_POLE * _POLE - 1) * (_POLE * c[..., n - 2] + c[..., n - 1])
    for i in range(n - 2, -1, -1):
        c[..., i] = _POLE * (c[..., i + 1] - c[..., i])
    return c


def spline_at(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of a spline at x; c (..., n) and x (..., m) share leading axes."""
    n = c.shape[-1]
    x = np.asarray(x, float)
    base = np.floor(x).astype(int)
    t = x - base
    weights = ((1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6)
    out = np.zeros(x.shape)
    for k, w in enumerate(weights):
        out += w * np.take_along_axis(np.broadcast_to(c, x.shape[:-1] + (n,)), mirrored(base + k - 1, n), -1)
    return out


def lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def gaussian_dip(x: np.ndarray, y: np.ndarray, start: tuple[float, float, float, float], rounds: int = 25) -> tuple[float, float, float, float] | None:
    """(continuum, depth, centre, sigma) of y = C - D exp(-(x - m)^2 / 2 s^2), by
    damped Gauss-Newton steps; None if a step cannot be solved."""
    c, d, m, s = start
    for _ in range(rounds):
        z = (x - m) / s
        e = np.exp(-0.5 * z * z)
        r = y - (c - d * e)
        j = np.stack([np.ones_like(x), -e, -d * e * z / s, -d * e * z * z / s], 1)
        a = j.T @ j
        a[np.diag_indices(4)] *= 1 + 1e-6
        try:
            step = np.linalg.solve(a + np.eye(4) * 1e-12, j.T @ r)
        except np.linalg.LinAlgError:
            return None
        c, d = c + step[0], d + step[1]
        m, s = m + np.clip(step[2], -2, 2), float(np.clip(s + np.clip(step[3], -2, 2), 0.3, 50))
        if np.abs(step[2:]).max() < 1e-7:
            break
    return float(c), float(d), float(m), float(s)


def principal(rows: np.ndarray, k: int, rounds: int = 60) -> np.ndarray:
    """Leading k directions of the scatter of rows about their mean, by power
    iteration and deflation; signs are free."""
    x = rows - rows.mean(0)
    scatter = x.T @ x
    n = scatter.shape[0]
    out = []
    for i in range(min(k, n)):
        v = 1.0 + 0.1 * np.cos(np.arange(n) * (i + 1.0))
        for _ in range(rounds):
            v = scatter @ v
            norm = np.linalg.norm(v)
            if norm < 1e-12:
                break
            v /= norm
        scatter = scatter - (v @ scatter @ v) * np.outer(v, v)
        out.append(v)
    return np.array(out)


def ncc(a: np.ndarray, b: np.ndarray, least: int = 32) -> float:
    """Pearson correlation; minus infinity for too few or constant values."""
    if a.size < least:
        return -np.inf
    da, db = a - a.mean(), b - b.mean()
    va, vb = (da * da).sum(), (db * db).sum()
    return float((da * db).sum() / np.sqrt(va * vb)) if va > 1e-12 and vb > 1e-12 else -np.inf


def vertex(left: float, mid: float, right: float, limit: float) -> float:
    curve = left - 2 * mid + right
    return 0.0 if abs(curve) < 1e-12 else float(np.clip(0.5 * (left - right) / curve, -limit, limit))


def smoothstep(v: np.ndarray, low: float, high: float) -> np.ndarray:
    t = np.clip((v - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Samples at (x, y); clamped at the border, or `outside` beyond it."""
    h, w = img.shape
    cx, cy = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(cx.astype(int), max(w - 2, 0)), np.minimum(cy.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = cx - x0, cy - y0
    out = (img[y0, x0] * (1 - tx) + img[y0, x1] * tx) * (1 - ty) + (img[y1, x0] * (1 - tx) + img[y1, x1] * tx) * ty
    return out if outside is None else np.where((x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1), out, outside)


def lanczos_sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, widen: float = 1.0) -> np.ndarray:
    """Lanczos-3 with the x support widened, weights renormalised, border clamped."""
    h, w = img.shape
    widen = max(widen, 1.0)
    rx = int(np.ceil(3 * widen))
    bx, by = np.floor(x).astype(int), np.floor(y).astype(int)
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    wy = [lanczos3(y - (by + j)) for j in range(-2, 4)]
    for i in range(-rx + 1, rx + 1):
        wx = lanczos3((x - (bx + i)) / widen)
        col = np.clip(bx + i, 0, w - 1)
        for j, v in zip(range(-2, 4), wy, strict=True):
            k = wx * v
            total += k * img[np.clip(by + j, 0, h - 1), col]
            weight += k
    return total / np.where(np.abs(weight) < 1e-9, 1.0, weight)
