"""Slit motion along the columns and scan position along the rows."""

from __future__ import annotations

import numpy as np

from . import numeric as N


def column_slope(img: np.ndarray) -> np.ndarray:
    """Central difference along y smoothed by [1, 2, 1] / 4; 0 at the ends."""
    d = np.zeros(img.shape)
    d[1:-1] = (img[2:] - img[:-2]) / 2
    out = np.zeros(img.shape)
    out[1:-1] = 0.25 * d[:-2] + 0.5 * d[1:-1] + 0.25 * d[2:]
    return out


def shift_columns(img: np.ndarray, shift: np.ndarray, deadband: float = 0.04) -> np.ndarray:
    """Column x resampled at y + shift[x] by cubic splines; tiny shifts are left."""
    out = np.array(img, float)
    moved = np.flatnonzero(np.abs(shift) > deadband)
    if len(moved):
        c = N.spline_coefficients(np.ascontiguousarray(img.T[moved], float))
        y = np.arange(img.shape[0])
        out[:, moved] = N.spline_at(c, y + shift[moved, None]).T
    return out


def shift_along_x(img: np.ndarray, delta: np.ndarray, deadband: float = 0.04) -> np.ndarray:
    """Rows resampled at x - delta[x]."""
    if np.abs(delta).max(initial=0) <= deadband:
        return np.array(img, float)
    c = N.spline_coefficients(np.asarray(img, float))
    at = np.arange(img.shape[1]) - np.where(np.abs(delta) > deadband, delta, 0)
    return N.spline_at(c, np.broadcast_to(at, img.shape))


def lit_spans(img: np.ndarray, share: float = 0.25, p: float = 75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chord, first, last) of the pixels of each column above share * percentile."""
    lit = img > share * N.percentile(img, p)
    chord = lit.sum(0)
    return chord, np.where(chord > 0, lit.argmax(0), 0), np.where(chord > 0, img.shape[0] - 1 - lit[::-1].argmax(0), -1)


def register(a: np.ndarray, b: np.ndarray, reach: int = 4) -> tuple[float, float]:
    """(shift, confidence): the lag at which b agrees best with a, to a fraction."""
    n = len(a)
    score = np.array([N.ncc(a[reach : n - reach], b[reach + k : n - reach + k]) for k in range(-reach, reach + 1)])
    k = int(score.argmax())
    if score[k] < 0.4 or not 0 < k < 2 * reach:
        return 0.0, 0.0
    curve = score[k - 1] - 2 * score[k] + score[k + 1]
    d = k - reach + N.vertex(score[k - 1], score[k], score[k + 1], 0.6)
    return d, max(score[k], 0.0) * max(min(-curve, 0.5), 0.02)


LAGS = (1, 2, 4, 8, 16)


def split_half_shrink(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the mean of two half estimates that is signal."""
    signal = ((a + b) / 2).var()
    return float(np.clip(1 - ((a - b) ** 2).mean() / 4 / signal, 0, 1)) if signal > 1e-15 else 0.0


def graph_sweeps(n: int, x1: np.ndarray, x2: np.ndarray, d: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """Series j with j[x2] - j[x1] near d, by damped Jacobi sweeps."""
    j = np.zeros(n)
    den = np.bincount(x1, c, n) + np.bincount(x2, c, n)
    for _ in range(rounds):
        num = np.bincount(x2, c * (j[x1] + d), n) + np.bincount(x1, c * (j[x2] - d), n)
        j = np.where(den > 0, 0.5 * j + 0.5 * num / np.where(den > 0, den, 1), j)
    return j


def jitter(img: np.ndarray, high_pass: int = 41) -> np.ndarray | None:
    """Per-column slit shift from pairs of columns at lags 1 to 16, solved in
    two halves of the slit whose agreement shrinks the mean; None if too few
    columns can be trusted."""
    h, w = img.shape
    chord, lo, hi = lit_spans(img)
    trusted = (chord > 0.55 * chord.max()) & (chord > 60)
    if trusted.sum() <= 50:
        return None
    slope = column_slope(img)
    halves = []
    for half in (0, 1):
        a1, a2, ds, cs = [], [], [], []
        for lag in LAGS:
            for x in np.flatnonzero(trusted[:-lag] & trusted[lag:]).tolist():
                top, bottom = max(lo[x], lo[x + lag]) + 12, min(hi[x], hi[x + lag]) - 12
                mid = (top + bottom) // 2
                s, e = (top, mid) if half == 0 else (mid, bottom)
                if e - s <= 40:
                    continue
                d, c = register(slope[s:e, x], slope[s:e, x + lag])
                if c > 0 and abs(d) <= 2.5:
                    a1.append(x)
                    a2.append(x + lag)
                    ds.append(d)
                    cs.append(c)
        if len(ds) < 20:
            return None
        j = graph_sweeps(w, np.array(a1), np.array(a2), np.array(ds), np.array(cs), 120)
        halves.append(j - N.robust_trend(j, high_pass | 1, high_pass / 2))
    a, b = halves
    out = (a + b) / 2 * split_half_shrink(a[trusted], b[trusted])
    return np.where(trusted, out, 0.0)


def drift(img: np.ndarray) -> np.ndarray | None:
    """Slow slit drift from the midpoints of the lit chords about a straight line."""
    chord, lo, hi = lit_spans(img, 0.35, 75)
    good = (chord >= 0.45 * chord.max()) & (chord >= 60)
    if good.sum() < 80:
        return None
    x = np.flatnonzero(good).astype(float)
    mid = (lo[good] + hi[good]) / 2.0
    c = N.fit_robust(x, mid, 1, 4)
    r = mid - N.evaluate(c, x)
    keep = np.abs(r) < 20
    if keep.sum() < 80:
        return None
    x, r = x[keep], r[keep]
    line = N.loess(r, 41)
    rest = r - line
    ok = np.abs(rest) <= 3 * N.mad(rest, 1e-6)
    soft = N.smooth(np.where(ok, r, line), 1.2)
    n = img.shape[1]
    out = np.interp(np.arange(n), x, soft, left=0, right=0)
    taper = np.clip(np.minimum(np.arange(n) - x[0], x[-1] - np.arange(n)) / 40.0, 0, 1)
    return np.clip(out, -12, 12) * taper


def scan_positions(img: np.ndarray, reach: float = 0.6) -> np.ndarray | None:
    """Per-column offset in scan direction: at each of five trusted columns a lag
    apart, the place between the outer four that predicts the middle one best,
    solved over the scan with a ridge and shrunk by the slit's two halves."""
    h, w = img.shape
    chord, lo, hi = lit_spans(img)
    trusted = (chord > 0.55 * chord.max()) & (chord > 60)
    if trusted.sum() < 100:
        return None
    u = np.linspace(-reach, reach, 7)
    nodes = np.array([-2.0, -1.0, 1.0, 2.0])
    basis = np.stack([np.prod([(u - b) / (a - b) for b in nodes if b != a], axis=0) for a in nodes], 1)
    halves = []
    for half in (0, 1):
        num_x, lag_of, m_of, c_of = [], [], [], []
        for lag in (1, 2, 4):
            xs = np.arange(2 * lag, w - 2 * lag)
            ok = trusted[xs] & trusted[xs - lag] & trusted[xs + lag] & trusted[xs - 2 * lag] & trusted[xs + 2 * lag]
            for x in xs[ok].tolist():
                s, e = max(lo[x - 2 * lag], lo[x + 2 * lag], lo[x]) + 12, min(hi[x - 2 * lag], hi[x + 2 * lag], hi[x]) - 12
                mid = (s + e) // 2
                s, e = (s, mid) if half == 0 else (mid, e)
                if e - s <= 40:
                    continue
                guess = basis @ np.stack([img[s:e, x + int(k) * lag] for k in nodes])
                sse = ((guess - img[s:e, x]) ** 2).sum(1)
                k = int(np.clip(sse.argmin(), 1, 5))
                curve = sse[k - 1] - 2 * sse[k] + sse[k + 1]
                if curve <= 0:
                    continue
                best = u[k] + N.vertex(sse[k - 1], sse[k], sse[k + 1], 0.75) * (u[1] - u[0])
                energy = ((img[s:e, x] - img[s:e, x].mean()) ** 2).sum()
                num_x.append(x)
                lag_of.append(lag)
                m_of.append(best * lag)
                c_of.append(min(curve / max(energy, 1e-9), 4.0) / lag**2)
        if len(num_x) < 100:
            return None
        x, lag, m, c = np.array(num_x), np.array(lag_of), np.array(m_of), np.array(c_of)
        den = np.bincount(x, c, w)
        ridge = 0.05 * c.mean()
        d = np.zeros(w)
        for _ in range(150):
            num = np.bincount(x, c * (m + 0.5 * (d[x - lag] + d[x + lag])), w)
            d = 0.5 * d + 0.5 * num / (den + ridge)
        halves.append(N.smooth(d, 4))
    a, b = halves
    out = (a + b) / 2
    line = N.fit_robust(np.arange(w, dtype=float), out, 1, 4)
    out = N.smooth(out - N.evaluate(line, np.arange(w, dtype=float)), 4)
    return out * split_half_shrink(a[trusted], b[trusted])
