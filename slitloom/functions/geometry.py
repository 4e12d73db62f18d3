"""Limb points, ellipse fits, warps and disks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import numeric as N


def limb_points(img: np.ndarray, reach: int = 6) -> np.ndarray:
    """(n, 3) x, y, weight: the gradient centroids at both ends of each row's
    disk, where the step is a fifth of the median step or more."""
    top = 1.05 * N.percentile(img, 95)
    s = N.smooth(np.minimum(img, top), 3, 1)
    g = np.gradient(s, axis=1)
    level = 0.35 * N.percentile(s, 80)
    out = []
    for y in range(img.shape[0]):
        lit = np.flatnonzero(s[y] > level)
        if len(lit) < 20:
            continue
        for edge, sign in ((lit[0], 1.0), (lit[-1], -1.0)):
            lo, hi = max(1, edge - 3 * reach), min(img.shape[1] - 1, edge + 3 * reach + 1)
            k = lo + int((sign * g[y, lo:hi]).argmax())
            lo, hi = k - reach, k + reach + 1
            if lo < 1 or hi > img.shape[1] - 1:
                continue
            w = np.maximum(sign * g[y, lo:hi], 0)
            if w.sum() > 0:
                out.append(((w * np.arange(lo, hi)).sum() / w.sum(), y, w.sum()))
    pts = np.array(out).reshape(-1, 3)
    return pts[pts[:, 2] > 0.2 * np.median(pts[:, 2])] if len(pts) else pts


@dataclass(frozen=True)
class Ellipse:
    """u = sx * (X + shear * Y), v = Y takes a circle of `radius` to the ellipse about (xc, yc)."""

    xc: float
    yc: float
    sx: float
    shear: float
    radius: float
    conic: tuple[float, ...]


def from_conic(c: np.ndarray) -> Ellipse | None:
    a, b, cc, d, e, f = (float(k) for k in c)
    det = 4 * a * cc - b * b
    if det <= 0:
        return None
    xc, yc = (b * e - 2 * cc * d) / det, (b * d - 2 * a * e) / det
    rest = -(a * xc * xc + b * xc * yc + cc * yc * yc + d * xc + e * yc + f)
    if abs(rest) < 1e-15:
        return None
    an, bn, cn = a / rest, b / rest, cc / rest
    t = cn - bn * bn / (4 * an)
    if an <= 0 or t <= 0:
        return None
    sx = np.sqrt(t / an)
    return Ellipse(xc, yc, float(sx), float(-bn / (2 * an * sx)), float(np.sqrt(1 / (an * sx * sx))), tuple(c.tolist()))


def fit_conic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray | None:
    """Direct least-squares ellipse (the numerically stable partition of the scatter)."""
    mx, my, s = x.mean(), y.mean(), max(x.std(), y.std(), 1e-9)
    u, v = (x - mx) / s, (y - my) / s
    w = np.ones_like(u) if w is None else w
    d1, d2 = np.stack([u * u, u * v, v * v], 1), np.stack([u, v, np.ones_like(u)], 1)
    s1, s2, s3 = d1.T @ (w[:, None] * d1), d1.T @ (w[:, None] * d2), d2.T @ (w[:, None] * d2)
    try:
        t = -np.linalg.solve(s3, s2.T)
        m = s1 + s2 @ t
        m = np.array([m[2] / 2, -m[1], m[0] / 2])
        val, vec = np.linalg.eig(m)
    except np.linalg.LinAlgError:
        return None
    vec = vec.real
    ok = np.flatnonzero(4 * vec[0] * vec[2] - vec[1] ** 2 > 0)
    if not len(ok):
        return None
    a1 = vec[:, ok[0]]
    a, b, c, d, e, f = np.concatenate([a1, t @ a1])
    return np.array([a, b, c, d * s - 2 * a * mx - b * my, e * s - 2 * c * my - b * mx, a * mx * mx + b * mx * my + c * my * my - (d * mx + e * my) * s + f * s * s])


def sampson(c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b, cc, d, e, f = c
    value = a * x * x + b * x * y + cc * y * y + d * x + e * y + f
    return np.abs(value) / np.maximum(np.hypot(2 * a * x + b * y + d, b * x + 2 * cc * y + e), 1e-12)


def fit_ellipse(points: np.ndarray, seed: int = 1234, trials: int = 600) -> Ellipse | None:
    """RANSAC over eight bands of y, then four reweighted direct fits."""
    if len(points) < 20:
        return None
    x, y = points[:, 0], points[:, 1]
    extent = max(np.ptp(x), np.ptp(y))
    tol = float(np.clip(0.0015 * extent, 1.2, 3.0))
    bands = np.array_split(np.argsort(y, kind="stable"), 8)
    rng = np.random.default_rng(seed)
    best, votes = None, -1
    for _ in range(trials):
        pick = np.array([b[rng.integers(len(b))] for b in bands if len(b)])
        c = fit_conic(x[pick], y[pick])
        e = from_conic(c) if c is not None else None
        if e is None or not 0.2 * extent < e.radius < 2 * extent or not 0.2 < e.sx < 5 or abs(e.shear) > 1:
            continue
        n = int((sampson(c, x, y) < tol).sum())
        if n > votes:
            best, votes = c, n
    if best is None:
        return None
    for _ in range(4):
        r = sampson(best, x, y)
        near = r < 3 * tol
        u = r / (N.TUKEY * max(1.4826 * N.median(r[near]), 0.05))
        c = fit_conic(x, y, np.where((np.abs(u) < 1) & near, (1 - u * u) ** 2, 0) + 1e-12)
        if c is None or from_conic(c) is None:
            break
        best = c
    return from_conic(best)


def canvas(e: Ellipse, margin: float = 0.15) -> int:
    return int(np.ceil(2 * (e.radius + max(margin * e.radius, 40))))


def warp(img: np.ndarray, e: Ellipse, size: int | None = None, rotation_deg: float = 0.0, flip_x: bool = False, flip_y: bool = False, signed: bool = False, rows: tuple[int, int] | None = None) -> np.ndarray:
    """The round disk: flips, rotation and shear undone in one Lanczos pass."""
    size = size or canvas(e)
    lo, hi = rows or (0, size)
    y, x = np.mgrid[lo:hi, :size].astype(float)
    u, v = x - (size - 1) / 2, y - (size - 1) / 2
    u, v = (-u if flip_x else u), (-v if flip_y else v)
    a = np.radians(rotation_deg)
    u, v = u * np.cos(a) - v * np.sin(a), u * np.sin(a) + v * np.cos(a)
    out = N.lanczos_sample(img, e.sx * (u + e.shear * v) + e.xc, v + e.yc, e.sx)
    return (out if signed else np.maximum(out, 0)).astype(np.float32)


def slit_angle(e: Ellipse, rotation_deg: float = 0.0, flip_x: bool = False, flip_y: bool = False) -> float:
    """Direction of the slit in the output, 0 to 180 degrees from +x."""
    u, v = -e.shear, 1.0
    a = np.radians(-rotation_deg)
    u, v = u * np.cos(a) - v * np.sin(a), u * np.sin(a) + v * np.cos(a)
    return float(np.degrees(np.arctan2(-v if flip_y else v, -u if flip_x else u)) % 180)


@dataclass(frozen=True)
class Disk:
    xc: float
    yc: float
    r: float


def coarse_disk(img: np.ndarray) -> Disk | None:
    lit = img > 0.35 * N.percentile(img, 80)
    n = int(lit.sum())
    if n < 500:
        return None
    y, x = np.nonzero(lit)
    return Disk(float(x.mean()), float(y.mean()), float(np.sqrt(n / np.pi)))


def fit_disk(img: np.ndarray) -> Disk | None:
    """Disk from the steepest falls along 256 rays, centred by a low Fourier series."""
    d = coarse_disk(img)
    if d is None:
        return None
    a = np.linspace(0, 2 * np.pi, 256, endpoint=False)
    for _ in range(3):
        r = np.linspace(0.85, 1.15, 90) * d.r
        p = N.bilinear(img, d.xc + r * np.cos(a)[:, None], d.yc + r * np.sin(a)[:, None])
        fall = np.maximum(-np.gradient(N.smooth(p, 1.5, 1), axis=1), 0)
        k = fall.argmax(1)
        edge = np.array([(fall[i, max(0, j - 6) : j + 7] * r[max(0, j - 6) : j + 7]).sum() / max(fall[i, max(0, j - 6) : j + 7].sum(), 1e-9) for i, j in enumerate(k)])
        basis = np.stack([np.ones_like(a), np.cos(a), np.sin(a), np.cos(2 * a), np.sin(2 * a)], 1)
        w = np.ones(256)
        for _ in range(4):
            c = np.linalg.lstsq(basis * w[:, None], edge * w, rcond=None)[0]
            rest = edge - basis @ c
            u = rest / (N.TUKEY * N.mad(rest, 1e-3))
            w = np.sqrt(np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0) + 1e-9)
        d = Disk(d.xc + float(c[1]), d.yc + float(c[2]), float(c[0]))
    return d


def limb_points_plain(img: np.ndarray) -> np.ndarray:
    """The plain form: each row's steepest rise and fall after a wide blur;
    points off a sixth-degree curve by over 3 deviations move onto it."""
    s = N.smooth(img, 11, 1)
    g = np.gradient(s, axis=1)
    level = 0.35 * N.percentile(s, 80)
    rows = np.flatnonzero((s > level).sum(1) > 20)
    if len(rows) < 20:
        return np.zeros((0, 3))
    out = []
    for x in (g[rows].argmax(1).astype(float), g[rows].argmin(1).astype(float)):
        c = N.fit_robust(rows.astype(float), x, 6, 3)
        if c is not None:
            fit = N.evaluate(c, rows.astype(float))
            r = x - fit
            x = np.where(np.abs(r) > 3 * max(N.mad(r), 0.5), fit, x)
        out.append(np.stack([x, rows, np.ones(len(rows))], 1))
    return np.concatenate(out)


def warp_plain(img: np.ndarray, e: Ellipse, size: int | None = None) -> np.ndarray:
    """The plain form: shear, then scale, then crop, by bilinear passes with
    counts rounded in between."""
    counts = lambda v: np.round(np.clip(v, 0, 65535))
    h, w = img.shape
    y, x = np.mgrid[:h, :w].astype(float)
    sheared = counts(N.bilinear(img, x + e.sx * e.shear * (y - e.yc), y))
    n = max(int(round(w / e.sx)), 1)
    y, x = np.mgrid[:h, :n].astype(float)
    round_ = counts(N.bilinear(sheared, x * e.sx, y))
    size = size or canvas(e)
    y, x = np.mgrid[:size, :size]
    gx, gy = x + int(round(e.xc / e.sx - (size - 1) / 2)), y + int(round(e.yc - (size - 1) / 2))
    inside = (gx >= 0) & (gx < n) & (gy >= 0) & (gy < h)
    return np.where(inside, round_[np.clip(gy, 0, h - 1), np.clip(gx, 0, n - 1)], 0).astype(np.float32)


def limb_x_offsets(points: np.ndarray, e: Ellipse, width: int, reach: int = 5) -> np.ndarray:
    """Scan-direction offset of each column from how far its limb points lie
    off the ellipse; two halves of the slit agree or the estimate shrinks to 0."""
    a, b, c, d, f, g = e.conic
    x, y = points[:, 0], points[:, 1]
    qa, qb, qc = a, b * y + d, c * y * y + f * y + g
    disc = qb * qb - 4 * qa * qc
    ok = disc > 0
    root = np.sqrt(np.where(ok, disc, 0))
    near = np.where(np.abs((-qb + root) / (2 * qa) - x) < np.abs((-qb - root) / (2 * qa) - x), (-qb + root) / (2 * qa), (-qb - root) / (2 * qa))
    off, col = (x - near)[ok], np.round(x[ok]).astype(int)
    halves = []
    for half in (y[ok] < e.yc, y[ok] >= e.yc):
        v = np.full(width, np.nan)
        for k in np.unique(col[half]):
            if 0 <= k < width:
                v[k] = np.median(off[half & (col == k)])
        halves.append(v)
    both = np.isfinite(halves[0]) & np.isfinite(halves[1])
    if both.sum() <= 40:
        return np.zeros(width)
    p, q = halves[0][both], halves[1][both]
    signal = ((p + q) / 2).var()
    shrink = float(np.clip(1 - ((p - q) ** 2).mean() / 4 / signal, 0, 1)) if signal > 0 else 0.0
    if shrink < 0.05:
        return np.zeros(width)
    with np.errstate(all="ignore"):
        mean = np.nanmean(np.array(halves), 0)
    at = np.flatnonzero(np.isfinite(mean))
    place = np.clip(np.searchsorted(at, np.arange(width)), 0, len(at) - 1)
    far = np.minimum(np.abs(at[place] - np.arange(width)), np.abs(at[np.maximum(place - 1, 0)] - np.arange(width))) > reach
    out = N.smooth(np.where(far, 0.0, N.nearest_fill(mean)), 2) * shrink
    out = np.clip(out, -3, 3)
    return np.where(np.abs(out) <= 0.08, 0.0, out)
