"""Spectral geometry, line fits and profile extraction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import numeric as N


@dataclass(frozen=True)
class LineGeometry:
    """The line's centre at row y is the polynomial `coefficients` in y."""

    coefficients: tuple[float, ...]
    first: int
    last: int
    rms: float
    rows: int

    def centre(self, y: np.ndarray) -> np.ndarray:
        return N.evaluate(np.array(self.coefficients), np.asarray(y, float))


def lit_rows(mean: np.ndarray) -> tuple[int, int]:
    """First and last row of a mean spectrum image above 15 % of its brightest smoothed row."""
    profile = N.smooth(mean.mean(1), 5)
    lit = np.flatnonzero(profile > 0.15 * profile.max())
    return (int(lit[0]), int(lit[-1])) if len(lit) else (0, mean.shape[0] - 1)


def line_geometry(mean: np.ndarray, degree: int = 2) -> LineGeometry | None:
    """The deepest line's path over the rows, each row's centre from a dip fit,
    joined by a robust polynomial; None with fewer than 30 usable rows."""
    first, last = lit_rows(mean)
    h, w = mean.shape
    margin = int(np.clip(h // 20, 5, 40))
    ys, centres, weights = [], [], []
    x = np.arange(w, dtype=float)
    for y in range(first + margin, last - margin + 1):
        row = mean[y].astype(float)
        top = N.percentile(row, 90)
        k = int(N.smooth(row, 1.0).argmin())
        depth = 1 - row[k] / max(top, 1e-9)
        if depth < 0.08:
            continue
        lo, hi = max(0, k - 10), min(w, k + 11)
        fit = N.gaussian_dip(x[lo:hi], row[lo:hi], (float(row[lo:hi].max()), float(row[lo:hi].max() - row[k]), float(k), 2.0))
        if fit is None or abs(fit[2] - k) > 4 or fit[1] <= 0:
            continue
        ys.append(y)
        centres.append(fit[2])
        weights.append(depth)
    if len(ys) < 30:
        return None
    ys, centres = np.array(ys, float), np.array(centres)
    c = N.fit_robust(ys, centres, degree, 4, np.array(weights))
    rest = centres - N.evaluate(c, ys)
    return LineGeometry(tuple(c.tolist()), first, last, float(np.sqrt((rest**2).mean())), len(ys))


def line_geometry_by_minimum(mean: np.ndarray) -> LineGeometry | None:
    """The plain form: each row's darkest pixel, a parabola, two passes of 6 sigma clipping."""
    first, last = lit_rows(mean)
    y = np.arange(first, last + 1, dtype=float)
    x = mean[first : last + 1].argmin(1).astype(float)
    keep = np.ones(len(y), bool)
    c = None
    for _ in range(3):
        c = N.fit_polynomial(y[keep], x[keep], 2)
        if c is None:
            return None
        r = x - N.evaluate(c, y)
        keep = np.abs(r) <= 6 * max(r[keep].std(), 1e-6)
    return LineGeometry(tuple(c.tolist()), first, last, float(r[keep].std()), int(keep.sum()))


def one_line(profile: np.ndarray, at: int, half: int = 10) -> dict | None:
    """Dip fit around a place: centre, sigma, fwhm, depth (share of continuum), continuum."""
    lo, hi = max(0, at - half), min(len(profile), at + half + 1)
    x, y = np.arange(lo, hi, dtype=float), np.asarray(profile[lo:hi], float)
    if len(x) < 7:
        return None
    top = N.percentile(y, 90)
    fit = N.gaussian_dip(x, y, (top, max(top - profile[at], 1e-9), float(at), 2.0))
    if fit is None or not 0.7 <= fit[3] <= 40 or fit[1] <= 0 or fit[0] <= 0 or not lo <= fit[2] <= hi - 1:
        return None
    return {"center": fit[2], "sigma": fit[3], "fwhm": 2.354820045 * fit[3], "depth": fit[1] / fit[0], "continuum": fit[0]}


def all_lines(profile: np.ndarray, least: float = 0.02) -> list[dict]:
    """Fits at every local minimum of the profile; of two closer than 2 px the deeper."""
    p = np.asarray(profile, float)
    s = N.smooth(p, 1.0)
    top = N.percentile(p, 90)
    found, i = [], 3
    while i < len(p) - 3:
        if s[i] <= s[i - 3 : i + 4].min() and top > 0 and (top - s[i]) / top > least:
            fit = one_line(p, i)
            if fit is not None and fit["depth"] > least:
                found.append(fit)
            i += 3
        i += 1
    kept: list[dict] = []
    for fit in sorted(found, key=lambda f: f["center"]):
        if kept and fit["center"] - kept[-1]["center"] < 2:
            if fit["depth"] > kept[-1]["depth"]:
                kept[-1] = fit
        else:
            kept.append(fit)
    return kept


def row_sigmas(mean: np.ndarray, geometry: LineGeometry) -> np.ndarray:
    """Line width of each row: dip fits within .8 to 8, median elsewhere, smoothed by 15 rows."""
    h, w = mean.shape
    out = np.full(h, np.nan)
    for y in range(geometry.first, geometry.last + 1):
        c = float(geometry.centre(y))
        fit = one_line(mean[y], int(np.clip(round(c), 0, w - 1)))
        if fit is not None and 0.8 <= fit["sigma"] < 8:
            out[y] = fit["sigma"]
    middle = np.nanmedian(out) if np.isfinite(out).any() else 2.0
    return N.smooth(np.where(np.isfinite(out), out, middle), 15)


def sample_lines(frames: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of frames (t, y, wavelength) at places (t, y) or (y,), by linear steps."""
    w = frames.shape[-1]
    at = np.clip(np.broadcast_to(at, frames.shape[:2]), 0, w - 1)
    base = np.minimum(at.astype(int), w - 2)
    t = at - base
    left = np.take_along_axis(frames, base[..., None], -1)[..., 0]
    right = np.take_along_axis(frames, base[..., None] + 1, -1)[..., 0]
    return left * (1 - t) + right * t


def continuum_preview(frames: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of three linear samples a pixel apart with binomial weights."""
    return 0.25 * sample_lines(frames, at - 1) + 0.5 * sample_lines(frames, at) + 0.25 * sample_lines(frames, at + 1)


def spline_lines(frames: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic-spline values of frames (t, y, w) at (t, y, m)."""
    return N.spline_at(N.spline_coefficients(frames), at)


def polynomial_kernel(degree: int, half: float = 2.4, taps: int = 6, width: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and weights that give a local polynomial's value at 0."""
    x = np.linspace(-half, half, taps)
    g = np.exp(-0.5 * (x / width) ** 2)
    basis = np.vander(x, degree + 1, increasing=True)
    a = basis.T @ (g[:, None] * basis)
    return x, np.linalg.solve(a, basis.T * g)[0]


def row_noise(profile: np.ndarray) -> float:
    """Relative noise from second differences; 0 for short or dark rows."""
    if len(profile) < 5:
        return 0.0
    level = np.abs(profile).mean()
    return float(np.median(np.abs(np.diff(profile, 2))) / (0.67449 * np.sqrt(6.0)) / level) if level > 0 else 0.0


def adaptive_sample(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Value of each row (n, w) at a place, between a local quadratic and a
    quartic kernel: the noisier the row, the smoother the kernel."""
    x2, w2 = polynomial_kernel(2)
    _, w4 = polynomial_kernel(4)
    values = N.spline_at(N.spline_coefficients(rows), np.asarray(at)[:, None] + x2)
    noise = np.array([row_noise(r) for r in rows])
    mix = N.smoothstep(noise, 0.001, 0.003)
    return (values @ w2) * mix + (values @ w4) * (1 - mix)


def gaussian_window(rows: np.ndarray, at: np.ndarray, sigma: float) -> np.ndarray:
    """Value of each row (n, w) at a place through a Gaussian in half-pixel steps to 2.5 sigma."""
    reach = int(np.ceil(2.5 * sigma / 0.5))
    o = np.arange(-reach, reach + 1) * 0.5
    k = np.exp(-0.5 * (o / max(sigma, 1e-6)) ** 2)
    return N.spline_at(N.spline_coefficients(rows), np.asarray(at)[:, None] + o) @ (k / k.sum())


def fit_frames(frames: np.ndarray, centre: np.ndarray, sigma: np.ndarray, half: int = 8, reach: float = 3.0, gate: float = 0.10) -> dict[str, np.ndarray]:
    """Core intensity, place and depth of the line in every (t, y) spectrum.

    For 21 places over +-reach the best continuum and depth of a dip of the
    row's width follow in closed form; the best place is refined by a parabola.
    Where the dip is shallow the plain sample at the line takes over."""
    t, h, w = frames.shape
    half = max(int(round(half)), 4)
    offset = np.arange(-half, half + 1, dtype=float)
    centre = np.broadcast_to(centre, (t, h))
    window = spline_lines(frames, centre[..., None] + offset)
    shift = np.linspace(-reach, reach, 21)
    e = np.exp(-0.5 * ((offset[None, None] - shift[None, :, None]) / sigma[:, None, None]) ** 2)  # (h, 21, m)
    m = len(offset)
    se, see = e.sum(-1), (e * e).sum(-1)
    sy, syy = window.sum(-1), (window * window).sum(-1)
    sye = np.einsum("thm,hkm->thk", window, e)
    det = m * see - se * se
    depth = (se * sy[..., None] - m * sye) / np.where(det > 1e-12, det, 1)
    level = (sy[..., None] + depth * se) / m
    error = syy[..., None] - level * sy[..., None] + depth * sye
    best = error.argmin(-1)
    inner = np.clip(best, 1, 19)
    at = lambda a, k: np.take_along_axis(a, k[..., None], -1)[..., 0]
    l, c, r = at(error, inner - 1), at(error, inner), at(error, inner + 1)
    curve = l - 2 * c + r
    bend = np.where(np.abs(curve) > 1e-12, 0.5 * (l - r) / np.where(np.abs(curve) > 1e-12, curve, 1), 0)
    place = shift[inner] + np.clip(bend, -0.6, 0.6) * (shift[1] - shift[0])
    cont, dip = at(level, best), at(depth, best)
    share = np.clip(dip / np.maximum(cont, 1e-9), 0, 1.2)
    trust = np.clip((share - gate + 0.03) / 0.06, 0, 1)
    plain = window[..., half]
    core = trust * (cont - dip) + (1 - trust) * plain
    model = cont[..., None] - dip[..., None] * np.exp(-0.5 * ((offset - place[..., None]) / sigma[None, :, None]) ** 2)
    return {
        "core": core.astype(np.float32),
        "mu": np.where(trust > 0, centre + place, np.nan).astype(np.float32),
        "depth": share.astype(np.float32),
        "residual": (window - model).astype(np.float32),
        "continuum": cont.astype(np.float32),
    }


def velocity(mu: np.ndarray, smile: np.ndarray, flexure: np.ndarray, slit: np.ndarray, depth: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Line shift (y, t) left by smile, flexure and slit term; gated, then each
    place the mean of its 5x5 neighbours within 0.6 px; 0 where unmeasured."""
    v = mu - smile[:, None] - flexure[None, :] + slit[:, None]
    ok = np.isfinite(v) & (depth > 0.15) & (core > 0.25 * N.percentile(core, 80))
    v = np.where(ok, v, 0.0)
    h, w = v.shape
    total, count = np.zeros_like(v), np.zeros_like(v)
    padded, valid = np.pad(v, 2), np.pad(ok, 2)
    for dy in range(5):
        for dx in range(5):
            o, k = padded[dy : dy + h, dx : dx + w], valid[dy : dy + h, dx : dx + w]
            near = k & (np.abs(o - v) < 0.6)
            total += np.where(near, o, 0)
            count += near
    return np.where(ok & (count > 0), total / np.maximum(count, 1), 0.0)


CATALOG = [
    (3933.66, "Ca II K", 0.9), (3968.47, "Ca II H", 0.9), (4101.74, "H delta", 0.5), (4226.73, "Ca I", 0.5), (4340.47, "H gamma", 0.6), (4383.55, "Fe I", 0.5), (4861.34, "H beta", 0.7), (5167.33, "Mg I b4", 0.6),
    (5172.68, "Mg I b2", 0.7), (5183.60, "Mg I b1", 0.7), (5889.95, "Na I D2", 0.7), (5895.92, "Na I D1", 0.6), (6122.22, "Ca I", 0.4), (6162.17, "Ca I", 0.4), (6302.50, "Fe I", 0.3), (6562.79, "H alpha", 0.8), (8542.09, "Ca II", 0.6),
]


def nearest_line(wavelength: float, tolerance: float) -> tuple[float, str, float] | None:
    """The catalogue's nearest line within the tolerance, the first of two as near."""
    best = min(CATALOG, key=lambda line: abs(line[0] - wavelength))
    return best if abs(best[0] - wavelength) <= tolerance else None


def grating_dispersion(pixel_um: float, binning: float, lines_mm: float, focal_mm: float, angle_deg: float, order: int, wavelength: float) -> float | None:
    """Angstrom a pixel of a spectrograph with a fixed angle between its beams."""
    if min(lines_mm, focal_mm) <= 0:
        return None
    period, half = 1e7 / lines_mm, np.radians(angle_deg / 2)
    s = order * wavelength / (2 * period * np.cos(half))
    if abs(s) > 1:
        return None
    return float(abs(np.cos(np.arcsin(s) - half)) * period * pixel_um * binning / 1000.0 / (focal_mm * order))


def calibrate(x: np.ndarray, depth: np.ndarray, wavelength: float, dispersion: float) -> dict | None:
    """wavelength = a + b x: the three deepest lines each stand for the expected
    one, in both senses of the axis; matches and line are refined in turn."""
    best: dict | None = None
    for k in np.argsort(-depth)[:3]:
        for sign in (1.0, -1.0):
            b = sign * dispersion
            a = wavelength - b * x[k]
            for _ in range(10):
                pairs = [(xi, line[0], d) for xi, d in zip(x, depth, strict=True) if (line := nearest_line(a + b * xi, 12 * dispersion))]
                if len(pairs) < 2:
                    break
                px, pw, pd = map(np.array, zip(*pairs, strict=True))
                c = N.fit_polynomial(px, pw, 1, pd)
                if c is None or not 0.7 < abs(c[1]) / dispersion < 1.4:
                    break
                a, b = c
            pairs = [(xi, line[0]) for xi in x if (line := nearest_line(a + b * xi, 6 * dispersion))]
            rms = float(np.sqrt(np.mean([(a + b * xi - wl) ** 2 for xi, wl in pairs]))) if pairs else np.inf
            got = {"a": float(a), "b": float(b), "rms": rms, "n": len(pairs)}
            if best is None or (got["n"], -got["rms"]) > (best["n"], -best["rms"]):
                best = got
    return best
