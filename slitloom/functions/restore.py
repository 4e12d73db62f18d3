"""Deconvolution and denoising of finished disks."""

from __future__ import annotations

import numpy as np

from . import numeric as N
from .geometry import Disk, fit_disk


def edge_widths(img: np.ndarray, d: Disk, bins: int = 8) -> np.ndarray:
    """Second-moment width of the limb's fall in each position-angle bin."""
    a = np.linspace(0, 2 * np.pi, 256, endpoint=False)
    r = np.linspace(0.94, 1.06, 97) * d.r
    p = N.bilinear(img, d.xc + r * np.cos(a)[:, None], d.yc + r * np.sin(a)[:, None])
    fall = np.maximum(-np.gradient(p, r, axis=1), 0)
    fall = np.where(fall > 0.1 * fall.max(1, keepdims=True), fall, 0)
    out = np.full(bins, np.nan)
    for k in range(bins):
        f = fall[(a / (2 * np.pi) * bins).astype(int) == k].mean(0)
        if f.sum() > 0:
            m = (f * r).sum() / f.sum()
            out[k] = np.sqrt(max((f * (r - m) ** 2).sum() / f.sum(), 0))
    return out


def estimate_psf(img: np.ndarray) -> tuple[float, float] | None:
    """(sigma x, sigma y): squared width is linear in cos2 of the position angle."""
    d = fit_disk(img)
    if d is None:
        return None
    s = edge_widths(img, d)
    a = (np.arange(len(s)) + 0.5) / len(s) * 2 * np.pi
    ok = np.isfinite(s)
    if ok.sum() < 4:
        return None
    c = N.fit_robust(np.cos(a[ok]) ** 2, s[ok] ** 2, 1, 3)
    return float(np.sqrt(max(c[0] + c[1], 0))), float(np.sqrt(max(c[0], 0)))


def tv_divergence(img: np.ndarray) -> np.ndarray:
    """Divergence of the normalised gradient."""
    gx, gy = np.diff(img, axis=1, append=img[:, -1:]), np.diff(img, axis=0, append=img[-1:])
    n = np.sqrt(gx * gx + gy * gy + 1e-6 * max(float(np.abs(img).max()), 1.0) ** 2)
    px, py = gx / n, gy / n
    return px - np.pad(px, ((0, 0), (1, 0)))[:, :-1] + py - np.pad(py, ((1, 0), (0, 0)))[:-1]


def deconvolve(img: np.ndarray, rounds: int = 15, tv: float = 0.01, floor: float = 1.2) -> np.ndarray:
    """Richardson-Lucy with total variation; skipped where the blur is below `floor` px."""
    psf = estimate_psf(img)
    if psf is None or max(psf) < floor:
        return img
    pedestal = max(N.percentile(img, 20), 1.0)
    both = lambda v: N.smooth(N.smooth(v, psf[0], 1), psf[1], 0)
    target = np.maximum(img, 0) + pedestal
    out = target.copy()
    for _ in range(rounds):
        out = out * both(target / np.maximum(both(out), 1e-6)) / np.maximum(1 - tv * tv_divergence(out), 0.5)
    return np.maximum(out - pedestal, 0)


_B3 = np.array([1, 4, 6, 4, 1]) / 16.0


def b3_smooth(img: np.ndarray, step: int) -> np.ndarray:
    out = img
    for axis in (0, 1):
        n = img.shape[axis]
        out = sum(w * np.take(out, N.mirrored(np.arange(n) + (k - 2) * step, n), axis=axis) for k, w in enumerate(_B3))
    return out


def noise_line(img: np.ndarray, block: int = 16) -> tuple[float, float] | None:
    """(gain, read variance): robust line of block variance against block mean on the finest plane."""
    fine = img - b3_smooth(img, 1)
    h, w = img.shape[0] // block * block, img.shape[1] // block * block
    cut = lambda v: v[:h, :w].reshape(h // block, block, w // block, block).swapaxes(1, 2).reshape(-1, block * block)
    mean, var = cut(img).mean(1), (1.4826 * np.median(np.abs(cut(fine) - np.median(cut(fine), 1, keepdims=True)), 1)) ** 2 / 0.8
    ok = mean > 0.05 * N.percentile(img, 95)
    if ok.sum() < 20:
        return None
    c = N.fit_robust(mean[ok], var[ok], 1, 4)
    return max(float(c[1]), 1e-6), max(float(c[0]), 0.0)


def denoise(img: np.ndarray, k: float = 1.0) -> np.ndarray:
    """Variance-stabilised a-trous shrinkage on four scales."""
    line = noise_line(img)
    if line is None:
        return img
    gain, read = line
    t = 2 / gain * np.sqrt(np.maximum(gain * img + 0.375 * gain * gain + read, 0))
    out, rest = np.zeros_like(t), t
    for level, sigma in enumerate((0.89, 0.20, 0.086, 0.041)):
        soft = b3_smooth(rest, 1 << level)
        plane = rest - soft
        out += np.sign(plane) * np.maximum(np.abs(plane) - k * sigma, 0)
        rest = soft
    t = out + rest
    return np.maximum((t * gain / 2) ** 2 / gain - 0.375 * gain - read / gain, 0)
