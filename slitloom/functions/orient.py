"""Orientation against a reference image."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import numeric as N
from .geometry import Disk, fit_disk

SIZE, RADIUS = 384, 180.0


@dataclass(frozen=True)
class Match:
    mirrored: bool
    rotation_deg: float
    score: float
    other_parity: float
    runner_up: float

    @property
    def margin(self) -> float:
        return self.score - max(self.other_parity, self.runner_up)

    @property
    def confident(self) -> bool:
        return self.score >= 0.10 and self.margin >= 0.025


def normalised(img: np.ndarray, d: Disk) -> np.ndarray:
    y, x = np.mgrid[:SIZE, :SIZE].astype(float)
    c, s = (SIZE - 1) / 2, d.r / RADIUS
    return N.bilinear(img, (x - c) * s + d.xc, (y - c) * s + d.yc, 0.0)


def features(img: np.ndarray) -> np.ndarray:
    """Local contrast of the logarithm: background of 9 px taken out, smoothed by 1."""
    v = np.log1p(np.maximum(img, 0) / max(N.percentile(img, 80), 1e-9))
    return N.blur(v - N.blur(v, 9), 1)


def scores(a: np.ndarray, b: np.ndarray, angles: np.ndarray, mirrored: bool, stride: int = 3) -> np.ndarray:
    """Correlation of a's points within .82 of the disk with b turned by each angle."""
    c = (SIZE - 1) / 2
    y, x = np.mgrid[:SIZE:stride, :SIZE:stride].astype(float)
    inside = np.hypot(x - c, y - c) <= 0.82 * RADIUS
    u, v = x[inside] - c, y[inside] - c
    fa = N.bilinear(a, u + c, v + c)
    u = -u if mirrored else u
    t = np.radians(angles)[:, None]
    fb = N.bilinear(b, u * np.cos(t) - v * np.sin(t) + c, u * np.sin(t) + v * np.cos(t) + c)
    fa, fb = fa - fa.mean(), fb - fb.mean(1, keepdims=True)
    return (fb @ fa) / np.maximum(np.sqrt((fa @ fa) * (fb * fb).sum(1)), 1e-12)


def match(img: np.ndarray, reference: np.ndarray) -> Match | None:
    """Rotation and mirror sense of img against the reference, to a tenth of a degree."""
    da, db = fit_disk(img), fit_disk(reference)
    if da is None or db is None:
        return None
    a, b = features(normalised(img, da)), features(normalised(reference, db))
    coarse = np.arange(180) * 2.0
    best = {}
    for m in (False, True):
        s = scores(a, b, coarse, m)
        k = int(s.argmax())
        fine = coarse[k] + np.arange(-20, 21) * 0.1
        f = scores(a, b, fine, m)
        far = np.abs((coarse - coarse[k] + 180) % 360 - 180) > 10
        best[m] = (float(f.max()), float(fine[f.argmax()]), float(s[far].max()))
    m = best[True][0] > best[False][0]
    return Match(m, (best[m][1] + 180) % 360 - 180, best[m][0], best[not m][0], best[m][2])


def apply(img: np.ndarray, m: Match) -> np.ndarray:
    """img turned and mirrored as matched, about its own centre."""
    h, w = img.shape
    y, x = np.mgrid[:h, :w].astype(float)
    u, v = x - (w - 1) / 2, y - (h - 1) / 2
    t = np.radians(-m.rotation_deg)
    u, v = u * np.cos(t) - v * np.sin(t), u * np.sin(t) + v * np.cos(t)
    return N.lanczos_sample(img, (-u if m.mirrored else u) + (w - 1) / 2, v + (h - 1) / 2)
