"""Made scans with a known truth, and a made focus camera."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import numeric as N


def hashed(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """0..1 from integer lattice places, by wrapping 64-bit arithmetic."""
    with np.errstate(over="ignore"):
        v = np.asarray(x, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(y, np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(seed)
        v = (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ v >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return (v >> np.uint64(40)).astype(float) / float(1 << 24)


def value_noise(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Lattice noise with a quintic fade."""
    ix, iy = np.floor(x), np.floor(y)
    tx, ty = x - ix, y - iy
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    u, v = fade(tx), fade(ty)
    corner = lambda a, b: hashed(ix + a, iy + b, seed)
    return (corner(0, 0) * (1 - u) + corner(1, 0) * u) * (1 - v) + (corner(0, 1) * (1 - u) + corner(1, 1) * u) * v


def octaves(x: np.ndarray, y: np.ndarray, seed: int, n: int = 4) -> np.ndarray:
    """Noise octaves of amplitude x0.55 and frequency x2.1."""
    out, amp, freq, total = np.zeros(np.broadcast(x, y).shape), 1.0, 1.0, 0.0
    for k in range(n):
        out += amp * value_noise(np.asarray(x) * freq, np.asarray(y) * freq, seed + 101 * k)
        total += amp
        amp, freq = amp * 0.55, freq * 2.1
    return out / total


@dataclass(frozen=True)
class ScanSettings:
    width: int = 160
    height: int = 600
    frames: int = 900
    radius: float = 255.0
    step: float = 0.62
    tilt_deg: float = 2.0
    jitter: float = 0.35
    seed: int = 42
    noise: bool = True
    dust: bool = True
    cloud: bool = True
    doppler: bool = False
    flexure: float = 0.0
    exposure: float = 1.0
    #: Along the scan; share of frames in bursts of bad seeing; steady seeing (px); water lines.
    jitter_x: float = 0.0
    bursts: float = 0.0
    seeing: float = 0.0
    water: bool = False

    def clean(self) -> ScanSettings:
        return replace(self, jitter=0.0, noise=False, dust=False, cloud=False, flexure=0.0, jitter_x=0.0, bursts=0.0)


@dataclass(frozen=True)
class Sun:
    """Features on the unit disk: dark filaments, bright plages, prominences beyond the limb."""

    seed: int
    filaments: np.ndarray = field(init=False)
    plages: np.ndarray = field(init=False)
    prominences: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        place = lambda n, r: np.stack([rng.uniform(-r, r, n), rng.uniform(-r, r, n)], 1)
        object.__setattr__(self, "filaments", np.hstack([place(7, 0.6), rng.uniform(0, np.pi, (7, 1)), rng.uniform(0.08, 0.2, (7, 1)), rng.uniform(0.012, 0.02, (7, 1)), rng.uniform(0.15, 0.3, (7, 1))]))
        object.__setattr__(self, "plages", np.hstack([place(5, 0.55), rng.uniform(0.04, 0.09, (5, 1)), rng.uniform(0.12, 0.3, (5, 1))]))
        object.__setattr__(self, "prominences", np.stack([rng.uniform(0, 2 * np.pi, 4), rng.uniform(0.03, 0.07, 4), rng.uniform(0.05, 0.12, 4)], 1))

    def core(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Line-core intensity at unit-disk places."""
        r = np.hypot(u, v)
        mu = np.sqrt(np.clip(1 - r * r, 0, 1))
        out = 1 - 0.45 * (1 - mu) + 0.10 * (octaves(u * 30 + 100, v * 30 + 100, self.seed) - 0.5)
        for x, y, a, length, wide, dark in self.filaments:
            along, across = (u - x) * np.cos(a) + (v - y) * np.sin(a), -(u - x) * np.sin(a) + (v - y) * np.cos(a)
            out -= dark * np.exp(-((along / length) ** 4) - (across / wide) ** 2)
        for x, y, wide, bright in self.plages:
            out += bright * np.exp(-((u - x) ** 2 + (v - y) ** 2) / wide**2)
        edge = np.clip((1.004 - r) / 0.008, 0, 1)
        out = out * edge
        a = np.arctan2(v, u)
        for at, wide, bright in self.prominences:
            d = np.angle(np.exp(1j * (a - at)))
            out += np.where(r > 1, bright * np.exp(-((d / wide) ** 2) - (r - 1) / 0.04), 0) * (1 - edge)
        return np.maximum(out, 0)

    def continuum(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        r = np.hypot(u, v)
        mu = np.sqrt(np.clip(1 - r * r, 0, 1))
        grain = 0.08 * (octaves(u * 8 + 50, v * 14 + 50, self.seed + 9, 3) - 0.5)
        return (1 - 0.55 * (1 - mu) + grain) * np.clip((1.004 - r) / 0.008, 0, 1)

    def velocity(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Line shift in pixels from rotation about the vertical axis."""
        return np.where(np.hypot(u, v) < 1, 0.4 * u, 0.0)

    def velocity_image(self, radius: float) -> np.ndarray:
        n = int(2 * radius + 160)
        y, x = np.mgrid[:n, :n]
        return self.velocity((x - (n - 1) / 2) / radius, (y - (n - 1) / 2) / radius)

    def image(self, radius: float) -> np.ndarray:
        n = int(2 * radius + 160)
        y, x = np.mgrid[:n, :n]
        return self.core((x - (n - 1) / 2) / radius, (y - (n - 1) / 2) / radius).astype(np.float32)


def truth(s: ScanSettings) -> dict[str, np.ndarray]:
    """Series by frame and row that a scan is made with."""
    rng = np.random.default_rng(s.seed + 1)
    t = np.arange(s.frames)

    def correlated(keep: float, spread: float) -> np.ndarray:
        out, step = np.zeros(s.frames), rng.normal(0, spread, s.frames)
        for i in range(s.frames):
            out[i] = keep * out[i - 1] + step[i]
        return out

    walk, drift = correlated(0.9, np.sqrt(1 - 0.81)), 1.2 * np.sin(2.7 * t / s.frames) * t / s.frames
    cloud = np.ones(s.frames)
    if s.cloud:  # a slow wave, flicker, and one cloud
        cloud = np.clip(1 + 0.03 * np.sin(t / 140) + correlated(0.92, 0.008) - 0.15 * np.exp(-(((t - 0.358 * s.frames) / 12) ** 2)), 0.6, 1.2)
    rows = np.ones(s.height)
    if s.dust:
        for _ in range(14):
            rows *= 1 - rng.uniform(0.02, 0.12) * np.exp(-(((np.arange(s.height) - rng.uniform(10, s.height - 10)) / rng.uniform(0.6, 2.8)) ** 2))
    flex = s.flexure * np.sin(np.linspace(0, 2 * np.pi, s.frames))
    jitter, jitter_x, blur = s.jitter * walk + (drift if s.jitter > 0 else 0.0), np.zeros(s.frames), np.zeros(s.frames)
    more = np.random.default_rng(s.seed + 7)
    if s.jitter_x > 0:
        for i in range(1, s.frames):
            jitter_x[i] = 0.9 * jitter_x[i - 1] + more.normal(0, s.jitter_x * np.sqrt(1 - 0.81))
    i = 0
    while s.bursts > 0 and i < s.frames:  # 2 to 8 frames displaced together and blurred along the slit
        if more.uniform() < s.bursts / 5:
            run, kick = slice(i, i + int(more.integers(2, 9))), more.uniform(-3, 3)
            blur[run] = more.uniform(2.5, 6)
            jitter[run] += kick
            jitter_x[run] += 0.7 * kick
            i = run.stop
        else:
            i += 1
    return {"jitter": jitter, "jitter_x": jitter_x, "blur": blur, "transparency": cloud, "flex": flex, "row_gain": rows, "noise_seed": np.array([s.seed + 2])}


def stencil(seeing: float, slit: float) -> list[tuple[float, float, float]]:
    """(dx, dy, weight) of the places that a pixel gathers: seeing as 3 x 3 places
    a sigma apart, times three along the slit's width."""
    wide = [(i * seeing, j * seeing, float(np.exp(-0.5 * (i * i + j * j)))) for i in (-1, 0, 1) for j in (-1, 0, 1)] if seeing > 0 else [(0.0, 0.0, 1.0)]
    out = [(x + b, y, w) for x, y, w in wide for b in ((-slit / 3, 0.0, slit / 3) if slit > 0 else (0.0,))]
    total = sum(w for *_, w in out)
    return [(x, y, w / total) for x, y, w in out]


#: Depth, offset and width (px) of the water lines beside the line.
WATER = ((0.10, -20.0, 1.5), (0.06, 17.0, 1.5))


def smile(s: ScanSettings) -> np.ndarray:
    """Line centre of each row."""
    y = np.arange(s.height) - s.height / 2
    return s.width / 2 + 0.008 * y + 6 / (s.height / 2) ** 2 * y * y


def render(s: ScanSettings, frames: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """Frames (n, height, width) of 16-bit counts."""
    sun = Sun(s.seed)
    y = np.arange(s.height, dtype=float)
    x = np.arange(s.width, dtype=float)
    centre = smile(s)
    places = stencil(s.seeing, s.step if s.seeing > 0 else 0.0)
    out = np.empty((len(frames), s.height, s.width), np.float32)
    for k, t in enumerate(frames.tolist()):
        row = y + known["jitter"][t] - s.height / 2
        u = ((t - (s.frames - 1) / 2) * s.step + known["jitter_x"][t]) / s.radius + np.tan(np.radians(s.tilt_deg)) * row / s.radius
        v = row / s.radius
        core = cont = 0.0
        b = known["blur"][t]
        for dx, dy, w in places:
            for db, wb in ((-b, 0.27), (0.0, 0.46), (b, 0.27)) if b > 0 else ((0.0, 1.0),):
                core = core + w * wb * sun.core(u + dx / s.radius, v + (dy + db) / s.radius)
                cont = cont + w * wb * sun.continuum(u + dx / s.radius, v + (dy + db) / s.radius)
        off = x[None] - centre[:, None] - known["flex"][t] - (sun.velocity(u, v)[:, None] if s.doppler else 0)
        narrow, wide = np.exp(-0.5 * (off / 2.3) ** 2), np.exp(-0.5 * (off / 13.0) ** 2)
        quiet = cont[:, None] * (1 - 0.82 * (0.55 * narrow + 0.45 * wide))
        glow = (core - cont)[:, None] * 0.18 * narrow
        spectrum = np.maximum(quiet + glow, 0) * known["transparency"][t] * known["row_gain"][:, None]
        if s.water:  # fixed in wavelength: they move with the flexure, not with the Sun
            for depth, at, wide_ in WATER:
                spectrum = spectrum * (1 - depth * np.exp(-0.5 * ((x[None] - centre[:, None] - known["flex"][t] - at) / wide_) ** 2))
        counts = 30000 * s.exposure * spectrum + 200
        if s.noise:
            rng = np.random.default_rng((int(known["noise_seed"][0]), t))
            counts = counts + rng.normal(0, 1, counts.shape) * np.sqrt(np.maximum(counts, 0) / 1.2 + 22.0**2)
        out[k] = np.floor(np.clip(counts, 0, 65535))
    return out


def scans(spark: SparkSession, s: ScanSettings, n: int) -> DataFrame:
    """n scans of one Sun, each with its own noise, seeing and clouds."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (scan(spark, s, f"synthetic-{k}", known=truth(replace(s, seed=s.seed + 7717 * k))) for k in range(n)))


def scan(spark: SparkSession, s: ScanSettings, scan_id: str = "synthetic", per_task: int = 32, known: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The scan's frames, rendered where they are needed: frames depend on
    their number alone, so a lost task makes the same ones again."""
    known = known or truth(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for i in range(0, len(ids), 8):
                px = render(s, ids[i : i + 8], known)
                n, size = len(px), s.height * s.width
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(px.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([scan_id] * n), pa.array(ids[i : i + 8].astype(np.int32)), pa.array(np.full(n, s.width, np.int32)), pa.array(np.full(n, s.height, np.int32)), lists],
                    ["scan_id", "frame", "width", "height", "px"],
                )

    return spark.range(0, s.frames, 1, max(1, s.frames // per_task)).mapInArrow(run, "scan_id string, frame int, width int, height int, px array<float>")


def focus_sigma(frame: np.ndarray) -> np.ndarray:
    """Width of the focus camera's main line: 1.4 to 5.4 and back over 240 frames."""
    t = np.asarray(frame) % 240
    return 1.4 + 4.0 * np.where(t < 120, t, 240 - t) / 120.0


def focus_frame(frame: int, width: int = 512, height: int = 200) -> np.ndarray:
    """A made frame: a deep line of the swept width, a shallow one of width 1.1, .5 % noise."""
    x = np.arange(width, dtype=float)
    line = 1 - 0.6 * np.exp(-0.5 * ((x - width * 0.5) / focus_sigma(frame)) ** 2) - 0.1 * np.exp(-0.5 * ((x - width * 0.8) / 1.1) ** 2)
    y = np.arange(height)[:, None]
    noise = hashed(x[None] + 7919.0 * frame, y + np.zeros_like(x)[None], 77) - 0.5
    return np.clip(30000 * line[None] * (1 + 0.01 * noise), 0, 65535).astype(np.uint16)
