"""Reconstruction of scans: frames in, round disks out.

Work on single frames (means, previews, line fits) is distributed by frame and
needs no exchange.  Work on whole images (a scan's columns side by side) is
one task a scan, so that many scans run beside each other; what comes to the
driver are coefficients and series of one number a frame.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import motion as M
from ..functions import numeric as N
from ..functions import photometry as P
from ..functions import restore as R
from ..functions import spectrum as S
from ..functions import telluric as T
from ..operators.frames import bright_frames
from ..sources.shared import stored


@dataclass(frozen=True)
class Tuning:
    """Numbers that may be set by name."""

    w_fit: float = 8.0
    pca_k: float = 3.0
    mu_range: float = 3.0
    depth_gate: float = 0.10
    transp_deadband: float = 0.012
    transv_deadband: float = 0.004
    jitter_hp: float = 41.0
    burst_thresh: float = 1.3
    nlm_radius: float = 3.0
    nlm_h: float = 1.8
    motion_strength: float = 1.0
    column_demix_strength: float = 1.0
    rl_iters: float = 15.0
    rl_tv: float = 0.01
    rl_floor: float = 1.2
    denoise_k: float = 1.0

    def set(self, name: str, value: float) -> Tuning:
        if name not in {f.name for f in fields(self)}:
            raise KeyError(f"no setting {name}")
        return replace(self, **{name: float(value)})

    @staticmethod
    def parse(text: str) -> Tuning:
        """`name=value,name=value`."""
        out = Tuning()
        for item in filter(None, (x.strip() for x in text.split(","))):
            name, _, value = item.partition("=")
            out = out.set(name.strip(), float(value))
        return out


@dataclass(frozen=True)
class Options:
    baseline: bool = False
    profile: bool = True
    motion: bool = True
    scan_positions: bool = True
    limb_positions: bool = True
    transparency: bool = True
    bursts: bool = True
    rows: bool = True
    demix: bool = True
    nlm: bool = True
    deconvolve: bool = False
    denoise: bool = False
    flip_x: bool = False
    flip_y: bool = False
    rotation_deg: float = 0.0
    margin: float = 0.15
    shift: float = 0.0
    window_sigma: float = 0.0
    map_iterations: int = 0
    tuning: Tuning = Tuning()


def _cubes(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(scan, frame numbers, frames (n, slit row, wavelength)) of a batch; wide frames are transposed."""
    scan = batch.column("scan_id").to_pylist()
    frame = batch.column("frame").to_numpy(zero_copy_only=False)
    width, height = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "height"))
    px = batch.column("px")
    off, flat = px.offsets.to_numpy(), px.values.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(scan):
        j = i
        while j < len(scan) and j - i < 8 and (scan[j], width[j], height[j]) == (scan[i], width[i], height[i]):
            j += 1
        cube = flat[off[i] : off[j]].reshape(j - i, height[i], width[i])
        yield scan[i], frame[i:j], cube.transpose(0, 2, 1) if width[i] > height[i] else cube
        i = j


def per_frame(frames: DataFrame, kernel: Callable[[str, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """kernel(scan, numbers, cube) gives columns of one row a frame."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan, number, cube in _cubes(batch):
                got = kernel(scan, number, cube)
                if got is None:
                    continue
                cols = [pa.array([scan] * len(number)), pa.array(number.astype(np.int32))]
                for name in names[2:]:
                    v = np.asarray(got[name])
                    if v.ndim == 1:
                        cols.append(pa.array(v))
                    else:
                        v = np.ascontiguousarray(v.reshape(len(number), -1), np.float32)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return frames.mapInArrow(run, schema)


def frame_means(frames: DataFrame) -> DataFrame:
    """(scan_id, frame, mean) over every fourth slit row."""
    return per_frame(frames, lambda _, n, c: {"mean": c[:, ::4].mean((1, 2), dtype=float)}, "scan_id string, frame int, mean double")


def mean_images(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """(scan_id, height, width, total, n): sums of the kept frames, one row a
    task and scan, added up over two levels."""
    chosen = frames.join(kept, ["scan_id", "frame"], "left_semi")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for scan, number, cube in _cubes(batch):
                have = held.setdefault(scan, [np.zeros(cube.shape[1:]), 0])
                have[0] += cube.sum(0, dtype=float)
                have[1] += len(number)
        for scan, (total, n) in held.items():
            yield pa.RecordBatch.from_pydict({"scan_id": [scan], "height": pa.array([total.shape[0]], pa.int32()), "width": pa.array([total.shape[1]], pa.int32()), "total": [total.reshape(-1)], "n": [n]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["total"].to_list()), 0)
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "height": pdf["height"].iloc[:1].to_numpy(), "width": pdf["width"].iloc[:1].to_numpy(), "total": [total], "n": [int(pdf["n"].sum())]})

    schema = "scan_id string, height int, width int, total array<double>, n bigint"
    sums = chosen.mapInArrow(partial, schema)
    level = sums.withColumn("_part", F.spark_partition_id() % 16).groupBy("scan_id", "_part").applyInPandas(add, schema)
    return level.groupBy("scan_id").applyInPandas(add, schema)


@dataclass(frozen=True)
class Geometry:
    """What the driver knows of a scan."""

    line: S.LineGeometry
    sigma: np.ndarray
    height: int
    width: int
    continuum: float
    level: float


def geometries(frames: DataFrame, baseline: bool = False) -> tuple[dict[str, Geometry], dict[str, np.ndarray]]:
    """(geometry, mean image) of each scan, from two passes over the frames."""
    means = frame_means(frames)
    kept = bright_frames(means, "frame", "mean", by=["scan_id"])
    found, images = {}, {}
    for row in mean_images(frames, kept).toLocalIterator():
        img = np.array(row["total"]).reshape(row["height"], row["width"]) / row["n"]
        line = S.line_geometry_by_minimum(img) if baseline else S.line_geometry(img)
        if line is None:
            continue
        room = min(float(line.centre(np.arange(line.first, line.last + 1)).min()), img.shape[1] - 1 - float(line.centre(np.arange(line.first, line.last + 1)).max()))
        found[row["scan_id"]] = Geometry(line, S.row_sigmas(img, line), *img.shape, min(25.0, room - 3), N.percentile(img.max(1), 80))
        images[row["scan_id"]] = img
    return found, images


def mean_spectrum(frames: DataFrame) -> DataFrame:
    """(scan_id, offset_px, intensity): the mean spectrum along the line's
    path, rows weighted by their light."""
    spark = frames.sparkSession
    found, images = geometries(frames)
    rows = []
    for scan, g in found.items():
        img = images[scan]
        y = np.arange(g.line.first, g.line.last + 1)
        reach = int(min(g.width // 2 - 1, 70))
        off = np.arange(-reach, reach + 1)
        values = N.spline_at(N.spline_coefficients(img[y]), g.line.centre(y)[:, None] + off)
        w = img[y].sum(1)
        rows += [(scan, int(o), float(v)) for o, v in zip(off, (w[:, None] * values).sum(0) / w.sum(), strict=True)]
    return spark.createDataFrame(rows, "scan_id string, offset_px int, intensity double")


def _image(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(pdf.sort_values("frame")[column].to_list(), 1).astype(float)


def motions(frames: DataFrame, found: dict[str, Geometry], o: Options) -> dict[str, np.ndarray]:
    """Slit shift of each frame, from the continuum beside the line."""

    def preview(scan: str, number: np.ndarray, cube: np.ndarray) -> dict | None:
        if scan not in found:
            return None
        g = found[scan]
        return {"col": S.continuum_preview(cube, g.line.centre(np.arange(g.height)) + g.continuum)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        img = _image(pdf, "col")
        total = np.zeros(img.shape[1])
        for step in (lambda v: M.jitter(v, int(round(o.tuning.jitter_hp))), M.drift):
            d = step(M.shift_columns(img, total))
            total = total + d if d is not None else total
        return pd.DataFrame({"scan_id": pdf["scan_id"], "frame": pdf["frame"], "dy": total * np.clip(o.tuning.motion_strength, 0, 1.5)})

    columns = per_frame(frames, preview, "scan_id string, frame int, col array<float>")
    out: dict[str, list] = {}
    for row in columns.groupBy("scan_id").applyInPandas(solve, "scan_id string, frame int, dy double").toLocalIterator():
        out.setdefault(row["scan_id"], []).append((row["frame"], row["dy"]))
    return {scan: np.array([d for _, d in sorted(v)]) for scan, v in out.items()}


#: Spectral places, in pixels from the line, at which a frame's mean spectrum is kept.
REACH = 60


def _spectra(g: Geometry, cube: np.ndarray, shift: np.ndarray | float, wing: float = 6.0) -> dict:
    """Mean spectrum of each frame along the line, and its columns at the two wings."""
    y = np.arange(g.height, dtype=float)
    centre = g.line.centre(np.broadcast_to(y + shift, (len(cube), g.height)))
    room = int(min(REACH, g.width // 2 - 8))
    offset = np.concatenate([np.arange(-room, room + 1), np.linspace(-wing - 1, -wing + 1, 5), np.linspace(wing - 1, wing + 1, 5)])
    values = S.spline_lines(cube.astype(float), centre[..., None] + offset)
    lit = values.max(-1) > 0.25 * g.level
    spec = (values[..., : 2 * room + 1] * lit[..., None]).sum(1) / np.maximum(lit.sum(1), 1)[:, None]
    k = np.exp(-0.5 * np.linspace(-1, 1, 5) ** 2)
    wings = values[..., 2 * room + 1 :].reshape(*lit.shape, 2, 5) @ (k / k.sum())
    return {"spec": spec, "blue": wings[..., 0], "red": wings[..., 1]}


def frame_spectra(frames: DataFrame, found: dict[str, Geometry], wing: float = 6.0) -> DataFrame:
    """(scan_id, frame, spec, blue, red) from one pass."""

    def kernel(scan: str, number: np.ndarray, cube: np.ndarray) -> dict | None:
        return _spectra(found[scan], cube, 0.0, wing) if scan in found else None

    return per_frame(frames, kernel, "scan_id string, frame int, spec array<float>, blue array<float>, red array<float>")


def fits(frames: DataFrame, found: dict[str, Geometry], dy: dict[str, np.ndarray], o: Options) -> DataFrame:
    """(scan_id, frame, core, mu, depth, cont, residual, spec): line fits of
    every spectrum, what they leave, and each frame's mean spectrum, from one pass."""
    t = o.tuning

    def fit(scan: str, number: np.ndarray, cube: np.ndarray) -> dict | None:
        if scan not in found:
            return None
        g = found[scan]
        y = np.arange(g.height, dtype=float)
        shift = dy.get(scan)
        own = shift[number][:, None] if shift is not None else np.zeros((len(number), 1))
        spec = _spectra(g, cube, own)["spec"] if o.profile else np.zeros((len(number), 1))
        at = y[None] + own
        if shift is not None and np.abs(shift).max() > 0:  # bring every frame's rows to the common slit first
            c = N.spline_coefficients(np.ascontiguousarray(cube.transpose(0, 2, 1), float))
            cube = N.spline_at(c, np.broadcast_to(at[:, None], c.shape)).transpose(0, 2, 1)
        centre = g.line.centre(at) + o.shift
        if not o.profile:
            if o.window_sigma > 0:
                core = np.stack([S.gaussian_window(f, c, o.window_sigma) for f, c in zip(cube.astype(float), centre, strict=True)])
            elif o.baseline:
                core = np.stack([S.adaptive_sample(f, c) for f, c in zip(cube.astype(float), centre, strict=True)])
            else:
                core = S.spline_lines(cube.astype(float), centre[..., None])[..., 0]
            return {"core": core, "mu": np.full_like(core, np.nan), "depth": np.zeros_like(core), "residual": np.zeros((len(core), 1)), "cont": core, "spec": spec}
        got = S.fit_frames(cube.astype(float), centre, g.sigma, int(round(t.w_fit)), t.mu_range, t.depth_gate)
        return got | {"cont": got["continuum"], "spec": spec}

    return per_frame(frames, fit, "scan_id string, frame int, core array<float>, mu array<float>, depth array<float>, cont array<float>, residual array<float>, spec array<float>")


def _fixed(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays as (rows, items), padded with 0 where another scan's are shorter."""
    col = batch.column(column)
    size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.float32)
    out[np.arange(out.shape[1])[None] < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def shapes(fitted: DataFrame, found: dict[str, Geometry], k: int) -> dict[str, np.ndarray]:
    """The k leading shapes of each scan's residuals: every third frame's sums
    and scatter matrix are added up, the driver solves one small matrix a scan."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            residual, cont = _fixed(batch, "residual"), _fixed(batch, "cont")
            for i, scan in enumerate(batch.column("scan_id").to_pylist()):
                h, level = found[scan].height, found[scan].level
                m = len(batch.column("residual")[i]) // h
                lit = cont[i, :h:4] > 0.25 * level
                r = (residual[i, : h * m].reshape(h, m)[::4][lit] / level).astype(float)
                sums[scan] = sums.get(scan, 0) + np.concatenate([(r.T @ r).ravel(), r.sum(0), [lit.sum()]])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["scan_id", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scan_id": [pdf["scan_id"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), 0)]})

    schema, out = "scan_id string, sums array<double>", {}
    sums = fitted.where("frame % 3 = 0").select("scan_id", "residual", "cont").mapInArrow(scatter, schema)
    for row in sums.groupBy("scan_id").applyInPandas(add, schema).toLocalIterator():
        v = np.array(row["sums"])
        m = int((-1 + np.sqrt(4 * len(v) - 3)) / 2)
        n = v[-1]
        if n > 500:
            mean = v[m * m : m * m + m] / n
            _, vectors = np.linalg.eigh(v[: m * m].reshape(m, m) - n * np.outer(mean, mean))
            out[row["scan_id"]] = vectors[:, ::-1][:, :k].T
    return out


def profiles(fitted: DataFrame, found: dict[str, Geometry], o: Options) -> DataFrame:
    """(scan_id, frame, core, mu, depth, cont) of fits(), with the leading
    residual shapes added back at the line's centre."""
    kept = ["scan_id", "frame", "core", "mu", "depth", "cont"]
    k = int(round(o.tuning.pca_k))
    bases = shapes(fitted, found, k) if o.profile and k > 0 else {}
    if not bases:
        return fitted.select(*kept)
    # what a residual adds at the centre: one number for each of its places
    gain = {scan: basis.T @ basis[:, basis.shape[1] // 2] for scan, basis in bases.items()}

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            residual, core = batch.column("residual"), batch.column("core")
            rows = []
            for i, scan in enumerate(batch.column("scan_id").to_pylist()):
                v = core[i].values.to_numpy()
                rows.append(v + residual[i].values.to_numpy().reshape(len(v), -1) @ gain[scan] if scan in gain else v)
            cols = {c: batch.column(c) for c in kept} | {"core": pa.array([r.astype(np.float32) for r in rows], pa.list_(pa.float32()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), kept)

    return fitted.select(*kept, "residual").mapInArrow(final, "scan_id string, frame int, core array<float>, mu array<float>, depth array<float>, cont array<float>")


def drifts(spectra: DataFrame, found: dict[str, Geometry], images: dict[str, np.ndarray]) -> DataFrame:
    """(scan_id, frames, lines, dispersion, flexure, slit) from (scan_id, frame,
    spec): drift from water lines of each scan that shows any; `flexure` by
    frame, `slit` by row."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        scan = pdf["scan_id"].iloc[0]
        spec = np.stack(pdf["spec"].to_list()).astype(float)
        room = spec.shape[1] // 2
        g = found[scan]
        got = T.flexure(spec, np.arange(-room, room + 1, dtype=float), float(np.median(g.sigma)))
        if got is None:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in ("scan_id", "frames", "lines", "dispersion", "flexure", "slit")})
        slit = T.slit_velocity(images[scan], g.line.centre(np.arange(g.height)), g.line.first, g.line.last, got.offsets)
        return pd.DataFrame({"scan_id": [scan], "frames": [len(pdf)], "lines": [got.lines], "dispersion": [got.dispersion], "flexure": [got.series], "slit": [slit if slit is not None else np.zeros(g.height)]})

    schema = "scan_id string, frames int, lines int, dispersion double, flexure array<double>, slit array<double>"
    return spectra.select("scan_id", "frame", "spec").groupBy("scan_id").applyInPandas(solve, schema)


def wing_dopplergrams(frames: DataFrame, wing: float = 6.0) -> DataFrame:
    """(scan_id, y, row) of the difference of the wings over their sum, by slit row and frame."""
    found, _ = geometries(frames)

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        v = T.wing_difference(_image(pdf, "blue"), _image(pdf, "red"))
        return pd.DataFrame({"scan_id": pdf["scan_id"].iloc[0], "y": np.arange(len(v), dtype=np.int32), "row": list(v.astype(np.float32))})

    return frame_spectra(frames, found, wing).groupBy("scan_id").applyInPandas(image, "scan_id string, y int, row array<float>")


def finish(img: np.ndarray, flux: np.ndarray, o: Options, report: dict) -> np.ndarray | None:
    """The corrected column image's round disk."""
    t = o.tuning
    if o.transparency:
        gain = P.transparency_gains(flux, t.transp_deadband)
        report["transparency_range"] = [float(gain.min()), float(gain.max())]
        img = P.divide_columns(img, gain)
    for k in range(1 + o.map_iterations):
        if k == 0 and o.scan_positions:
            dx = M.scan_positions(img)
            if dx is not None:
                report["scan_position_rms"] = float(dx.std())
                img = M.shift_along_x(img, dx)
        if k == 0 and o.limb_positions:
            e = G.fit_ellipse(G.limb_points(img))
            if e is not None:
                dx = G.limb_x_offsets(G.limb_points(img), e, img.shape[1])
                report["limb_position_rms"] = float(dx.std())
                img = M.shift_along_x(img, dx)
        if k == 0 and o.bursts:
            img, flag, _ = P.repair_bursts(img, t.burst_thresh)
            report["bursts"] = int(flag.sum())
        if o.rows:
            img = P.correct_rows_plain(img) if o.baseline else P.correct_rows(img, t.transv_deadband)
    if o.demix and t.column_demix_strength > 0:
        img, states = P.demix_columns(img, t.column_demix_strength)
        report["demixed"] = bool(np.any(states))
    if o.nlm:
        noise = P.stride_noise(img)
        if noise is not None:
            img = P.temporal_nlm(img, *noise, radius=int(round(t.nlm_radius)), h=t.nlm_h)
    e = G.fit_ellipse(G.limb_points_plain(img) if o.baseline else G.limb_points(img))
    if e is None:
        return None
    report["ellipse"] = {k: v for k, v in asdict(e).items() if k != "conic"}
    report["slit_angle_deg"] = G.slit_angle(e, o.rotation_deg, o.flip_x, o.flip_y)
    out = G.warp_plain(img, e, G.canvas(e, o.margin)) if o.baseline else G.warp(img, e, G.canvas(e, o.margin), o.rotation_deg, o.flip_x, o.flip_y)
    if o.deconvolve:
        out = R.deconvolve(out.astype(float), int(round(t.rl_iters)), t.rl_tv, t.rl_floor)
    if o.denoise:
        out = R.denoise(out.astype(float), t.denoise_k)
    return out


SCHEMA = "scan_id string, kind string, y int, row array<float>, report string"


def reconstruct(frames: DataFrame, o: Options = Options()) -> DataFrame:
    """SCHEMA: rows of each scan's disk (`kind` disk) and velocity map (velocity),
    and one row (report) of JSON.  A scan without a line or a limb gives the
    report alone; one without frames gives nothing."""
    if o.baseline:
        o = replace(o, profile=False, motion=False, scan_positions=False, limb_positions=False, transparency=False, bursts=False, demix=False, nlm=False)
    found, images = geometries(frames, o.baseline)
    dy = motions(frames, found, o) if o.motion else {}
    fitted = fits(frames, found, dy, o)
    if o.profile:  # read three times; residuals are a sixth of a frame
        fitted = stored(fitted, "fits")
    water = {r["scan_id"]: (np.array(r["flexure"]), np.array(r["slit"]), r["lines"]) for r in drifts(fitted, found, images).toLocalIterator()} if o.profile else {}
    smiles = {scan: g.line.centre(np.arange(g.height)) for scan, g in found.items()}

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        scan = pdf["scan_id"].iloc[0]
        pdf = pdf.sort_values("frame")
        core, cont = _image(pdf, "core"), _image(pdf, "cont")
        report: dict = {"frames": len(pdf)}
        out = finish(core, P.column_flux(cont), o, report)
        rows = []
        if out is not None:
            rows += [(scan, "disk", y, r.astype(np.float32), None) for y, r in enumerate(out)]
            if o.profile:
                mu, depth = _image(pdf, "mu"), _image(pdf, "depth")
                rest = mu - smiles[scan][:, None]
                ok = np.isfinite(rest) & (depth > 0.15)
                flex = np.array([np.median(rest[ok[:, t], t]) if ok[:, t].sum() > 50 else np.nan for t in range(rest.shape[1])])
                good = np.isfinite(flex)
                flexure, slit = np.zeros(len(flex)), np.zeros(len(mu))
                if scan in water:
                    flexure, slit, report["water_lines"] = water[scan]
                elif good.sum() > 20:  # the Sun's own line, without what is straight in it
                    soft = N.loess(N.nearest_fill(flex), 101)
                    line = N.fit_robust(np.arange(len(flex), dtype=float), soft, 1, 4)
                    flexure = soft - N.evaluate(line, np.arange(len(flex), dtype=float))
                    flexure = np.where(np.abs(flexure) <= 0.02, 0, flexure)
                v = S.velocity(mu, smiles[scan], flexure, slit, depth, core)
                report["velocity_rms"] = float(v[v != 0].std()) if (v != 0).any() else 0.0
                e = G.fit_ellipse(G.limb_points(core))
                if e is not None:
                    rows += [(scan, "velocity", y, r.astype(np.float32), None) for y, r in enumerate(G.warp(v, e, signed=True))]
        rows.append((scan, "report", -1, None, json.dumps(report)))
        return pd.DataFrame(rows, columns=["scan_id", "kind", "y", "row", "report"])

    columns = profiles(fitted, found, o)
    return columns.groupBy("scan_id").applyInPandas(image, SCHEMA)


def disk_of(out: DataFrame, kind: str = "disk") -> dict[str, np.ndarray]:
    """A result's images on the driver, for writing to files or scoring."""
    held: dict[str, list] = {}
    for r in out.where(F.col("kind") == kind).select("scan_id", "y", "row").toLocalIterator():
        held.setdefault(r["scan_id"], []).append((r["y"], r["row"]))
    return {scan: np.array([row for _, row in sorted(rows)], np.float32) for scan, rows in held.items()}
