"""What a reconstruction leaves behind: files, tables, ledgers, diagnostics."""

from __future__ import annotations

import json
import os
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score
from ..operators.series import detrended
from ..sources import pictures
from ..sources import synthetic as Y
from . import reconstruct as R


def stems(scans: list[str]) -> dict[str, str]:
    """A file name for each scan: its base name, numbered where several scans share one."""
    seen: dict[str, int] = {}
    out = {}
    for scan in sorted(scans):
        base = os.path.splitext(os.path.basename(scan))[0]
        seen[base] = seen.get(base, 0) + 1
        out[scan] = base if seen[base] == 1 else f"{base}-{seen[base]}"
    return out


def save(out: DataFrame, folder: str, velocity: bool = False) -> list[str]:
    """Linear and display PNG and FITS of each scan's disk, and its velocity map if asked for."""
    os.makedirs(folder, exist_ok=True)
    made = []
    disks = R.disk_of(out)
    names = stems(list(disks))
    for scan, img in disks.items():
        base = os.path.join(folder, names[scan])
        pictures.write_png16(f"{base}_linear.png", img, 0, float(max(img.max(), 1)))
        pictures.write_png16(f"{base}_display.png", img)
        pictures.write_fits(f"{base}.fits", img)
        made += [f"{base}_linear.png", f"{base}_display.png", f"{base}.fits"]
    if velocity:
        for scan, v in R.disk_of(out, "velocity").items():
            path = os.path.join(folder, f"{names[scan]}_velocity.png")
            pictures.write_velocity_png(path, v)
            made.append(path)
    return made


def save_table(out: DataFrame, path: str) -> None:
    """The native sink: rows of disks as Parquet, by scan and kind."""
    out.write.mode("overwrite").partitionBy("scan_id", "kind").parquet(path)


def save_spectrum(spectrum: DataFrame, path: str) -> None:
    spectrum.orderBy("scan_id", "offset_px").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_series(series: DataFrame, path: str, by: str = "frame") -> None:
    """A scan's numbers by frame (shift, flexure, gains, their truth) as CSV."""
    series.orderBy("scan_id", by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(scores: DataFrame, path: str) -> None:
    """One JSON line a variant, added to what is there."""
    scores.coalesce(1).write.mode("append").json(path)


def diagnostics(estimated: DataFrame, truth: DataFrame, value: str, x: str = "frame") -> DataFrame:
    """(n, rms, correlation) of an estimated against a true series, both without their robust line."""
    est = detrended(estimated, value, x, name="_e")
    true = detrended(truth, value, x, name="_t")
    d = F.col("_e") - F.col("_t")
    return est.join(true, x).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rms"), F.corr("_e", "_t").alias("correlation"))


def flag_recall(estimated: DataFrame, truth: DataFrame, x: str = "frame") -> DataFrame:
    """(recall, false_positives) of flags (x, flag)."""
    both = estimated.select(x, F.col("flag").alias("e")).join(truth.select(x, F.col("flag").alias("t")), x)
    return both.agg((F.count_if(F.col("e") & F.col("t")) / F.count_if("t")).alias("recall"), F.count_if(F.col("e") & ~F.col("t")).alias("false_positives"))


VARIANTS = {
    "baseline": R.Options(baseline=True),
    "default": R.Options(),
    "no profile": R.Options(profile=False),
    "no motion": R.Options(motion=False),
    "no scan positions": R.Options(scan_positions=False),
    "no limb positions": R.Options(limb_positions=False),
    "no transparency": R.Options(transparency=False),
    "no bursts": R.Options(bursts=False),
    "no rows": R.Options(rows=False),
    "no demix": R.Options(demix=False),
    "no nlm": R.Options(nlm=False),
    "deconvolved": R.Options(deconvolve=True),
    "denoised": R.Options(denoise=True),
}


def bench(spark: SparkSession, settings: Y.ScanSettings, names: list[str] | None = None, tune: str = "") -> DataFrame:
    """Scores of variants on a made scan, one row each."""
    frames = Y.scan(spark, settings)
    truth = Y.Sun(settings.seed).image(settings.radius).astype(float)
    rows = []
    for name in names or list(VARIANTS):
        o = replace(VARIANTS[name], tuning=R.Tuning.parse(tune))
        for img in R.disk_of(R.reconstruct(frames, o)).values():
            s = score.evaluate(img.astype(float), truth, settings.radius)
            rows.append((settings.seed, name, s["disk_psnr"], s["disk_ssim"], s["limb_psnr"], s["limb_sigma"], s["flatness_pct"]))
    return spark.createDataFrame(rows, "seed int, variant string, disk_psnr double, disk_ssim double, limb_psnr double, limb_sigma double, flatness_pct double")


def reports(out: DataFrame) -> dict[str, dict]:
    return {r["scan_id"]: json.loads(r["report"]) for r in out.where("kind = 'report'").select("scan_id", "report").toLocalIterator()}


def strip(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """A frame thinned to a strip of bytes from its least to its greatest value."""
    h, w = frame.shape
    y, x = np.arange(height) * h // height, np.arange(width) * w // width
    small = frame[y][:, x].astype(float)
    low, high = small.min(), small.max()
    return np.round(255 * (small - low) / max(high - low, 1e-9)).astype(np.uint8)
