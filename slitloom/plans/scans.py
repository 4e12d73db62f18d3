"""Queries over made scans: no table is read, so there is no SQL for them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score
from ..sources import synthetic as Y
from ..streaming import focus
from . import reconstruct as R

SETTINGS = Y.ScanSettings(width=96, height=320, frames=420, radius=120)


def scan_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_spectrum(Y.scan(spark, SETTINGS))


def scan_disk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default reconstruction's disk, row by row."""
    return R.reconstruct(Y.scan(spark, SETTINGS)).where("kind = 'disk'").select("scan_id", "y", "row")


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the plain and of the default variant against the truth."""
    frames = Y.scan(spark, SETTINGS)
    truth = Y.Sun(SETTINGS.seed).image(SETTINGS.radius).astype(float)
    rows = []
    for name, o in (("baseline", R.Options(baseline=True)), ("default", R.Options()), ("default, no demix", R.Options(demix=False))):
        for scan, img in R.disk_of(R.reconstruct(frames, o)).items():
            s = score.evaluate(img.astype(float), truth, SETTINGS.radius)
            rows.append((scan, name, s["disk_psnr"], s["disk_ssim"], s["limb_psnr"], s["limb_sigma"], s["flatness_pct"], [float(v) for v in s["band_snr"]]))
    return spark.createDataFrame(rows, "scan_id string, variant string, disk_psnr double, disk_ssim double, limb_psnr double, limb_sigma double, flatness_pct double, band_snr array<double>")


def focus_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured against made widths over one sweep of the focus camera."""
    seq = spark.range(0, 240, 1, 8).select(F.col("id").alias("seq"))
    out = focus.measured(focus.made_frames(seq), rule="deepest").where("axis = 'x'")
    made = F.lit(1.4) + 4.0 * F.when(F.col("seq") % 240 < 120, F.col("seq") % 240).otherwise(240 - F.col("seq") % 240) / 120.0
    return out.select("seq", F.round("fwhm", 4).alias("fwhm"), F.round(made * 2.354820045, 4).alias("made_fwhm"))


def embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the embeddings' variance along their leading directions: the
    covariance is summed in parallel, the 64 x 64 eigenproblem is the driver's."""
    from ..operators.images import covariance

    cells = covariance(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding").collect()
    n = max((r["j"] for r in cells), default=-1) + 1
    m = np.zeros((n, n))
    for r in cells:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    values = np.linalg.eigvalsh(m)[::-1][:3] if n else []
    return spark.createDataFrame([(k, float(v / np.trace(m))) for k, v in enumerate(values)], "k int, share double")


QUERIES = {f.__name__: f for f in (scan_mean_spectrum, scan_disk_rows, scan_scores, focus_widths, embedding_components)}
