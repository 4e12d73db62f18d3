"""Operators on images in pixel, row and column form."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import nearest_rank


def to_rows(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, row): one array a row, in order of x."""
    cells = F.array_sort(F.collect_list(F.struct("x", "v")))
    return pixels.groupBy(*by, "y").agg(F.transform(cells, lambda c: c["v"]).alias("row"))


def to_columns(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("y", "v")))
    return pixels.groupBy(*by, "x").agg(F.transform(cells, lambda c: c["v"]).alias("col"))


def to_pixels(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.select(*by, "y", F.posexplode("row").alias("x", "v"))


def transposed(columns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns (x, col) to rows (y, row): one exchange of the pixels."""
    return to_rows(columns.select(*by, "x", F.posexplode("col").alias("y", "v")), by)


def lit_spans(pixels: DataFrame, threshold: DataFrame, by: Sequence[str], axis: str, along: str) -> DataFrame:
    """(by..., axis, lit, first, last) of the places above the threshold on each line of an axis."""
    lit = pixels.join(threshold, list(by)) if by else pixels.crossJoin(threshold)
    lit = lit.where(F.col("v") > F.col("threshold"))
    return lit.groupBy(*by, axis).agg(F.count("*").alias("lit"), F.min(along).alias("first"), F.max(along).alias("last"))


def chord_gate(spans: DataFrame, share: float, least: int, by: Sequence[str] = ()) -> DataFrame:
    """Lines whose lit length is at least `share` of the longest and `least` pixels."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return spans.withColumn("longest", F.max("lit").over(w)).where((F.col("lit") >= share * F.col("longest")) & (F.col("lit") >= least))


def photon_transfer(pixels: DataFrame, block: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., slope, intercept, blocks): variance against mean over square blocks."""
    blocks = pixels.groupBy(*by, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by_")).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    return blocks.where("n > 1").groupBy(*by).agg(F.regr_slope("var", "mean").alias("slope"), F.regr_intercept("var", "mean").alias("intercept"), F.count("*").alias("blocks"))


def sector_flatness(ratio: DataFrame, value: str, radius: Column, angle: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., flatness): the largest departure from 1 of the mean ratio in 4
    rings by 4 quarters, against the mean of all."""
    ring = F.floor(radius * 4).cast("int")
    quarter = F.pmod(F.floor(angle / 90.0), F.lit(4)).cast("int")
    cells = ratio.withColumn("_ring", ring).withColumn("_quarter", quarter).where("_ring between 0 and 3")
    sums = cells.groupBy(*by, "_ring", "_quarter").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = sums.withColumn("all", F.sum("s").over(w) / F.sum("n").over(w))
    return share.groupBy(*by).agg(F.max(F.abs(F.col("s") / F.col("n") / F.col("all") - 1)).alias("flatness"))


def radial_sky(pixels: DataFrame, radius: Column, width: float, least: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, sky, spread) of rings of `width` with more than `least`
    pixels: the 45th percentile and its distance from the 16th."""
    rings = pixels.withColumn("bin", F.floor(radius / width).cast("int")).groupBy(*by, "bin")
    out = rings.agg(F.count("v").alias("n"), nearest_rank(F.col("v"), 45).alias("sky"), nearest_rank(F.col("v"), 16).alias("low"))
    return out.where(F.col("n") > least).select(*by, "bin", "sky", (F.col("sky") - F.col("low")).alias("spread"))


def flux_disk(pixels: DataFrame, threshold: DataFrame, by: Sequence[str] = (), least: int = 500) -> DataFrame:
    """(by..., xc, yc, r, n): centroid and area radius of the lit pixels; none if they are too few."""
    lit = (pixels.join(threshold, list(by)) if by else pixels.crossJoin(threshold)).where(F.col("v") > F.col("threshold"))
    out = lit.groupBy(*by).agg(F.avg("x").alias("xc"), F.avg("y").alias("yc"), F.sqrt(F.count("*") / F.lit(3.141592653589793)).alias("r"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def intensity_match(pairs: DataFrame, image: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., slope, intercept, psnr): least-squares match of image to truth
    and 10 log10(1 / mean squared rest)."""
    fit = pairs.groupBy(*by).agg(F.regr_slope(truth, image).alias("slope"), F.regr_intercept(truth, image).alias("intercept"))
    joined = pairs.join(fit, list(by)) if by else pairs.crossJoin(fit)
    rest = F.col("slope") * F.col(image) + F.col("intercept") - F.col(truth)
    return joined.groupBy(*by, "slope", "intercept").agg((10 * F.log10(1 / F.avg(rest * rest))).alias("psnr"))


def quadratic_moments(pairs: DataFrame, u: str, v: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Normal equations of value ~ 1, u, v, u2, uv, v2: all 21 + 6 sums in one pass."""
    terms = [F.lit(1.0), F.col(u), F.col(v), F.col(u) * F.col(u), F.col(u) * F.col(v), F.col(v) * F.col(v)]
    aggs = [F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)]
    aggs += [F.sum(t * F.col(value)).alias(f"b{i}") for i, t in enumerate(terms)]
    return pairs.groupBy(*by).agg(*aggs)


_GRAM = "n bigint, mean array<double>, gram array<double>"


def _joined_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, means and centred Gram matrices of several parts as those of their union."""
    n, mean, gram = 0, None, None
    for pdf in frames:
        for m, u, g in zip(pdf["n"].tolist(), pdf["mean"], pdf["gram"], strict=True):
            u, g = np.asarray(u), np.asarray(g)
            if mean is None:
                n, mean, gram = m, u, g
                continue
            d = u - mean
            gram = gram + g + np.outer(d, d).ravel() * (n * m / (n + m))
            mean = mean + d * (m / (n + m))
            n += m
    if mean is not None:
        yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "gram": [gram.tolist()]})


def covariance(vectors: DataFrame, column: str, sample: Column | None = None) -> DataFrame:
    """(i, j, cov) of the upper triangle of the population covariance of an
    array column of one length: each task gives one centred Gram matrix, and
    these are joined in two steps.  Null vectors are left out."""
    rows = vectors.where(sample) if sample is not None else vectors
    rows = rows.select(F.col(column).cast("array<double>").alias("_v")).where("_v is not null")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                mean = x.mean(0)
                yield pd.DataFrame({"n": [len(x)], "mean": [mean], "gram": [((x - mean).T @ (x - mean)).ravel()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _joined_grams(grams(batches)):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    partial = rows.mapInArrow(run, _GRAM)
    some = math.isqrt(max(1, rows._jdf.rdd().getNumPartitions()))  # each task of either step joins about as many
    if some > 1:
        partial = partial.repartition(some).mapInPandas(_joined_grams, _GRAM)
    whole = partial.repartition(1).mapInPandas(_joined_grams, _GRAM)
    cells = whole.select("n", F.size("mean").alias("d"), F.posexplode("gram").alias("k", "g"))
    i, j = F.floor(F.col("k") / F.col("d")).cast("int"), (F.col("k") % F.col("d")).cast("int")
    return cells.select(i.alias("i"), j.alias("j"), (F.col("g") / F.col("n")).alias("cov")).where("j >= i")


def halo_blocks(columns: DataFrame, kernel: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str, width: int, block: int, halo: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs kernel(frame, lo, hi) on blocks of columns with `halo` neighbours on
    each side; the kernel returns rows for lo <= x < hi only.  Each column goes
    to at most ceil(halo / block) * 2 + 1 blocks, one exchange."""
    last = (width - 1) // block
    low = F.greatest(F.floor((F.col("x") - halo) / block), F.lit(0))
    high = F.least(F.floor((F.col("x") + halo) / block), F.lit(last))
    spread = columns.withColumn("_block", F.explode(F.sequence(low.cast("int"), high.cast("int"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf["_block"].iloc[0]) * block
        return kernel(pdf.sort_values("x").reset_index(drop=True), lo, min(lo + block, width))

    return spread.groupBy(*by, "_block").applyInPandas(run, schema)


def map_frames(frames: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel over batches of whole frames, no exchange."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield kernel(pdf)

    return frames.mapInPandas(run, schema)
