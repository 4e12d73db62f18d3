"""Operators on series: fills, trends, flags, lags, lookups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import evaluate, fit_robust
from .quantiles import median


def along(by: Sequence[str], order: str | Column) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order) if by else Window.partitionBy(F.lit(0)).orderBy(order)


def running_median(df: DataFrame, value: str, x: str, half: int, by: Sequence[str] = (), name: str = "trend") -> DataFrame:
    """Median of the rows up to `half` places either side; the window shrinks at the ends."""
    return df.withColumn(name, F.percentile(F.col(value), F.lit(0.5)).over(along(by, x).rowsBetween(-half, half)))


def nearest_fill(df: DataFrame, value: str, x: str, by: Sequence[str] = (), within: int | None = None, name: str = "filled") -> DataFrame:
    """Nulls take the value of the nearest valid place, the lower one of two
    at equal distance; with `within`, only from so near."""
    w = along(by, x)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(value).isNotNull(), F.col(x))
    marked = df.withColumn("_pv", F.last(value, True).over(past)).withColumn("_px", F.last(place, True).over(past))
    marked = marked.withColumn("_nv", F.first(value, True).over(future)).withColumn("_nx", F.first(place, True).over(future))
    back, ahead = F.col(x) - F.col("_px"), F.col("_nx") - F.col(x)
    low = F.col("_px").isNotNull() & (F.col("_nx").isNull() | (back <= ahead))
    found = F.when(low, F.col("_pv")).otherwise(F.col("_nv"))
    if within is not None:
        found = F.when(F.when(low, back).otherwise(ahead) <= within, found)
    return marked.withColumn(name, found).drop("_pv", "_px", "_nv", "_nx")


def bracket_interpolate(df: DataFrame, value: str, x: str, by: Sequence[str] = (), name: str = "interpolated") -> DataFrame:
    """Nulls take the straight line between the valid places that enclose
    them; 0 outside the first and last."""
    w = along(by, x)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(value).isNotNull(), F.col(x))
    pv, px = F.last(value, True).over(past), F.last(place, True).over(past)
    nv, nx = F.first(value, True).over(future), F.first(place, True).over(future)
    marked = df.withColumn("_pv", pv).withColumn("_px", px).withColumn("_nv", nv).withColumn("_nx", nx)
    line = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col(x) - F.col("_px")) / (F.col("_nx") - F.col("_px"))
    both = F.col("_px").isNotNull() & F.col("_nx").isNotNull()
    return marked.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).when(both, line).otherwise(F.lit(0.0))).drop("_pv", "_px", "_nv", "_nx")


def hysteresis(df: DataFrame, severity: str, x: str, high: float, by: Sequence[str] = (), name: str = "flag") -> DataFrame:
    """Flags places above `high` and, joined to them without a break, those
    above 1 + 0.6 (high - 1); the first and last place are flagged only by
    themselves.  Null is not measured: never flagged, and a break."""
    low = 1 + 0.6 * (high - 1)
    w = along(by, x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = F.col(severity)
    seed = F.coalesce(s > high, F.lit(False))
    inner = (F.col(x) > F.first(x).over(whole)) & (F.col(x) < F.last(x).over(whole))
    grows = F.coalesce(s > low, F.lit(False)) & (inner | seed)
    marked = df.withColumn("_seed", seed).withColumn("_on", grows)
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = Window.partitionBy(*by, "_island", "_on")
    return marked.withColumn(name, F.col("_on") & F.max("_seed").over(per)).drop("_seed", "_on", "_island")


def rolling_severity(df: DataFrame, value: str, x: str, half: int, by: Sequence[str] = (), name: str = "severity") -> DataFrame:
    """Rolling median floor over the value: above 1 where the value falls below its surroundings."""
    return running_median(df, value, x, half, by, "_floor").withColumn(name, F.when(F.col(value) > 0, F.col("_floor") / F.col(value))).drop("_floor")


def local_minima(df: DataFrame, value: str, x: str, reach: int, by: Sequence[str] = (), name: str = "minimum") -> DataFrame:
    """Whether a place lies strictly below all `reach` places on each side; ends never do."""
    w = along(by, x)
    v = F.col(value)
    ok = F.lit(True)
    for d in range(1, reach + 1):
        ok = ok & (v < F.lag(value, d).over(w)) & (v < F.lead(value, d).over(w))
    return df.withColumn(name, F.coalesce(ok, F.lit(False)))


def merge_close(df: DataFrame, x: str, depth: str, gap: float, by: Sequence[str]) -> DataFrame:
    """Detections closer than `gap` to the one kept before become one, the
    deeper; each is compared with the survivor, so this is a fold in order of x."""
    item = F.struct(F.col(x).cast("double").alias("x"), F.col(depth).cast("double").alias("depth"))
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.slice("items", 1, 1)
    rest = F.slice("items", F.lit(2), F.greatest(F.size("items") - 1, F.lit(0)))

    def step(kept: Column, one: Column) -> Column:
        last = F.element_at(kept, -1)
        close = one["x"] - last["x"] < gap
        deeper = one["depth"] > last["depth"]
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(one))
        return F.when(close & deeper, swapped).when(close, kept).otherwise(F.concat(kept, F.array(one)))

    folded = rows.select(*by, F.explode(F.aggregate(rest, start, step)).alias("i"))
    return folded.select(*by, F.col("i.x").alias(x), F.col("i.depth").alias(depth))


def drop_adjacent_repeats(df: DataFrame, value: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value differs from the row before."""
    return df.withColumn("_before", F.lag(value).over(along(by, x))).where(~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def running_hold(df: DataFrame, value: str, gate: Column, x: str, by: Sequence[str] = (), depth: int = 600) -> DataFrame:
    """Least gated value so far (`held`) and the number and mean of the last `depth` gated ones."""
    w = along(by, x)
    own = F.when(gate, F.col(value))
    ordered = df.where(gate)
    recent = along(by, x).rowsBetween(-(depth - 1), 0)
    history = ordered.withColumn("held", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return history.withColumn("n_recent", F.count(own).over(recent)).withColumn("mean_recent", F.avg(own).over(recent))


def lag_pairs(df: DataFrame, x: str, lags: Sequence[int], by: Sequence[str], value: str) -> DataFrame:
    """(by..., x, lag, a, b) of places `lag` apart, gaps allowed: an equi-join, not lead()."""
    left = df.select(*by, F.col(x).alias("x"), F.col(value).alias("a"), F.explode(F.array(*(F.lit(v) for v in lags))).alias("lag"))
    right = df.select(*by, F.col(x).alias("_x"), F.col(value).alias("b"))
    keys = [left[k] == right[k] for k in by]
    joined = left.join(right, [*keys, left["x"] + left["lag"] == right["_x"]])
    return joined.select(*(left[k] for k in by), "x", "lag", "a", "b")


def stencil(df: DataFrame, value: str, x: str, lag: int, by: Sequence[str] = ()) -> DataFrame:
    """df of gap-free x with the values at x -2lag, -lag, +lag, +2lag."""
    w = along(by, x)
    for name, k in (("m2", -2), ("m1", -1), ("p1", 1), ("p2", 2)):
        df = df.withColumn(name, F.lag(value, -k * lag).over(w) if k < 0 else F.lead(value, k * lag).over(w))
    return df


def neighbour_prediction(df: DataFrame, value: str, bad: str, x: str, within: int, by: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """Bad places from up to two good neighbours a side within `within`, by
    Lagrange's polynomial through them; null with fewer than two."""
    cell = F.floor(F.col(x) / within)
    good = df.where(~F.col(bad)).select(*by, F.col(x).alias("gx"), F.col(value).alias("gv"), cell.alias("_cell"))
    wrong = df.where(F.col(bad)).select(*by, F.col(x).alias("_x"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    near = wrong.join(good, [*by, "_cell"]).where(F.abs(F.col("gx") - F.col("_x")) <= within)
    side = Window.partitionBy(*by, "_x", F.col("gx") > F.col("_x")).orderBy(F.abs(F.col("gx") - F.col("_x")))
    kept = near.withColumn("rn", F.row_number().over(side)).where("rn <= 2")
    points = kept.groupBy(*by, "_x").agg(F.array_sort(F.collect_list(F.struct("gx", "gv"))).alias("p"))

    def term(i: Column) -> Column:
        others = F.filter("p", lambda q: q["gx"] != i["gx"])
        return i["gv"] * F.aggregate(others, F.lit(1.0), lambda acc, q: acc * (F.col("_x") - q["gx"]) / (i["gx"] - q["gx"]))

    value_at = F.aggregate(F.transform("p", term), F.lit(0.0), lambda acc, t: acc + t)
    found = points.select(*by, F.col("_x").alias(x), F.when(F.size("p") >= 2, value_at).alias(name))
    return df.join(found, [*by, x], "left")


def gaussian_kernel(sigma: float) -> np.ndarray:
    radius = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def gaussian_join(df: DataFrame, value: str, x: str, n: int, sigma: float, by: Sequence[str] = (), name: str = "smooth") -> DataFrame:
    """Gaussian smoothing of a gap-free series 0..n-1, borders mirrored: the
    series joins itself through the kernel's offsets, no row holds an array."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    taps = F.explode(F.array(*(F.struct(F.lit(i - radius).alias("o"), F.lit(float(k)).alias("k")) for i, k in enumerate(kernel))))
    at = F.col("_x") + F.col("t.o")
    at = F.when(at < 0, -at).when(at > n - 1, 2 * (n - 1) - at).otherwise(at)
    at = F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))
    wanted = df.select(*by, F.col(x).alias("_x"), taps.alias("t")).select(*by, "_x", F.col("t.k").alias("k"), at.alias(x))
    out = wanted.join(df.select(*by, x, value), [*by, x]).groupBy(*by, "_x").agg(F.sum(F.col("k") * F.col(value)).alias(name))
    return out.withColumnRenamed("_x", x)


def moving_quadratic(df: DataFrame, value: str, x: str, half: int, by: Sequence[str] = (), name: str = "fit") -> DataFrame:
    """Centre value of an unweighted quadratic through the up to `half` places
    on each side of gap-free integer x; at the ends through those there are.
    The value itself where they are fewer than three."""
    own = along(by, x)
    w = own.rowsBetween(-half, half)
    before, after = F.count(value).over(own.rowsBetween(-half, -1)).cast("double"), F.count(value).over(own.rowsBetween(1, half)).cast("double")
    powers = (lambda m: m * (m + 1) / 2, lambda m: m * (m + 1) * (2 * m + 1) / 6, lambda m: F.pow(m * (m + 1) / 2, F.lit(2)), lambda m: m * (m + 1) * (2 * m + 1) * (3 * m * m + 3 * m - 1) / 30)
    s1, s2, s3, s4 = (p(after) + (-1) ** (k + 1) * p(before) for k, p in enumerate(powers))
    s0 = before + after + 1
    # sums of (x' - x)^k v over the window, from moments about 0
    v, at = F.col(value), F.col(x)
    m0, m1, m2 = F.sum(v).over(w), F.sum(v * at).over(w), F.sum(v * at * at).over(w)
    t1, t2 = m1 - at * m0, m2 - 2 * at * m1 + at * at * m0
    top = m0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    bottom = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    return df.withColumn(name, F.when(s0 >= 3, top / bottom).otherwise(v))


def split_half_shrink(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Wiener factor of the mean of two halves: 1 - noise / signal, within 0..1;
    noise is a quarter of the mean squared difference (not centred)."""
    noise = F.avg(F.pow(F.col(a) - F.col(b), F.lit(2))) / 4
    signal = F.var_pop((F.col(a) + F.col(b)) / 2)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.least(F.greatest(1 - noise / signal, F.lit(0.0)), F.lit(1.0)).alias("shrink"))


def evidence(df: DataFrame, modes: dict[str, float], width: int, by: Sequence[str] = ()) -> DataFrame:
    """Whether any mode exceeds its limit in max(width div 120, 12) places or more."""
    need = max(width // 120, 12)
    counts = [F.count_if(F.abs(F.col(m)) > limit).alias(f"n_{m}") for m, limit in modes.items()]
    any_ = F.lit(False)
    for m in modes:
        any_ = any_ | (F.col(f"n_{m}") >= need)
    return df.groupBy(*by).agg(*counts).withColumn("evident", any_)


def detrended(df: DataFrame, value: str, x: str, by: Sequence[str] = (), name: str = "residual") -> DataFrame:
    """(by..., x, name): the series without its robust line, one task a series."""
    types = dict(df.dtypes)
    plain = df.select(*by, x, F.col(value).cast("double").alias(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, v = pdf[x].to_numpy(float), pdf[value].to_numpy(float)
        line = fit_robust(at[np.isfinite(v)], v[np.isfinite(v)], 1)
        return pdf[[*by, x]].assign(**{name: v - (evaluate(line, at) if line is not None else 0.0)})

    schema = ", ".join([*(f"{c} {types[c]}" for c in (*by, x)), f"{name} double"])
    return plain.groupBy(*by).applyInPandas(run, schema)


def medians(df: DataFrame, value: str, by: Sequence[str], least: int, name: str) -> DataFrame:
    """(by..., name): median of groups of more than `least` values, else null."""
    return df.groupBy(*by).agg(F.when(F.count(value) > least, median(F.col(value))).alias(name))
