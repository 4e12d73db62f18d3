"""The array kernels that the scan pipeline runs, as queries with SQL.

The image is the grid of `acquisition` (hours x 16 rows, mean values) without
gaps: a place without events has 0.  One image is one task, as a scan is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import motion as M
from ..functions import numeric as N
from ..functions import photometry as P
from ..functions import restore as X
from ..functions import scalar as S
from ..functions import spectrum as Z
from ..operators import lookups as L
from ..operators import series as R
from .acquisition import _GRID, _PIX, _round, grid, load, pixels
from .outputs import strip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_IMG = f"{_GRID}, wide as (select max(x) + 1 as w from grid), img as (select i.x, j.y, coalesce(g.v, 0.0) as v from (select unnest(range(0, (select w from wide)::int))::int as x) i cross join (select unnest(range(0, 16))::int as y) j left join grid g on g.x = i.x and g.y = j.y)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def on_image(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray], names: tuple[str, ...] = ("x", "y", "v")) -> DataFrame:
    """kernel(image (16, width)) as rows: of an image (x, y, v), of a series (x, v)."""
    cells = grid(spark, sf_dir).select("x", "y", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((16, int(pdf["x"].max()) + 1))
        img[pdf["y"], pdf["x"]] = pdf["v"]
        out = np.asarray(kernel(img), float)
        at = np.indices(out.shape)[::-1]
        return pd.DataFrame({c: a.ravel() for c, a in zip(names, [*at, out], strict=True)})

    schema = ", ".join(f"{c} int" for c in names[:-1]) + f", {names[-1]} double"
    return cells.groupBy().applyInPandas(run, schema)


def _clean(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounded, with ties of exact binary fractions moved off the middle, and no -0."""
    return df.withColumns({n: S.rounded(F.col(n) + 1e-9, digits) + 0.0 for n in names})


def _mirrored(i: str, n: str) -> str:
    return f"least(greatest(case when {i} < 0 then -({i}) when {i} > {n} - 1 then 2 * ({n} - 1) - ({i}) else {i} end, 0), {n} - 1)"


def _taps(weights: dict[int, float]) -> str:
    return "(select unnest([" + ", ".join(map(str, weights)) + "]) as o, unnest([" + ", ".join(f"{w!r}::double" for w in weights.values()) + "]) as k)"


def _gauss(sigma: float) -> dict[int, float]:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return {o: float(w) for o, w in zip(range(-r, r + 1), k / k.sum(), strict=True)}


def _smoothed(source: str, name: str, weights: dict[int, float]) -> str:
    """CTEs: source (x, y, v) filtered along x, then y, borders mirrored."""
    t = _taps(weights)
    return (
        f"{name}1 as (select a.x, a.y, sum(t.k * b.v) as v from {source} a cross join {t} t join {source} b on b.y = a.y and b.x = {_mirrored('a.x + t.o', '(select w from wide)')} group by a.x, a.y), "
        f"{name} as (select a.x, a.y, sum(t.k * b.v) as v from {name}1 a cross join {t} t join {name}1 b on b.x = a.x and b.y = {_mirrored('a.y + t.o', '16')} group by a.x, a.y)"
    )


@query(f"with {_IMG}, {_smoothed('img', 's', _gauss(1.0))} select x, y, round(v + 1e-9, 6) + 0.0 as v from s")
def kernel_blur(spark, sf_dir):
    return _clean(on_image(spark, sf_dir, lambda img: N.blur(img, 1.0)), "v")


@query(f"with {_IMG}, {_smoothed('img', 's', {-2: 1 / 16, -1: 4 / 16, 0: 6 / 16, 1: 4 / 16, 2: 1 / 16})} select x, y, round(img.v - s.v + 1e-9, 6) + 0.0 as v from s join img using (x, y)")
def kernel_finest_plane(spark, sf_dir):
    return _clean(on_image(spark, sf_dir, lambda img: img - X.b3_smooth(img, 1)), "v")


@query(f"with {_IMG}, {_smoothed('img', 's', _gauss(2.0))} select count(*) as n, round(avg(pow(img.v - s.v, 2)), 6) as energy from s join img using (x, y) where x % 2 = 0 and y % 2 = 0")
def high_frequency_energy(spark, sf_dir):
    fine = on_image(spark, sf_dir, lambda img: (img - N.blur(img, 2))[::2, ::2])
    return _round(fine.agg(F.count("*").alias("n"), F.avg(F.col("v") * F.col("v")).alias("energy")), "energy")


@query(
    f"with {_IMG}, d as (select x, y, case when y between 1 and 14 then (lead(v) over w - lag(v) over w) / 2 else 0 end as d from img window w as (partition by x order by y)) "
    "select x, y, round(case when y between 1 and 14 then 0.25 * lag(d) over w + 0.5 * d + 0.25 * lead(d) over w else 0 end + 1e-9, 6) + 0.0 as v from d window w as (partition by x order by y)"
)
def kernel_column_slope(spark, sf_dir):
    return _clean(on_image(spark, sf_dir, M.column_slope), "v")


@query(
    f"with {_IMG}, s as (select x, y, least(greatest(x + 0.3, 0), (select w from wide) - 1) as px, least(greatest(y * 0.9 + 0.25, 0), 15) as py from img), f as (select *, least(floor(px), (select w from wide) - 2)::int as x0, least(floor(py), 14)::int as y0 from s) "
    "select f.x, f.y, round((a.v * (1 - (px - x0)) + b.v * (px - x0)) * (1 - (py - y0)) + (c.v * (1 - (px - x0)) + d.v * (px - x0)) * (py - y0) + 1e-9, 6) + 0.0 as v from f "
    "join img a on a.x = x0 and a.y = y0 join img b on b.x = x0 + 1 and b.y = y0 join img c on c.x = x0 and c.y = y0 + 1 join img d on d.x = x0 + 1 and d.y = y0 + 1"
)
def kernel_bilinear(spark, sf_dir):
    def sample(img: np.ndarray) -> np.ndarray:
        y, x = np.indices(img.shape)
        return N.bilinear(img, x + 0.3, y * 0.9 + 0.25)

    return _clean(on_image(spark, sf_dir, sample), "v")


@query(f"with {_IMG}, d as (select y, abs(v) as a, v - 2 * lag(v) over w + lag(v, 2) over w as d from img window w as (partition by y order by x)) select y as x, round(median(abs(d)) / (0.67449 * sqrt(6.0)) / avg(a) + 1e-9, 6) + 0.0 as noise from d group by y")
def kernel_row_noise(spark, sf_dir):
    return _clean(on_image(spark, sf_dir, lambda img: [Z.row_noise(r) for r in img], ("x", "noise")), "noise")


@query(
    f"with {_IMG}, r as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from img), t as (select 0.35 * min(v) as t from r where i = floor(0.8 * (n - 1) + 0.5)) "
    "select x, round(case when count(*) filter (where v > t) > 3 then median(v) filter (where v > t) end, 6) as flux from img, t group by x"
)
def kernel_column_flux(spark, sf_dir):
    out = on_image(spark, sf_dir, lambda img: P.column_flux(img, 3), ("x", "flux"))
    return _round(out.withColumn("flux", F.when(~F.isnan("flux"), F.col("flux"))), "flux")


def _loess(source: str, half: int, rounds: int, name: str) -> str:
    """CTEs: local quadratics of source (x, v) reweighted by each window's own residuals."""
    out = [f"{name}p as (select a.x as i, (b.x - a.x) / {half}.0 as d, b.v, greatest(pow(1 - pow(abs(b.x - a.x) / {half + 1}.0, 3), 3), 1e-6) as base from {source} a join {source} b on abs(b.x - a.x) <= {half})", f"{name}w0 as (select i, d, v, base, base as w from {name}p)"]
    for k in range(rounds + 1):
        out.append(f"{name}m{k} as (select i, sum(w) s0, sum(w * d) s1, sum(w * d * d) s2, sum(w * d * d * d) s3, sum(w * d * d * d * d) s4, sum(w * v) t0, sum(w * v * d) t1, sum(w * v * d * d) t2, count(*) filter (where w > 0) as n from {name}w{k} group by i)")
        det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
        out.append(
            f"{name}c{k} as (select i, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {det} as c0, (s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / {det} as c1, "
            f"(s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / {det} as c2 from {name}m{k})"
        )
        if k < rounds:
            out.append(f"{name}r{k} as (select i, d, v, base, v - (c0 + d * (c1 + d * c2)) as r from {name}p join {name}c{k} using (i))")
            out.append(f"{name}s{k} as (select i, 4.685 * 1.4826 * greatest(median(abs(r)), 1e-9) as s from {name}r{k} group by i)")
            out.append(f"{name}w{k + 1} as (select i, d, v, base, base * case when abs(r / s) < 1 then pow(1 - pow(r / s, 2), 2) else 0 end as w from {name}r{k} join {name}s{k} using (i))")
    return ", ".join([*out, f"{name} as (select i as x, c0 as v from {name}c{rounds})"])


_SERIES = f"{_PIX}, f as (select x, median(v) as v from pix group by x)"


def on_series(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], value: str, name: str) -> DataFrame:
    """kernel over the values of (x, value) in order of x, NaN for null; one task a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        return pd.DataFrame({"x": pdf["x"], name: kernel(pdf[value].to_numpy(float))})

    return df.select("x", F.col(value).cast("double").alias(value)).groupBy().applyInPandas(run, f"x int, {name} double")


@query(f"with {_SERIES}, {_loess('f', 20, 3, 'l')} select x, round(v, 4) as trend from l")
def kernel_loess(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    return _round(on_series(f, lambda v: N.loess(v, 41), "v", "trend"), "trend", digits=4)


_GAUSS3 = _taps(_gauss(3.0))


@query(
    f"with {_SERIES}, wide as (select max(x) + 1 as w from f), {_loess('f', 60, 3, 'l')}, m as (select x, median(v) over (order by x rows between 4 preceding and 4 following) as v from f), "
    f"g as (select a.x, sum(t.k * b.v) as v from m a cross join {_GAUSS3} t join m b on b.x = {_mirrored('a.x + t.o', '(select w from wide)')} group by a.x), top as (select greatest(max(v), 1e-9) as t from l), "
    "d as (select x, least(greatest((g.v / t - 0.35) / 0.2, 0), 1) * (case when l.v > 1e-9 then least(greatest(f.v / l.v, 0.7), 1.06) - 1 else 0 end) as d from f join l using (x) join g using (x), top) "
    "select x, round(1 + sign(d) * greatest(abs(d) - 0.012, 0), 6) as gain from d"
)
def kernel_transparency_gains(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    return _round(on_series(f, P.transparency_gains, "v", "gain"), "gain")


def _line(source: str, rounds: int) -> str:
    """CTEs: a line through source (x, v) reweighted by Tukey's biweight."""
    out = [f"w0 as (select x, v, 1.0::double as w from {source})"]
    for k in range(rounds + 1):
        out.append(f"c{k} as (select (sum(w) * sum(w * x * v) - sum(w * x) * sum(w * v)) / (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) as b, sum(w * x) / sum(w) as mx, sum(w * v) / sum(w) as mv from w{k})")
        out.append(f"r{k} as (select x, v, v - (mv + b * (x - mx)) as r from {source}, c{k})")
        if k < rounds:
            out.append(f"w{k + 1} as (select x, v, case when abs(r / s) < 1 then pow(1 - pow(r / s, 2), 2) else 0 end as w from r{k}, (select 4.685 * greatest(1.4826 * median(abs(r)), 1e-9) as s from r{k}))")
    return ", ".join(out)


@query(f"with {_SERIES}, {_line('f', 4)} select x, round(r + 1e-9, 5) + 0.0 as residual from r4")
def robust_line_detrended(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    return _clean(R.detrended(f, "v", "x"), "residual", digits=5)


@query(
    f"with {_PIX}, s as (select y, count(*) s0, sum(x / 720.0) s1, sum(pow(x / 720.0, 2)) s2, sum(pow(x / 720.0, 3)) s3, sum(pow(x / 720.0, 4)) s4, sum(v) t0, sum(v * x / 720.0) t1, sum(v * pow(x / 720.0, 2)) t2 from pix group by y), "
    "d as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as det from s) "
    "select y, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det, 4) as c0, round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det, 4) as c1, "
    "round((s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det, 4) as c2 from d"
)
def kernel_polynomial_fit(spark, sf_dir):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = N.fit_polynomial(pdf["x"].to_numpy() / 720.0, pdf["v"].to_numpy(), 2)
        return pd.DataFrame({"y": pdf["y"].iloc[:1], "c0": c[:1], "c1": c[1:2], "c2": c[2:3]})

    return _round(pixels(spark, sf_dir).groupBy("y").applyInPandas(run, "y int, c0 double, c1 double, c2 double"), "c0", "c1", "c2", digits=4)


@query(
    f"with recursive {_PIX}, f as (select y, x, max(v) as v from pix group by y, x), n as (select *, row_number() over (partition by y order by x) as k from f), "
    "t as (select y, k, x::double as x, v, 1 as g from n where k = 1 union all select n.y, n.k, case when n.x - t.x >= 5 or n.v > t.v then n.x::double else t.x end, case when n.x - t.x >= 5 or n.v > t.v then n.v else t.v end, case when n.x - t.x >= 5 then t.g + 1 else t.g end from t join n on n.y = t.y and n.k = t.k + 1) "
    "select y, arg_max(x, k) as x, arg_max(v, k) as v from t group by y, g"
)
def merge_close_detections(spark, sf_dir):
    f = pixels(spark, sf_dir).groupBy("y", "x").agg(F.max("v").alias("v"))
    return R.merge_close(f, "x", "v", 5.0, ["y"])


@query(f"with {_IMG}, s as (select i.x, j.y, v from (select unnest(range(0, 60))::int as x) i, (select unnest(range(0, 8))::int as y) j, img where img.x = i.x * (select w from wide) // 60 and img.y = j.y * 16 // 8), e as (select min(v) as low, max(v) as high from s) select x, y, round_even(255 * (v - low) / greatest(high - low, 1e-9), 0) + 0.0 as v from s, e")
def thinned_strip(spark, sf_dir):
    return on_image(spark, sf_dir, lambda img: strip(img, 60, 8))


_BINS = [0.0, 4.0, 9.0, 15.0, 24.0, 40.0]


@query(
    "with l as (select l_orderkey, l_linenumber, l_quantity as q, l_discount as d, l_tax as t, cast(l_discount * 650000 as int) as code, l_discount * 60 - 3 as z from lineitem), e as (select *, 1 / (1 + 0.3275911 * abs(z)) as k from l) "
    f"select l_orderkey, l_linenumber, cast(list_position({_BINS}::double[], list_aggregate(list_transform({_BINS}::double[], lambda b: {{'d': abs(q - b), 'b': b}}), 'min').b) - 1 as int) as bin, "
    "round((code / 65535.0 * 2 - 1) * 1.5, 6) as velocity, cast(floor(least(greatest(((code / 65535.0 * 2 - 1) * 1.5 + 1.5) * 65535.0 / 3.0 + 1e-6, 0), 65535)) as int) as code, "
    "round(sign(z) * (1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-z * z)), 6) + 0.0 as erf, "
    "round(greatest(least(greatest(z / 2, -1), 1), 0), 6) + 0.0 as red, round(greatest(-least(greatest(z / 2, -1), 1), 0), 6) + 0.0 as blue, "
    "round(2 / 1.2 * sqrt(greatest(1.2 * q + 0.375 * 1.44 + 4, 0)), 6) as stable, round(sign(z) * greatest(abs(z) - 0.5, 0), 6) + 0.0 as soft, "
    "round(abs(cos(asin(6562.8 / (2 * (1e7 / (1200 + 24 * q)) * cos(radians(17)))) - radians(17))) * (1e7 / (1200 + 24 * q)) * (2.4 * 1 / 1000.0) / 125, 6) as dispersion, "
    "timestamp '2024-01-01' + to_microseconds(cast(q * 3600000000 as bigint)) as at from e"
)
def more_scalar_functions(spark, sf_dir):
    q, z, code = F.col("l_quantity"), F.col("l_discount") * 60 - 3, F.round(F.col("l_discount") * 650000).cast("int")
    red, blue = S.diverging(z, F.lit(2.0))
    ticks = (F.lit(638396640000000000) + F.round(q * 3600 * 10_000_000).cast("bigint")).cast("bigint")
    velocity = S.code_to_velocity(code)
    return load(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        L.nearest_bin(q, _BINS).alias("bin"),
        S.rounded(velocity, 6).alias("velocity"),
        F.floor(S.clamp((velocity + 1.5) * 65535.0 / 3.0 + 1e-6, 0, 65535)).cast("int").alias("code"),
        (S.rounded(S.erf(z), 6) + 0.0).alias("erf"),
        (S.rounded(red, 6) + 0.0).alias("red"),
        (S.rounded(blue, 6) + 0.0).alias("blue"),
        S.rounded(S.anscombe(q, 1.2, 2.0), 6).alias("stable"),
        (S.rounded(S.soft_threshold(z, 0.5), 6) + 0.0).alias("soft"),
        S.rounded(S.dispersion(F.lit(2.4), F.lit(1), 1200 + 24 * q, F.lit(125.0), 34.0, 1, F.lit(6562.8)), 6).alias("dispersion"),
        S.ticks_to_timestamp(ticks).alias("at"),
    )


