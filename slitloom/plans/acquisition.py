"""The array operators as queries over the tabular fixtures, each with SQL.

`events` stands for an acquisition: an hour is a frame (x), `user_id % 16` a
slit row (y), `value` the intensity.  This exercises the operators; it is no
solar data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import images as I
from ..operators import lookups as L
from ..operators import quantiles as Q
from ..operators import series as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_HOUR_SQL = "cast(date_diff('day', date '2024-01-01', cast(ts as date)) * 24 + hour(ts) as int)"
_PIX = f"pix as (select {_HOUR_SQL} as x, cast(user_id % 16 as int) as y, value as v from events)"
_GRID = f"{_PIX}, grid as (select x, y, avg(v) as v, count(*) as n from pix group by x, y)"
_FLUX = f"{_PIX}, flux as (select x, case when count(*) > 30 then median(v) end as value from pix group by x)"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return load(spark, sf_dir, "events").select(hour.cast("int").alias("x"), (F.col("user_id") % 16).cast("int").alias("y"), F.col("value").alias("v"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy("x", "y").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.medians(pixels(spark, sf_dir), "v", ["x"], 30, "value")


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: S.rounded(F.col(n), digits) for n in names})


@query(f"with {_GRID} select x, y, round(v, 6) as v, n from grid")
def frame_grid_mean(spark, sf_dir):
    return _round(grid(spark, sf_dir), "v")


@query(f"with {_PIX}, f as (select y, avg(v) as v, count(*) as n from pix group by y) select y, round(v, 6) as v, n from f")
def axis_mean_profile(spark, sf_dir):
    return _round(pixels(spark, sf_dir).groupBy("y").agg(F.avg("v").alias("v"), F.count("*").alias("n")), "v")


@query(
    f"with {_PIX} select x, list_sort(list(v))[cast(round(0.2 * (count(*) - 1)) as int) + 1] as p20, list_sort(list(v))[cast(round(0.8 * (count(*) - 1)) as int) + 1] as p80, "
    "list_sort(list(v))[cast(round(0.95 * (count(*) - 1)) as int) + 1] as p95 from pix group by x"
)
def nearest_rank_percentile(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).groupBy("x").agg(Q.nearest_rank(v, 20).alias("p20"), Q.nearest_rank(v, 80).alias("p80"), Q.nearest_rank(v, 95).alias("p95"))


@query(f"with {_PIX}, r as (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from pix) select cast(p as double) as p, min(v) as v from r, (select unnest([25, 50, 75, 80, 95]) as p) where i = round(p / 100.0 * (n - 1)) group by p")
def whole_image_percentiles(spark, sf_dir):
    return Q.global_nearest_rank(pixels(spark, sf_dir), "v", [25, 50, 75, 80, 95])


@query(f"with {_FLUX} select x, value from flux")
def column_flux_median(spark, sf_dir):
    return flux(spark, sf_dir)


@query(f"with {_PIX}, f as (select y, x // 24 as d, median(v) as med, max(v) - min(v) as chord from pix group by all) select y, cast(d as int) as d, med, chord from f")
def row_flux_median(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("d", F.floor(F.col("x") / 24).cast("int"))
    return rows.groupBy("y", "d").agg(Q.median(F.col("v")).alias("med"), (F.max("v") - F.min("v")).alias("chord"))


@query(f"with {_PIX}, f as (select x, median(v) as value from pix group by x) select x, median(value) over (order by x rows between 12 preceding and 12 following) as trend from f")
def running_median_trend(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "value")
    return R.running_median(f, "value", "x", 12).select("x", "trend")


_FILL = "fill as (select x, value, last_value(value ignore nulls) over a as pv, last_value(case when value is not null then x end ignore nulls) over a as px, first_value(value ignore nulls) over b as nv, first_value(case when value is not null then x end ignore nulls) over b as nx from flux window a as (order by x rows between unbounded preceding and current row), b as (order by x rows between current row and unbounded following))"


@query(f"with {_FLUX}, {_FILL} select x, case when px is not null and (nx is null or x - px <= nx - x) then pv else nv end as filled from fill")
def nearest_valid_fill(spark, sf_dir):
    return R.nearest_fill(flux(spark, sf_dir), "value", "x").select("x", "filled")


@query(f"with {_FLUX}, {_FILL} select x, case when px is not null and (nx is null or x - px <= nx - x) then case when x - px <= 2 then pv end else case when nx - x <= 2 then nv end end as filled from fill")
def nearest_fill_within_two(spark, sf_dir):
    return R.nearest_fill(flux(spark, sf_dir), "value", "x", within=2).select("x", "filled")


@query(f"with {_FLUX}, {_FILL} select x, round(case when value is not null then value when px is not null and nx is not null then pv + (nv - pv) * (x - px) / (nx - px) else 0.0 end, 6) as interpolated from fill")
def bracket_interpolation(spark, sf_dir):
    return _round(R.bracket_interpolate(flux(spark, sf_dir), "value", "x").select("x", "interpolated"), "interpolated")


@query(f"with {_GRID}, p as (select a.y, g.lag, a.v as a, b.v as b from grid a, (select unnest([1, 2, 4, 8, 16]) as lag) g, grid b where b.x = a.x + g.lag and b.y = a.y) select lag, count(*) as n, round(corr(a, b), 6) as ncc from p group by lag")
def lag_pair_correlation(spark, sf_dir):
    pairs = R.lag_pairs(grid(spark, sf_dir), "x", [1, 2, 4, 8, 16], ["y"], "v")
    return _round(pairs.groupBy("lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ncc")), "ncc")


@query(f"with {_PIX}, h as (select x, avg(case when y < 8 then v end) as a, avg(case when y >= 8 then v end) as b from pix group by x), k as (select * from h where a is not null and b is not null) select count(*) as n, round(least(greatest(1 - avg(pow(a - b, 2)) / 4 / var_pop((a + b) / 2), 0.0), 1.0), 6) as shrink from k")
def split_half_shrink(spark, sf_dir):
    h = pixels(spark, sf_dir).groupBy("x").agg(F.avg(F.when(F.col("y") < 8, F.col("v"))).alias("a"), F.avg(F.when(F.col("y") >= 8, F.col("v"))).alias("b")).where("a is not null and b is not null")
    return _round(R.split_half_shrink(h, "a", "b"), "shrink")


@query(
    f"with {_PIX}, m as (select y, median(v) as med from pix group by y), d as (select y, median(abs(v - med)) * 1.4826 as mad from pix join m using (y) group by y), "
    "k as (select y, v, abs(v - med) <= 3 * mad + 1e-3 * abs(med) + 1 as inside from pix join m using (y) join d using (y)) "
    "select y, round(avg(v) filter (where inside), 6) as mean, count(*) as n, count(*) filter (where not inside) as rejected from k group by y"
)
def mad_reject_mean(spark, sf_dir):
    return _round(Q.robust_mean(pixels(spark, sf_dir), "v", ["y"]), "mean")


@query(f"with {_PIX}, b as (select x // 8 as bx, y // 8 as by_, avg(v) as mean, var_pop(v) as var, count(*) as n from pix group by all) select round(regr_slope(var, mean), 4) as slope, round(regr_intercept(var, mean), 4) as intercept, count(*) as blocks from b where n > 1")
def photon_transfer_line(spark, sf_dir):
    return _round(I.photon_transfer(pixels(spark, sf_dir), 8), "slope", "intercept", digits=4)


_SEV = f"{_PIX}, f as (select x, median(v) as value from pix group by x), sev as (select x, case when value > 0 then median(value) over (order by x rows between 50 preceding and 50 following) / value end as severity from f)"


@query(
    f"with {_SEV}, e as (select x, severity, coalesce(severity > 1.3, false) as seed, coalesce(severity > 1.18, false) and ((x > min(x) over () and x < max(x) over ()) or coalesce(severity > 1.3, false)) as on_ from sev), "
    "i as (select *, sum(case when on_ then 0 else 1 end) over (order by x rows between unbounded preceding and current row) as island from e) "
    "select x, round(severity, 6) as severity, on_ and max(case when seed then 1 else 0 end) over (partition by island, on_) = 1 as flag from i"
)
def burst_hysteresis(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "value")
    sev = R.rolling_severity(f, "value", "x", 50)
    return _round(R.hysteresis(sev, "severity", "x", 1.3).select("x", "severity", "flag"), "severity")


@query(f"with {_PIX}, f as (select x, median(v) as v from pix group by x) select x, v from (select x, v, v < lag(v) over w and v < lag(v, 2) over w and v < lead(v) over w and v < lead(v, 2) over w as low from f window w as (order by x)) where low")
def local_minima_lines(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    return R.local_minima(f, "v", "x", 2).where("minimum").select("x", "v")


@query(
    f"with {_FLUX}, l as (select p_partkey as k, p_retailprice as pos from part), r as (select distinct round(c_acctbal / 10, 1) as place from customer where c_acctbal > 0) "
    "select k, pos, place, round(abs(pos - place), 6) as distance from l, r where abs(pos - place) <= 0.5 qualify row_number() over (partition by k order by abs(pos - place), place) = 1"
)
def nearest_within_tolerance(spark, sf_dir):
    left = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("pos"))
    right = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(S.rounded(F.col("c_acctbal") / 10, 1).alias("place")).distinct()
    return _round(L.nearest_within(left, right, "k", "pos", "place", 0.5).select("k", "pos", "place", "distance"), "distance")


@query(
    "with l as (select event_id as k, floor(epoch(ts))::bigint as pos from events where event_id % 10 = 0), r as (select event_id as listing, floor(epoch(ts))::bigint as stamp from events where event_id % 10 = 5) "
    "select k, stamp, listing from l, r where abs(pos - stamp) <= 600 qualify row_number() over (partition by k order by abs(pos - stamp), listing) = 1"
)
def as_of_reference(spark, sf_dir):
    seconds = F.unix_date(F.col("ts").cast("date")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    e = load(spark, sf_dir, "events").select("event_id", seconds.cast("bigint").alias("s"))
    left = e.where("event_id % 10 = 0").select(F.col("event_id").alias("k"), F.col("s").alias("at"))
    right = e.where("event_id % 10 = 5").select(F.col("event_id").alias("listing"), F.col("s").alias("stamp"))
    return L.as_of_nearest(left, right, "k", "at", "stamp", "listing", 600).select("k", "stamp", "listing")


@query("with c as (select distinct cast(round(l_extendedprice / 100) as double) as v from lineitem), d as (select v, list_min(list_transform([100.0, 350.0, 600.0], lambda z: abs(z - v))) as d_first, list_min(list_transform([200.0, 480.0], lambda z: abs(z - v))) as d_second from c) select * from d where d_first < 15 and d_first < d_second")
def two_list_classification(spark, sf_dir):
    c = load(spark, sf_dir, "lineitem").select(F.round(F.col("l_extendedprice") / 100).cast("double").alias("v")).distinct()
    return L.two_list_distance(c, "v", [100.0, 350.0, 600.0], [200.0, 480.0]).where("d_first < 15 and d_first < d_second")


_THRESH = "t as (select 0.35 * min(v) as threshold from (select v, row_number() over (order by v) - 1 as i, count(*) over () as n from pix) where i = round(0.8 * (n - 1)))"


@query(f"with {_PIX}, {_THRESH} select round(threshold, 9) as threshold from t")
def disk_threshold(spark, sf_dir):
    return _round(Q.relative_threshold(pixels(spark, sf_dir), "v", 80, 0.35), "threshold", digits=9)


@query(f"with {_PIX}, {_THRESH}, s as (select x, count(*) as lit, min(y) as first, max(y) as last from pix, t where v > threshold group by x), g as (select *, max(lit) over () as longest from s) select * from g where lit >= 0.45 * longest and lit >= 12")
def chord_gate(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return I.chord_gate(I.lit_spans(p, Q.relative_threshold(p, "v", 80, 0.35), [], "x", "y"), 0.45, 12)


@query(
    f"with {_FLUX}, g as (select * from flux where value is not null), b as (select x from flux where value is null), "
    "n as (select b.x, g.x as gx, g.value as gv from b join g on abs(g.x - b.x) <= 15 qualify row_number() over (partition by b.x, g.x > b.x order by abs(g.x - b.x)) <= 2), "
    "t as (select i.x, i.gx, i.gv * coalesce((select product((i.x - j.gx) / (i.gx - j.gx)::double) from n j where j.x = i.x and j.gx <> i.gx), 1) as term from n i) "
    "select flux.x, round(case when s.c >= 2 then s.p end, 5) as predicted from flux left join (select x, sum(term) as p, count(*) as c from t group by x) s using (x) where value is null"
)
def neighbour_prediction(spark, sf_dir):
    f = flux(spark, sf_dir).withColumn("bad", F.col("value").isNull())
    out = R.neighbour_prediction(f, "value", "bad", "x", 15).where("bad").select("x", "predicted")
    return _round(out, "predicted", digits=5)


@query(
    f"with {_GRID}, c as (select v, floor(sqrt(pow(x - 360, 2) + pow((y - 7.5) * 45, 2)) / 400 * 4)::int as ring, (((floor((degrees(atan2((y - 7.5) * 45, x - 360))) / 90) + 4) % 4))::int as q from grid), "
    "s as (select ring, q, sum(v) as s, count(*) as n from c where ring between 0 and 3 group by all) select round(max(abs(s / n / (select sum(s) / sum(n) from s) - 1)), 6) as flatness from s"
)
def sector_flatness(spark, sf_dir):
    dx, dy = F.col("x") - 360, (F.col("y") - 7.5) * 45
    out = I.sector_flatness(grid(spark, sf_dir), "v", F.sqrt(dx * dx + dy * dy) / 400, F.degrees(F.atan2(dy, dx)))
    return _round(out, "flatness")


@query(
    f"with {_PIX}, r as (select floor(sqrt(pow(x - 360, 2) + pow((y - 7.5) * 45, 2)) / 16)::int as bin, v from pix), "
    "s as (select bin, count(*) as n, list_sort(list(v))[cast(round(0.45 * (count(*) - 1)) as int) + 1] as sky, list_sort(list(v))[cast(round(0.16 * (count(*) - 1)) as int) + 1] as low from r group by bin) "
    "select bin, sky, round(sky - low, 9) as spread from s where n > 30"
)
def radial_sky_bins(spark, sf_dir):
    dx, dy = F.col("x") - 360, (F.col("y") - 7.5) * 45
    return _round(I.radial_sky(pixels(spark, sf_dir), F.sqrt(dx * dx + dy * dy), 16.0), "spread", digits=9)


@query(f"with {_PIX}, {_THRESH} select round(avg(x), 6) as xc, round(avg(y), 6) as yc, round(sqrt(count(*) / pi()), 6) as r, count(*) as n from pix, t where v > threshold having count(*) >= 500")
def flux_centroid(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return _round(I.flux_disk(p, Q.relative_threshold(p, "v", 80, 0.35)), "xc", "yc", "r")


@query(f"with {_SEV}, m as (select severity - 1 as gain, (severity - 1) / 8 as shift from sev) select count(*) filter (where abs(gain) > 0.05) as n_gain, count(*) filter (where abs(shift) > 0.02) as n_shift, count(*) filter (where abs(gain) > 0.05) >= 12 or count(*) filter (where abs(shift) > 0.02) >= 12 as evident from m")
def evidence_gate(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "value")
    sev = R.rolling_severity(f, "value", "x", 50).select((F.col("severity") - 1).alias("gain"), ((F.col("severity") - 1) / 8).alias("shift"))
    return R.evidence(sev, {"gain": 0.05, "shift": 0.02}, 720)


@query("with o as (select event_id, user_id, value from events where value > 5) select event_id, user_id, min(value) over (partition by user_id order by event_id rows between unbounded preceding and current row) as held, count(*) over w as n_recent, round(sum(value) over w, 2) as sum_recent from o window w as (partition by user_id order by event_id rows between 599 preceding and current row)")
def min_hold_history(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "value")
    out = R.running_hold(e, "value", F.col("value") > 5, "event_id", ["user_id"])
    return out.select("event_id", "user_id", "held", "n_recent", S.rounded(F.col("mean_recent") * F.col("n_recent"), 2).alias("sum_recent"))


@query(
    f"with {_FLUX}, {_FILL}, e as (select x, case when px is not null and (nx is null or x - px <= nx - x) then pv else nv end as v from fill), t as (select x, v, median(v) over (order by x rows between 60 preceding and 60 following) as trend from e) "
    "select x, round(case when abs(g - 1) <= 0.012 then 1 else g end, 6) as gain from (select x, least(greatest(v / trend, 0.7), 1.06) as g from t)"
)
def transparency_gain(spark, sf_dir):
    f = R.nearest_fill(flux(spark, sf_dir), "value", "x").select("x", F.col("filled").alias("v"))
    g = S.clamp(F.col("v") / F.col("trend"), 0.7, 1.06)
    out = R.running_median(f, "v", "x", 60).withColumn("g", g)
    return _round(out.select("x", F.when(F.abs(F.col("g") - 1) <= 0.012, F.lit(1.0)).otherwise(F.col("g")).alias("gain")), "gain")


_TERMS = ["1.0", "u", "w", "u*u", "u*w", "w*w"]
_SUMS = ", ".join([f"round(sum(({_TERMS[i]} * {_TERMS[j]})::double), 4) as a{i}{j}" for i in range(6) for j in range(i, 6)] + [f"round(sum({_TERMS[i]} * v), 3) as b{i}" for i in range(6)])


@query(f"with {_GRID}, k as (select (x - 360) / 360.0 as u, (y - 7.5) / 7.5 as w, v from grid) select {_SUMS} from k")
def gain_surface_moments(spark, sf_dir):
    k = grid(spark, sf_dir).select(((F.col("x") - 360) / 360.0).alias("u"), ((F.col("y") - 7.5) / 7.5).alias("w"), "v")
    out = I.quadratic_moments(k, "u", "w", "v")
    return _round(_round(out, *(c for c in out.columns if c[0] == "a"), digits=4), *(c for c in out.columns if c[0] == "b"), digits=3)


@query("with p as (select l_orderkey, l_linenumber, l_extendedprice / 1e5 as img, l_quantity / 50 as truth from lineitem), f as (select regr_slope(truth, img) as slope, regr_intercept(truth, img) as intercept from p) select round(slope, 6) as slope, round(intercept, 6) as intercept, round(10 * log10(1 / avg(pow(slope * img + intercept - truth, 2))), 6) as psnr from p, f group by slope, intercept")
def intensity_match_psnr(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1e5).alias("img"), (F.col("l_quantity") / 50).alias("truth"))
    return _round(I.intensity_match(p, "img", "truth"), "slope", "intercept", "psnr")


@query(f"with {_GRID} select y, list(round(v, 6) order by x) as row from grid group by y")
def row_transpose(spark, sf_dir):
    return I.to_rows(_round(grid(spark, sf_dir), "v"))


@query("select l_orderkey, l_linenumber, round(2 / 1.2 * sqrt(1.2 * l_extendedprice + 0.375 * 1.44 + 484), 6) as transformed, round(l_extendedprice, 3) as back from lineitem")
def anscombe_roundtrip(spark, sf_dir):
    t = S.anscombe(F.col("l_extendedprice"), 1.2, 22.0)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(t, 6).alias("transformed"), S.rounded(S.anscombe_inverse(t, 1.2, 22.0), 3).alias("back"))


@query(
    "with t as (select l_orderkey, l_linenumber, l_quantity / 50 as t, l_discount * 60 - 3 as z, l_tax * 100 as a from lineitem) select l_orderkey, l_linenumber, round(least(2.6 * t, 1.0), 6) as red, round(pow(t, 1.6), 6) as green, round(0.55 * pow(t, 4), 6) as blue, "
    "round(case when abs(z) < 1e-9 then 1.0 when abs(z) >= 3 then 0.0 else 3 * sin(pi() * z) * sin(pi() * z / 3) / (pi() * z * pi() * z) end, 6) + 0.0 as lanczos, "
    "round(1 + z * (0.5 + z * (-0.25)), 6) as poly, round(sign(z) * greatest(abs(z) - 0.04, 0.0), 6) as dead, round((a * 90 + 180) % 360 - 180, 6) as angle, "
    "cast(floor(least(greatest((z / 2 + 1.5) * 65535.0 / 3, 0), 65535)) as int) as code from t"
)
def scalar_functions(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("t"), (F.col("l_discount") * 60 - 3).alias("z"), (F.col("l_tax") * 100).alias("a"))
    r, g, b = S.halpha_rgb(F.col("t"))
    z = F.col("z")
    return t.select(
        "l_orderkey",
        "l_linenumber",
        S.rounded(r, 6).alias("red"),
        S.rounded(g, 6).alias("green"),
        S.rounded(b, 6).alias("blue"),
        (S.rounded(S.lanczos3(z), 6) + 0.0).alias("lanczos"),
        S.rounded(S.polyval([1, 0.5, -0.25], z), 6).alias("poly"),
        S.rounded(S.deadband(z, 0.04), 6).alias("dead"),
        S.rounded(S.wrap_degrees(F.col("a") * 90), 6).alias("angle"),
        S.quantise16(z / 2, F.lit(-1.5), F.lit(1.5)).alias("code"),
    )


@query("with p as (select l_orderkey, l_linenumber, l_quantity as b, lag(l_quantity) over w as pa, lead(l_quantity) over w as pc from (select l_orderkey, l_linenumber, sum(l_quantity) as l_quantity from lineitem group by all) window w as (partition by l_orderkey order by l_linenumber)) select l_orderkey, l_linenumber, round(case when abs(pa - 2 * b + pc) < 1e-12 then 0.0 else least(greatest(0.5 * (pa - pc) / (pa - 2 * b + pc), -0.75), 0.75) end, 6) as vertex from p where pa is not null and pc is not null")
def parabola_vertex(spark, sf_dir):
    w = R.along(["l_orderkey"], "l_linenumber")
    one = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"))
    p = one.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("b"), F.lag("l_quantity").over(w).alias("a"), F.lead("l_quantity").over(w).alias("c")).where("a is not null and c is not null")
    return p.select("l_orderkey", "l_linenumber", S.rounded(S.parabola_vertex(F.col("a"), F.col("b"), F.col("c"), 0.75), 6).alias("vertex"))


@query("with e as (select unnest(range(1, 65)) - 1 as i, embedding from embeddings), a as (select i, embedding[i + 1]::double as p, embedding from e), b as (select i, p, unnest(range(0, 64)) as j, embedding from a) select cast(i as int) as i, cast(j as int) as j, round(avg(p * embedding[j + 1]::double) - avg(p) * avg(embedding[j + 1]::double), 6) + 0.0 as cov from b where j >= i group by i, j")
def embedding_covariance(spark, sf_dir):
    return I.covariance(load(spark, sf_dir, "embeddings"), "embedding").select("i", "j", (S.rounded(F.col("cov"), 6) + 0.0).alias("cov"))


@query(
    f"with {_PIX}, f as (select x, median(v) as v from pix group by x), b as (select max(x) + 1 as n from f), d as (select i as x, coalesce(v, 0.0) as v from (select unnest(range(0, (select n from b)::int)) as i) left join f on f.x = i), "
    "k as (select o, exp(-0.5 * pow(o / 2.0, 2)) / (select sum(exp(-0.5 * pow(q / 2.0, 2))) from (select unnest(range(-6, 7)) as q)) as k from (select unnest(range(-6, 7)) as o)), "
    "j as (select d.x, k.k, least(greatest(case when d.x + o < 0 then -(d.x + o) when d.x + o > n - 1 then 2 * (n - 1) - (d.x + o) else d.x + o end, 0), n - 1) as m from d, k, b) "
    "select cast(j.x as int) as x, round(sum(j.k * e.v), 6) as smooth from j join d e on e.x = j.m group by j.x"
)
def gaussian_series(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    n = f.agg(F.max("x")).first()[0] + 1
    d = spark.range(n).select(F.col("id").cast("int").alias("x")).join(f, "x", "left").select("x", F.coalesce("v", F.lit(0.0)).alias("v"))
    return _round(R.gaussian_join(d, "v", "x", n, 2.0), "smooth")


@query(f"with {_PIX}, f as (select row_number() over (order by x)::int as x, median(v) as v from pix group by x), d as (select a.x, a.v, b.x - a.x as d, b.v as w from f a join f b on abs(b.x - a.x) <= 5), w as (select x, v, count(*) as s0, sum(d) as s1, sum(d ** 2) as s2, sum(d ** 3) as s3, sum(d ** 4) as s4, sum(w) as t0, sum(w * d) as t1, sum(w * d * d) as t2 from d group by x, v) select x, round(case when s0 < 3 then v else (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) end, 4) as fit from w")
def moving_quadratic(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v")
    f = f.select(F.row_number().over(R.along([], "x")).alias("x"), "v")
    return _round(R.moving_quadratic(f, "v", "x", 5).select("x", "fit"), "fit", digits=4)


@query(f"with {_GRID}, n as (select v, lead(v) over (partition by y order by x) as w, x, y from grid), d as (select abs(w - v) as d from n where w is not null and x % 3 = 1 and y % 4 = 0) select round(1.4826 / sqrt(2) * median(d), 6) as sigma, count(*) as n from d having count(*) >= 100")
def stride_noise(spark, sf_dir):
    w = R.along(["y"], "x")
    d = grid(spark, sf_dir).withColumn("w", F.lead("v").over(w)).where("w is not null and x % 3 = 1 and y % 4 = 0").select(F.abs(F.col("w") - F.col("v")).alias("d"))
    out = d.agg((Q.median(F.col("d")) * (1.4826 / 2**0.5)).alias("sigma"), F.count("*").alias("n")).where("n >= 100")
    return _round(out, "sigma")


@query(f"with {_PIX}, f as (select x, round(median(v)) as v from pix group by x) select x, v from f qualify lag(v) over (order by x) is distinct from v")
def adjacent_repeats_dropped(spark, sf_dir):
    f = R.medians(pixels(spark, sf_dir), "v", ["x"], 0, "v").withColumn("v", F.round("v"))
    return R.drop_adjacent_repeats(f, "v", "x")


@query(f"with {_PIX}, f as (select x, y, v, abs(x - 360) + y as score from pix) select x, max(v) as top, min_by(y, struct_pack(a := v, b := y)) as at_least, max_by(y, struct_pack(a := v, b := y)) as at_most, list_min([abs(100 - avg(v)), abs(300 - avg(v)), abs(500 - avg(v))]) as off from f group by x")
def line_choice(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return p.groupBy("x").agg(
        F.max("v").alias("top"),
        F.min_by("y", F.struct("v", "y")).alias("at_least"),
        F.max_by("y", F.struct("v", "y")).alias("at_most"),
        F.array_min(F.transform(F.array(*(F.lit(float(z)) for z in (100, 300, 500))), lambda z: F.abs(z - F.avg("v")))).alias("off"),
    )


@query(f"with {_PIX}, f as (select y, x, v from pix qualify row_number() over (partition by y order by v desc, x) <= 3) select y, x, v from f")
def deepest_three(spark, sf_dir):
    w = R.along(["y"], F.struct((-F.col("v")).alias("a"), F.col("x").alias("b")))
    return pixels(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("y", "x", "v")


@query(f"with {_PIX}, m as (select x, avg(v) as mean, count(*) as n from pix group by x), p as (select mean as p90 from (select mean, row_number() over (order by mean) - 1 as i, count(*) over () as n from m) where i = floor(0.9 * n)), k as (select x from m, p where mean > 0.4 * p90), c as (select count(*) as c from k) select y, round(avg(v), 6) as v, count(*) as n from pix where (select c from c) <= 50 or x in (select x from k) group by y")
def bright_frame_mean(spark, sf_dir):
    from ..operators.frames import bright_frames

    p = pixels(spark, sf_dir)
    kept = bright_frames(p.groupBy("x").agg(F.avg("v").alias("mean")), "x", "mean")
    return _round(p.join(kept, "x", "left_semi").groupBy("y").agg(F.avg("v").alias("v"), F.count("*").alias("n")), "v")


@query(f"with {_GRID}, s as (select x, y, v, lag(v, 2) over w as m1, lead(v, 2) over w as p1, lag(v, 4) over w as m2, lead(v, 4) over w as p2 from grid window w as (partition by y order by x)) select x, y, round(m2 + p2 - 4 * (m1 + p1) + 6 * v, 5) as bend from s where m2 is not null and p2 is not null")
def five_point_stencil(spark, sf_dir):
    s = R.stencil(grid(spark, sf_dir), "v", "x", 2, ["y"]).where("m2 is not null and p2 is not null")
    return s.select("x", "y", S.rounded(F.col("m2") + F.col("p2") - 4 * (F.col("m1") + F.col("p1")) + 6 * F.col("v"), 5).alias("bend"))


@query("with p as (select o_orderkey as k, o_totalprice / 1000 - 200 as x, (o_orderkey % 1000) / 2.5 - 200 as y from orders) select k, round(abs(x * x + 0.5 * x * y + 2 * y * y - 10 * x + 4 * y - 9000) / sqrt(pow(2 * x + 0.5 * y - 10, 2) + pow(0.5 * x + 4 * y + 4, 2)), 6) as distance from p")
def conic_distance(spark, sf_dir):
    p = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000 - 200).alias("x"), ((F.col("o_orderkey") % 1000) / 2.5 - 200).alias("y"))
    return p.select("k", S.rounded(S.sampson(F.col("x"), F.col("y"), [1, 0.5, 2, -10, 4, -9000]), 6).alias("distance"))
