"""Exact order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def nearest_rank(value: Column, p: float) -> Column:
    """Aggregate: the element at index round(p / 100 * (n - 1)) of the sorted
    values; no interpolation, null for an empty group.  For groups that fit a
    task; see global_nearest_rank for whole tables."""
    kept = F.array_sort(F.collect_list(value))
    return F.element_at(kept, (F.round(F.lit(p / 100.0) * (F.count(value) - 1)) + 1).cast("int"))


#: Steps between a group's least and greatest value within each of which ranks are counted apart.
STEPS = 4096


def global_nearest_rank(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., p, value) of whole tables: distinct values are counted in
    parallel, then how many lie below each of STEPS steps of the group's range,
    and the values of a step are ranked among themselves.  No group has to fit
    an array, and no window holds more than a step's distinct values."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("n").alias("_total"))
    with_ends = counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))  # one row
    part = (F.col(value) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    stepped = with_ends.withColumn("_step", F.least(F.floor(part * STEPS), F.lit(STEPS - 1)))
    own = Window.partitionBy(*keys, "_total").orderBy("_step")
    sums = stepped.groupBy(*keys, "_total", "_step").agg(F.sum("n").alias("_in"))
    sums = sums.withColumn("_below", F.sum("_in").over(own) - F.col("_in"))
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in ps)))
    rank = F.round(F.col("p") / 100.0 * (F.col("_total") - 1))
    steps = sums.withColumn("p", wanted).where((rank >= F.col("_below")) & (rank < F.col("_below") + F.col("_in"))).select(*keys, "p", "_step", (rank - F.col("_below")).alias("_rank"))
    inside = stepped.join(steps if keys else F.broadcast(steps), [*keys, "_step"])  # without keys a row for each p
    ranked = inside.withColumn("_upto", F.sum("n").over(Window.partitionBy(*keys, "p").orderBy(value)))
    return ranked.where(F.col("_upto") > F.col("_rank")).groupBy(*keys, "p").agg(F.min(value).alias(value))


def median(value: Column) -> Column:
    """Aggregate: the mean of the two middle values for an even count."""
    return F.percentile(value, F.lit(0.5))


def with_mad(df: DataFrame, value: str, by: Sequence[str], floor: float = 1e-9) -> DataFrame:
    """df with `med` and the scaled median absolute deviation `mad` of its group."""
    centre = df.groupBy(*by).agg(median(F.col(value)).alias("med"))
    joined = df.join(centre, list(by))
    spread = joined.groupBy(*by).agg(F.greatest(median(F.abs(F.col(value) - F.col("med"))) * MAD_SCALE, F.lit(floor)).alias("mad"))
    return joined.join(spread, list(by))


def robust_mean(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """(by..., mean, n, rejected): weighted mean of what lies within
    3 * 1.4826 * MAD + 1e-3 * |median| + 1 of the group's median."""
    marked = with_mad(df, value, by, floor=0.0)
    inside = F.abs(F.col(value) - F.col("med")) <= 3 * F.col("mad") + 1e-3 * F.abs(F.col("med")) + 1
    w = F.col(weight) if weight else F.lit(1.0)
    return marked.groupBy(*by).agg(
        (F.sum(F.when(inside, F.col(value) * w)) / F.sum(F.when(inside, w))).alias("mean"),
        F.count("*").alias("n"),
        F.sum(F.when(inside, 0).otherwise(1)).alias("rejected"),
    )


def relative_threshold(df: DataFrame, value: str, p: float, share: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold): a share of the nearest-rank percentile of all pixels."""
    return global_nearest_rank(df, value, [p], by).select(*by, (F.col(value) * share).alias("threshold"))
