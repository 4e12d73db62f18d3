"""Nearest-match lookups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task of nearest_within gets, about.
ROWS = 250_000


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, place: str, tolerance: float, rank: Sequence[str | Column] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Each left row (named by `key`, at `at`) with the nearest right row within
    `tolerance` of it, first by `rank` (of what right carries) among equals; left
    rows without one drop out.

    Of right only the first row of each place counts, and of left the distinct
    places are looked up: in cells of four tolerances the nearest place below and
    above is the last one seen in either order, so that no place is paired with
    all that are close to it.  What is found is joined to left by its place."""
    kind = left.select(at).union(right.select(place)).schema[0].dataType  # the wider of both
    parts = -(-left.select(F.lit(1)).union(right.select(F.lit(1))).count() // ROWS) or 1

    def cell(v: Column) -> Column:
        return F.floor(v / (4 * tolerance))

    finite = F.abs(F.col("_at").cast("double")) < math.inf  # not null, nor nan
    left = left.withColumn("_at", F.col(at).cast(kind)).where(finite)
    places = right.select(F.col(place).cast(kind).alias("_at"), F.col(place).alias("_place"), *carry).where(finite)
    if rank:
        places = places.withColumn("_rn", F.row_number().over(Window.partitionBy("_at").orderBy(*rank))).where("_rn = 1").drop("_rn")
    else:
        places = places.dropDuplicates(["_at"])
    reach = 1.001 * tolerance  # beyond the rounding of a quotient
    cells = F.array_distinct(F.array(*(cell(F.col("_at") + d) for d in (-reach, 0.0, reach))))
    places = places.select(F.explode(cells).alias("_cell"), "_at", F.lit(0).alias("_side"), F.struct("_place", *carry).alias("_found"))
    asked = left.select("_at").distinct().select(cell(F.col("_at")).alias("_cell"), "_at", F.lit(1).alias("_side"))
    points = asked.unionByName(places, allowMissingColumns=True).repartition(parts, "_cell")
    for name, order in (("_below", F.col("_at").asc()), ("_above", F.col("_at").desc())):
        seen = Window.partitionBy("_cell").orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
        points = points.withColumn(name, F.last("_found", ignorenulls=True).over(seen))

    def off(found: str) -> Column:
        return F.abs(F.col("_at") - F.col(found)["_place"])

    near = F.when(off("_above") < off("_below"), F.array("_above")).when((off("_above") == off("_below")) & (F.col("_above")["_place"] != F.col("_below")["_place"]), F.array("_below", "_above")).otherwise(F.array(F.coalesce("_below", "_above")))
    found = points.where("_side = 1").select("_at", F.explode(near).alias("_found")).where(off("_found") <= tolerance)
    close = left.repartition(parts, "_at").join(found.repartition(parts, "_at").hint("shuffle_hash"), "_at").select(*(c for c in left.columns if c != "_at"), "_found.*")
    close = close.withColumn("_d", F.abs(F.col(at) - F.col("_place")))
    w = Window.partitionBy(key).orderBy("_d", *rank, "_place")
    one = close.repartition(parts, key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.withColumnRenamed("_place", place).withColumnRenamed("_d", "distance")


def as_of_nearest(left: DataFrame, right: DataFrame, key: str, at: str, stamp: str, listing: str, limit: float, carry: Sequence[str] = ()) -> DataFrame:
    """Nearest reference in time within `limit` seconds; of two as near, the one listed first."""
    return nearest_within(left, right, key, at, stamp, limit, rank=[listing], carry=[listing, *carry])


def two_list_distance(df: DataFrame, value: str, first: Sequence[float], second: Sequence[float]) -> DataFrame:
    """df with `d_first` and `d_second`, distances to the nearest of two short lists."""

    def least(items: Sequence[float]) -> Column:
        return F.array_min(F.transform(F.array(*(F.lit(float(v)) for v in items)), lambda c: F.abs(F.col(value) - c)))

    return df.withColumn("d_first", least(first)).withColumn("d_second", least(second))


def nearest_bin(value: Column, bins: Sequence[float]) -> Column:
    """Index of the nearest of a few bins, the first among equals."""
    items = F.array(*(F.struct(F.abs(value - F.lit(float(b))).alias("d"), F.lit(i).alias("i")) for i, b in enumerate(bins)))
    return F.array_min(items)["i"]
