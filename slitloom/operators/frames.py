"""Frame selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bright_frames(means: DataFrame, x: str, mean: str, share: float = 0.4, least: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x) of frames whose mean exceeds `share` of the 90th percentile
    (element floor(0.9 n) of the sorted means); all if `least` or fewer do."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = means.withColumn("_i", F.row_number().over(whole.orderBy(mean)) - 1).withColumn("_n", F.count("*").over(whole))
    marked = ranked.withColumn("_p", F.max(F.when(F.col("_i") == F.floor(F.col("_n") * 0.9), F.col(mean))).over(whole))
    marked = marked.withColumn("_ok", F.col(mean) > share * F.col("_p"))
    return marked.withColumn("_c", F.sum(F.col("_ok").cast("int")).over(whole)).where((F.col("_c") <= least) | F.col("_ok")).select(*by, x)
