"""Shards of equal bytes, tokens and rows by vector bin packing.

Documents of the same words form a group that stays together, unless it is
more than a shard's even share: then it is dealt to as many groups as it takes.
Documents without a word are groups of their own.  Each group has a vector (bytes, tokens, rows); groups are placed, largest first, on the shard
whose residual capacity has the greatest dot product with it (both in units of
a shard's even share).  A shard that the group would overfill is taken only if
no other has room.

Groups are first spread by hash over cells of `CELL_SHARDS` shards, which are
packed apart and in parallel: nothing about single groups meets on the driver,
and a cell's even share is the corpus's within the spread of its hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V
from .bestfit import VOCAB, measured
from .common import load, sized, stored

#: Bytes of text that a shard should have.
SHARD_BYTES = 64 << 20
CELL_SHARDS = 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of vectors (n, d), in the order given.  Of equal
    dot products the shard of the lower number is taken."""
    share = vectors.sum(0) / shards
    unit = vectors / np.where(share > 0, share, 1)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), np.int64)
    for i, v in enumerate(unit):
        dot = residual @ v
        fits = (residual >= v - 1e-12).all(1)
        k = int(np.where(fits, dot, -np.inf).argmax()) if fits.any() else int(dot.argmax())
        residual[k] -= v
        out[i] = k
    return out


def weighed(docs: DataFrame, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """(doc_id, cluster, n_bytes, n_tokens, n_rows) of each document; a cluster is of the same words."""
    # the rows' sizes come with the words' hash from one scan
    plain = docs.select("doc_id", F.octet_length(F.col("text").cast("string")).cast("string").alias("source"), "text")
    rows = measured(plain, VOCAB, folder)
    rows = rows.withColumn("cluster", F.when(F.col("cluster") == 0, F.xxhash64("doc_id")).otherwise(F.col("cluster")))
    size = F.max(F.coalesce(F.col("source").cast("bigint"), F.lit(0)))
    return rows.groupBy("doc_id").agg(F.max_by("cluster", F.struct("n_tokens", "cluster")).alias("cluster"), size.alias("n_bytes"), F.max("n_tokens").alias("n_tokens"), F.count("*").alias("n_rows"))


def assigned(docs: DataFrame, shard_bytes: int = SHARD_BYTES, cell_shards: int = CELL_SHARDS, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """(doc_id, shard, n_bytes, n_tokens, n_rows) of each document.

    Null and empty texts weigh no bytes and no tokens but a row.  Rows that
    repeat a doc_id are one document, of the bytes and tokens of the longest
    and of as many rows.  A null doc_id is left out; a text of any length is
    weighed whole, and one of more than a shard has a shard that it overfills.
    Groups of equal size are taken by their hash; an empty table gives no
    rows; other columns are ignored."""
    one = stored(weighed(docs, folder), "weighed")
    sums = one.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_bytes", "n_tokens", "n_rows"))).first()
    shards = max(1, math.ceil(sums[0] / shard_bytes))
    cells = max(1, math.ceil(shards / cell_shards))
    per = math.ceil(shards / cells)  # the same in every cell, so that all shards are of one size
    weight = [F.sum("n_bytes").alias("b"), F.sum("n_tokens").alias("t"), F.sum("n_rows").alias("r")]
    # groups above a shard's share, at most three for each shard
    share = F.greatest(*(F.col(c) * (shards / max(total, 1)) for c, total in zip("btr", sums, strict=True)))
    large = one.groupBy("cluster").agg(*weight, F.count("*").alias("n")).where((share > 1) & (F.col("n") > 1) & F.lit(shards > 1))
    large = stored(large.select(F.col("cluster").alias("__large"), F.ceil(share).alias("__pieces")), "large")
    dealt = F.xxhash64("cluster", F.pmod(F.xxhash64("doc_id"), F.col("__pieces")))
    one = one.join(sized(large), F.col("cluster") == F.col("__large"), "left").withColumn("cluster", F.when(F.col("__pieces").isNotNull(), dealt).otherwise(F.col("cluster"))).drop("__large", "__pieces")
    groups = one.groupBy("cluster").agg(*weight)
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("cluster"), F.lit(cells)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        for cell, pdf in pd.concat(held).groupby("cell"):
            v = pdf[["b", "t", "r"]].to_numpy(float)
            size = (v / np.maximum(v.sum(0), 1)).max(1)
            order = np.lexsort((pdf["cluster"].to_numpy(), -size))
            yield pd.DataFrame({"cluster": pdf["cluster"].to_numpy()[order], "shard": int(cell) * per + place(v[order], per)})

    placed = groups.repartition(cells, "cell").mapInPandas(run, "cluster bigint, shard bigint")
    return one.join(placed, "cluster").select("doc_id", "shard", "n_bytes", "n_tokens", "n_rows")


def op9_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op9_vector_sharding": op9_vector_sharding}
