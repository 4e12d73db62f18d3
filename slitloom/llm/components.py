"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import discard, stored


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least node of each component of (a, b) to its others."""
    node, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(node)))
    return node[label[moved]], node[moved]


def _print(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


#: Edges up to which one task joins all.
ONE_TASK = 4_000_000


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of edges that fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            root, node = spanning(table["a"].to_numpy(), table["b"].to_numpy())
            top = T.distinct(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, top])), pa.array(np.concatenate([root, top]))], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node that
    it is joined to.  Roots are listed too.  Up to ONE_TASK edges one task joins
    them; more need a number of rounds that grows with the logarithm of the
    longest path, and each round's edges are written to the shared folder."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(edges)
    if seen[0] <= ONE_TASK:
        return _at_once(edges)
    while seen[0]:
        before, edges = edges, stored(_small(_large(edges)), "edges")
        discard(before)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    leaf = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaf.unionByName(leaf.select(F.col("root").alias("node"), "root")).distinct()
