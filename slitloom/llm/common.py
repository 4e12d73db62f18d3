"""Plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, stored  # noqa: F401

# freed Arrow buffers go back to the system, not to a pool that a reused worker keeps
pa.set_memory_pool(pa.system_memory_pool())

#: Bytes of a batch on its way to Python, where the session has no other limit.
BATCH_BYTES = 8 << 20
#: Bytes of text that a kernel works on at once; bounds a Python worker's memory whatever the batch.
SLICE_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most limit bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(col.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i in range(n):
        if i > begin and total + sizes[i] > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(sizes[i])
    yield batch.slice(begin)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as by rows: 10,000 long texts are too much for a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow with bounded slices of text."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text only, so that no other column of the caller can clash; rows without an id are left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).where(F.col("doc_id").isNotNull())


def one_row_an_id(plain: DataFrame) -> DataFrame:
    """keyed_texts with one row an id: of rows that repeat an id the longest text,
    of equally long ones the greatest.  Only the texts of such ids are shuffled."""
    twice = stored(plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__twice")), "twice")
    if twice.isEmpty():
        return plain
    side, same = sized(twice), plain["doc_id"] == F.col("__twice")
    best = plain.join(side, same, "left_semi").groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    return plain.join(side, same, "left_anti").unionByName(best)


#: Ids up to this many are sent to every executor (8 bytes each, some 30 in the hash table); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def sized(side: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """A stored table, marked to be broadcast if it has at most `limit` rows."""
    return F.broadcast(side) if side.count() <= limit else side


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids in gone.doc_id; rows whose id is null stay.  The
    texts are only shuffled if the ids are too many to broadcast."""
    key = "__gone_doc_id"
    ids = stored(gone.select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(sized(ids), docs["doc_id"] == F.col(key), "left_anti")


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Bytes of input for each partition of an exchange that feeds Python.
PART_BYTES = 128 << 20


def parts(docs: DataFrame) -> int:
    """Partitions of an exchange that feeds Python: as the session says, and more
    where the tables behind docs are too large for so few."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches sorted by key, cut anew so that no two pieces share a value of it."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= enough:
            table = pa.Table.from_batches(held)
            values = table[key].to_numpy()
            cut = int(np.searchsorted(values, values[-1]))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
            enough = max(rows, 2 * n)
    if held:
        yield pa.Table.from_batches(held)
