"""Importance resampling towards good text, by Gumbel top-k.

Two bag-of-n-gram models over hashed buckets, one of the target (documents
labelled of quality and not toxic) and one of all raw text, give every
document the log ratio of its likelihoods as a weight.  The k documents of
highest weight plus Gumbel noise are a sample without replacement in
proportion to the weights; k is the target's share of the labelled documents,
applied to all.

Tokens are runs of word bytes, case kept, and runs of punctuation; n-grams are
single tokens and pairs, in tables of their own.  A bucket's probabilities are
its shares of all occurrences, and a document's weight is the sum of log ratios
over its own occurrences, whatever its length.  A log ratio is drawn towards 0
by SURE standard errors, so that buckets seen a few times don't tell one text
from another by chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import BROADCAST_IDS, bound_batches, keyed_texts, load, slices, stored

#: Bits of the bucket number of single tokens and of pairs.
UNI_BITS, PAIR_BITS = 20, 18
BUCKETS = (1 << UNI_BITS) + (1 << PAIR_BITS)
#: Buckets in one row of counts.
RANGE = 1 << 14
SURE = 4.0
#: Occurrences after which a task hands its counts on, so that 32 bits hold them.
COUNTED = 1 << 30
SEED = 11

_PUNCT = ~(T.WORD | T.SPACE)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram."""
    raw, offsets = T.buffers(col)
    ws, we = T.spans(raw, offsets, T.WORD)
    ps, pe = T.spans(raw, offsets, _PUNCT)
    start, end = np.concatenate([ws, ps]), np.concatenate([we, pe])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    h = T.span_hashes(raw, start, end)
    first = np.searchsorted(start, offsets)
    own = T.owners(first)
    pair, at = T.shingles(h, first, 2)
    bucket = np.concatenate([h >> np.uint64(64 - UNI_BITS), (pair >> np.uint64(64 - PAIR_BITS)) + np.uint64(1 << UNI_BITS)]).astype(np.int64)
    return bucket, np.concatenate([own, own[at]])


def log_ratios(raw: np.ndarray, target: np.ndarray, raw_total: float, target_total: float, sure: float = SURE) -> np.ndarray:
    """Shrunk log ratio of the target's to the raw model's bucket probabilities, from counts of occurrences."""
    if not raw_total or not target_total:
        return np.zeros(len(raw))
    share = target_total / raw_total
    ratio = np.log((target + 0.5) / (raw + 0.5 / share) / share)
    error = np.sqrt(max(1 - share, 1e-9) / (share * raw + 0.5))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - sure * error)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise that depends on the id and the seed alone."""
    with np.errstate(over="ignore"):
        x = T.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return -np.log(-np.log(((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)))


def targets(labels: DataFrame) -> tuple[DataFrame, float]:
    """(ids of the target's documents, their share of the labelled ids).  An id
    with several labels is of the target if none of them speaks against it."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(good.cast("int")).alias("good"))
    one = stored(one, "labels")
    n, k = one.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    return one.where("good = 1").select("doc_id"), (k / n if n else 1.0)


def _counts(docs: DataFrame, good: DataFrame, n_good: int) -> DataFrame:
    """(part, raw, target): occurrences of each bucket, RANGE buckets a row."""
    key = "__target_doc_id"
    side = good.select(F.col("doc_id").alias(key))
    joined = docs.join(F.broadcast(side) if n_good <= BROADCAST_IDS else side, F.col("doc_id") == F.col(key), "left").select("text", F.col(key).isNotNull().alias("good"))

    def told(raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero(raw.reshape(-1, RANGE).any(1))
        data = [pa.array([x[r * RANGE : (r + 1) * RANGE].tobytes() for r in rows.tolist()], pa.binary()) for x in (raw, target)]
        return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *data], ["part", "raw", "target"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, seen = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for part in slices(batch):
                bucket, own = features(part.column("text"))
                good_ = part.column("good").to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
                target += np.bincount(bucket[good_[own]], minlength=BUCKETS).astype(np.int32)
                seen += len(bucket)
                if seen >= COUNTED:
                    yield told(raw, target)
                    raw, target, seen = np.zeros_like(raw), np.zeros_like(target), 0
        if seen:
            yield told(raw, target)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for part, raw, target in zip(pdf["part"], pdf["raw"], pdf["target"], strict=True):
                have = sums.setdefault(part, np.zeros((2, RANGE), np.int64))
                have[0] += np.frombuffer(raw, np.int32)
                have[1] += np.frombuffer(target, np.int32)
        if sums:
            yield pd.DataFrame({"part": list(sums), "raw": [x[0].tolist() for x in sums.values()], "target": [x[1].tolist() for x in sums.values()]})

    partial = joined.mapInArrow(count, "part int, raw binary, target binary")
    return partial.repartition("part").mapInPandas(add, "part int, raw array<bigint>, target array<bigint>")


def weights(docs: DataFrame, labels: DataFrame, sure: float = SURE, seed: int = SEED) -> tuple[DataFrame, float]:
    """((doc_id, log_weight, noisy) of each document, the target's share)."""
    spark = docs.sparkSession
    bound_batches(spark)
    good, share = targets(labels)
    plain = keyed_texts(docs)
    counts = stored(_counts(plain, good, good.count()), "ngrams")
    total = counts.select(F.aggregate("raw", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("r"), F.aggregate("target", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("t")).agg(F.sum("r"), F.sum("t")).first()
    raw_total, target_total = total[0] or 0, total[1] or 0

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ratio = log_ratios(np.array(row["raw"], float), np.array(row["target"], float), raw_total, target_total, sure)
                some = np.flatnonzero(ratio)
                yield pa.RecordBatch.from_arrays([pa.array(some + row["part"] * RANGE), pa.array(ratio[some])], ["bucket", "ratio"])

    table = np.zeros(BUCKETS)  # of fixed size, whatever the corpus
    for row in counts.mapInArrow(ratios, "bucket bigint, ratio double").toLocalIterator():
        table[row["bucket"]] = row["ratio"]
    shared = spark.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bucket, own = features(part.column("text"))
                weight = np.round(np.bincount(own, weights=shared.value[bucket], minlength=part.num_rows), 6)
                noise = gumbel(part.column("doc_id").to_numpy(zero_copy_only=False), seed)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(np.round(weight + noise, 6))], ["doc_id", "log_weight", "noisy"])

    rows = plain.where("text is not null and text <> ''").mapInArrow(weigh, "doc_id bigint, log_weight double, noisy double")
    return rows.groupBy("doc_id").agg(F.max_by("log_weight", "noisy").alias("log_weight"), F.max("noisy").alias("noisy")), share


def top_k(rows: DataFrame, k: int, score: str = "noisy", key: str = "doc_id") -> DataFrame:
    """The k rows of highest score, ties by least key, without a global sort:
    the k-th score is found digit by digit from counts of its fixed-point form."""
    if k <= 0:
        return rows.limit(0)
    fixed = rows.withColumn("__q", F.round(F.col(score) * 1e6).cast("bigint"))
    low, left = None, k
    for step in (1 << 32, 1 << 16, 1):
        own = fixed if low is None else fixed.where((F.col("__q") >= low) & (F.col("__q") < low + span))
        digit = F.floor(F.col("__q") / step) if low is None else F.floor((F.col("__q") - F.lit(low)) / step)
        found = sorted(((r[0], r[1]) for r in own.groupBy(digit.cast("bigint").alias("d")).count().collect()), reverse=True)
        for d, n in found:
            if n >= left:
                low = d * step + (low or 0)
                break
            left -= n
        else:
            return rows
        span = step
    tied = fixed.where(F.col("__q") == low).orderBy(key).limit(left)
    return fixed.where(F.col("__q") > low).unionByName(tied).drop("__q")


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, noisy) of the sampled documents.

    `share` is the part of the documents with text that is taken; the target's
    share of the labelled ones if it isn't given, and all if none is labelled.
    Null and empty texts and null ids are not sampled; a text without an n-gram
    has weight 0, and one of any length the sum over all of its n-grams.  Rows
    that repeat an id are one document, of the highest weight.  Ties go to the
    least doc_id.  An empty table gives no rows; other columns are ignored."""
    rows, found = weights(docs, labels, seed=seed)
    rows = stored(rows, "weights")
    return top_k(rows, round(rows.count() * (found if share is None else share)))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES_BY_NAME = {"op1_importance_resampling": op1_importance_resampling}
