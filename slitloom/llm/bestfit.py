"""Conflict-constrained best-fit packing of documents into sequences.

A sequence (bin) of `capacity` tokens never holds two documents of one source
nor two of one duplicate cluster.  Within a shard of documents the bins are
ordered by residual; each bin carries a bitmap of its sources and one of its
duplicate clusters.  A piece goes to the tightest bin that can take it: the
successor search starts at the piece's own size and goes on through larger
residuals until a bin conflicts with neither bitmap.  Pieces come in
descending size, so this is best-fit decreasing.

Documents longer than a sequence are cut into whole sequences and a rest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from . import vocab as V
from .common import load, map_text, stored

VOCAB = "byte_bpe_50k.tiktoken"
CAPACITY = 4096
#: Documents of a shard, within which bins are filled: at most one bin in a few hundred ends emptier for it.
SHARD_DOCS = 32768
#: A source or cluster of more than this share of a shard's pieces gets an index of the bins that lack it.
HOT = 0.01


def best_fit(size: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece, in the order given; sources and clusters are
    numbered from 0, -1 for none.  Among bins of equal residual any compatible
    one may be taken: the last that came to that residual."""
    n = len(size)
    hot_source = {k for k, c in Counter(source.tolist()).items() if k >= 0 and c > max(4, HOT * n)}
    hot_cluster = {k for k, c in Counter(cluster.tolist()).items() if k >= 0 and c > max(4, HOT * n)}
    # index: key -> (bitset of residuals, residual -> stack of bins that lack the key)
    index: dict = {("s", k): [0, {}] for k in hot_source} | {("c", k): [0, {}] for k in hot_cluster} | {None: [0, {}]}
    keys = list(index)
    residual: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    out = np.empty(n, np.int64)

    def enter(b: int) -> None:
        r = residual[b]
        if r <= 0:
            return
        for key in keys:
            if key is not None and ((sources[b] if key[0] == "s" else clusters[b]) >> key[1] & 1):
                continue
            entry = index[key]
            entry[0] |= 1 << r
            entry[1].setdefault(r, []).append(b)

    for i, (need, s, c) in enumerate(zip(size.tolist(), source.tolist(), cluster.tolist(), strict=True)):
        sbit, cbit = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        key = ("c", c) if c in hot_cluster else ("s", s) if s in hot_source else None
        entry = index[key]
        found = -1
        left = entry[0] >> need << need
        while left:
            r = (left & -left).bit_length() - 1
            stack = entry[1].get(r, [])
            fresh, k = False, len(stack) - 1
            while k >= 0:
                b = stack[k]
                has = (sources[b] if key and key[0] == "s" else clusters[b] if key else 0) >> (key[1] if key else 0) & 1
                if residual[b] != r or has:
                    stack.pop(k)  # it was filled further since
                else:
                    fresh = True
                    if not sources[b] & sbit and not clusters[b] & cbit:
                        found = b
                        break
                k -= 1
            if found >= 0:
                break
            if not fresh:
                entry[0] &= ~(1 << r)
            left = left >> (r + 1) << (r + 1)
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            sources.append(0)
            clusters.append(0)
        residual[found] -= need
        sources[found] |= sbit
        clusters[found] |= cbit
        out[i] = found
        enter(found)
    return out


def pack_shard(pdf: pd.DataFrame, shard: int, capacity: int) -> pd.DataFrame:
    """(doc_id, piece, n_tokens, bin_id) of a shard's documents."""
    pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
    ids, tokens = pdf["doc_id"].to_numpy(), pdf["n_tokens"].to_numpy()
    whole, rest = np.divmod(tokens, capacity)
    cluster = pdf["cluster"].to_numpy()
    source = pdf["source"].to_numpy()
    # each whole sequence of a long document is a bin of its own
    long_id = np.repeat(np.arange(len(ids)), whole)
    nth = np.arange(len(long_id)) - np.repeat(np.cumsum(whole) - whole, whole)
    order = np.flatnonzero(rest > 0)
    order = order[np.lexsort((ids[order], -rest[order]))]
    codes, _ = pd.factorize(pd.Series(source, dtype=object)[order], use_na_sentinel=True)
    many = pd.Series(cluster[order]).value_counts()
    rank = {k: i for i, k in enumerate(many.index[many.to_numpy() > 1])}
    marks = np.array([rank.get(k, -1) for k in cluster[order].tolist()], np.int64)
    bins = best_fit(rest[order], np.asarray(codes, np.int64), marks, capacity)
    base = int(bins.max()) + 1 if len(bins) else 0
    return pd.DataFrame(
        {
            "doc_id": np.concatenate([ids[order], ids[long_id]]),
            "piece": np.concatenate([whole[order], nth]).astype(np.int32),
            "n_tokens": np.concatenate([rest[order], np.full(len(long_id), capacity)]),
            "bin_id": (np.int64(shard) << 32) + np.concatenate([bins, base + np.arange(len(long_id))]),
        }
    )


SCHEMA = "doc_id bigint, piece int, n_tokens bigint, bin_id bigint"


def measured(docs: DataFrame, name: str = VOCAB, folder: str = V.TOKENIZER_DIR, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens); a cluster is the words' hash unless a column gives it."""
    own = F.col(cluster).cast("bigint") if cluster else F.lit(None).cast("bigint")
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), own.alias("given")).where("doc_id is not null")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, *_ = T.words(batch.column("text"))
        with np.errstate(over="ignore"):
            place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
            acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
            same = T.signed(acc[first[1:]] - acc[first[:-1]])
        count = V.token_counts(batch.column("text"), name, folder)
        given = batch.column("given")
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.compute.coalesce(given, pa.array(same)), pa.array(np.asarray(count, np.int64))],
            ["doc_id", "source", "cluster", "n_tokens"],
        )

    return map_text(plain, run, "doc_id bigint, source string, cluster bigint, n_tokens bigint")


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: str | None = None, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """SCHEMA: each document's pieces and the sequence that holds each.

    `piece` numbers a document's parts of `capacity` tokens from 0.  Null and
    empty texts have no tokens and no piece.  Rows that repeat a doc_id count
    once, with the longest text; a null doc_id is left out.  A null source
    conflicts with none.  A text of any length is cut into whole sequences and
    a rest.  Equal sizes are taken by doc_id; an empty table gives no rows;
    other columns are ignored."""
    one = stored(measured(docs, cluster=cluster, folder=folder), "sized")
    one = one.groupBy("doc_id").agg(F.max_by(F.struct("source", "cluster", "n_tokens"), F.struct("n_tokens", "cluster", "source")).alias("x")).select("doc_id", "x.*").where("n_tokens > 0")
    shards = max(1, math.ceil(docs.count() / shard_docs))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            for shard, pdf in pd.concat(held).groupby("shard"):
                yield pack_shard(pdf, int(shard), capacity)

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    return one.withColumn("shard", shard).repartition(shards, "shard").mapInPandas(run, SCHEMA)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op5_best_fit_packing": op5_best_fit_packing}
