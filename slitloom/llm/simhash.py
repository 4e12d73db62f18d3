"""Near duplicates by SimHash, compared bit-sliced.

A document's signature has 256 bits: each is the majority, over the document's
distinct words, of one bit of the word's hash.  Two documents are near copies
if their signatures differ in at most `radius` bits, and groups are the
connected components of that relation; the least doc_id of a group stays.

Candidates come from `tables` keys of `key_bits` sampled bits, as many as it
takes for a pair at the radius itself to share one with chance RECALL, whatever
the number of documents.  Inside a bucket of up to SMALL signatures the bits in
which each pair differs are counted, those of the second half only where the
first is within the radius.  The signatures of a larger bucket are kept as bit
planes (64 documents to a word), the distances of many pairs grow together in
carry-save counters, and a block of 64 pairs is dropped once all of its counters
exceed the radius.  A bucket of more than LARGE signatures is dealt to several
tasks, two parts of it at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import PART_BYTES, keyed_texts, load, map_text, parts, stored, without
from .components import components, spanning

BITS = 256
RADIUS = 46
#: Least sampled bits of a key, and the chance that a pair at the radius shares one.
KEY_BITS = 16
RECALL = 0.9
#: Signatures of a bucket that one task compares.
LARGE = 1 << 15
_SIG = [f"s{i}" for i in range(BITS // 64)]
_SALTS = np.random.default_rng(7).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)
#: Bucket sizes up to this are compared by shifts of the sorted signatures, larger ones query by query.
SMALL = 1024
#: Pairs compared at once by a shift; bounds what a task holds.
SHIFTED = 1 << 15
#: Pairs that a task finds before it keeps only those that join the same signatures.
ENOUGH = 1 << 21
#: Pairs of 64-document blocks and queries that are compared at once.
QUERIES = 256


def signatures(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(signature as (n, 4) uint64, number of distinct words) of each text."""
    if len(col) >= 1 << 16:  # a text's number has 16 bits of a key
        pieces = [signatures(col.slice(i, 1 << 15)) for i in range(0, len(col), 1 << 15)]
        return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))
    h, first, *_ = T.words(col)
    n = len(first) - 1
    own = T.owners(first)
    key = T.distinct((own.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    own = (key >> np.uint64(48)).astype(np.int64)
    count = np.bincount(own, minlength=n)
    sums = np.zeros((n, BITS), np.int32)
    step = 1 << 15
    for i in range(0, len(key), step):
        word, owner = key[i : i + step] & np.uint64((1 << 48) - 1), own[i : i + step]
        hashed = np.stack([T.mix(word ^ s) for s in _SALTS], 1)
        bit = np.unpackbits(hashed.view(np.uint8), axis=1)
        # runs of one document and of 255 words at most, so that bytes can hold the sums
        new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        length = np.diff(np.r_[new, len(owner)])
        pieces = -(-length // 255)
        base = np.repeat(new, pieces)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = base + 255 * nth
        part = np.add.reduceat(bit, cut, axis=0, dtype=np.uint8)
        where = owner[cut]
        head = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        sums[where[head]] += np.add.reduceat(part, head, axis=0, dtype=np.int32)
    majority = sums * 2 > count[:, None]
    return np.packbits(majority, axis=1).view(np.uint64).reshape(n, BITS // 64), count


def to_planes(sig: np.ndarray) -> np.ndarray:
    """(BITS, ceil(n / 64)) words: bit i of a row's words belongs to signature i."""
    n = len(sig)
    bit = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(n, -1), axis=1)
    out = np.packbits(np.ascontiguousarray(bit.T), axis=1, bitorder="little")
    pad = -out.shape[1] % 8
    return np.pad(out, ((0, 0), (0, pad))).view(np.uint64)


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return (a & b) | (half & c), half ^ c


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is more than the radius."""
    more, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for level in range(len(counter) - 1, -1, -1):
        c = counter[level]
        if radius >> level & 1:
            equal = equal & c
        else:
            more = more | (equal & c)
            equal = equal & ~c
    return more


def near(rows, radius: int, blocks: int) -> np.ndarray:
    """Lanes (as words) at a distance of at most radius.  rows(p, live) gives
    the differing bits of plane p for the blocks still alive."""
    levels = BITS.bit_length()
    live = np.arange(blocks)
    result = np.zeros(blocks, np.uint64)
    counter = [np.zeros(blocks, np.uint64) for _ in range(levels)]
    for p in range(0, BITS, 8):
        x = [rows(p + j, live) for j in range(8)]
        twos_a, ones = _csa(counter[0], x[0], x[1])
        twos_b, ones = _csa(ones, x[2], x[3])
        fours_a, twos = _csa(counter[1], twos_a, twos_b)
        twos_a, ones = _csa(ones, x[4], x[5])
        twos_b, ones = _csa(ones, x[6], x[7])
        fours_b, twos = _csa(twos, twos_a, twos_b)
        carry, fours = _csa(counter[2], fours_a, fours_b)
        counter[0], counter[1], counter[2] = ones, twos, fours
        for level in range(3, levels):
            counter[level], carry = counter[level] ^ carry, counter[level] & carry
        done = p + 8
        if done > radius and done % 32 == 0 or done == BITS:
            lane = ~_exceeds(counter, radius)
            if done == BITS:
                result[live] = lane
                break
            alive = np.flatnonzero(lane)
            if len(alive) < len(live):
                live = live[alive]
                counter = [c[alive] for c in counter]
                if not len(live):
                    break
    return result


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def bucket_pairs(sig: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one bucket within the radius: all of them in
    buckets up to SMALL rows, and enough to join the same rows in larger ones."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(bucket)])
    rank = np.arange(len(bucket)) - np.repeat(start, size)
    of = np.repeat(size, size)
    word = np.ascontiguousarray(sig[order].T)
    half = len(word) // 2
    apart = lambda words, a, b: sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int16) for w in words)
    rows = np.flatnonzero(of <= SMALL)
    for shift in range(1, int(min(SMALL, size.max(initial=0)))):
        rows = rows[rank[rows] + shift < of[rows]]
        if not len(rows):
            break
        for i in range(0, len(rows), SHIFTED):
            a = rows[i : i + SHIFTED]
            bits = apart(word[:half], a, a + shift)
            some = np.flatnonzero(bits <= radius)
            a = a[some]
            a = a[bits[some] + apart(word[half:], a, a + shift) <= radius]
            if len(a):
                yield order[a], order[a + shift]
    for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = order[s : s + n]
        planes = to_planes(sig[rows])
        width = planes.shape[1]
        label = np.arange(n)
        tail = np.zeros(width, np.uint64)
        tail[:] = ~np.uint64(0)
        if n % 64:
            tail[-1] = np.uint64((1 << (n % 64)) - 1)
        step = max(1, min(QUERIES, (1 << 16) // width))
        for q in range(0, n, step):
            many = min(step, n - q)
            bit = np.unpackbits(np.ascontiguousarray(sig[rows[q : q + many]]).view(np.uint8).reshape(many, -1), axis=1)
            flip = np.where(bit, ~np.uint64(0), np.uint64(0))

            def rows_of(p, live, flip=flip, width=width, planes=planes):
                return planes[p][live % width] ^ flip[:, p][live // width]

            found = near(rows_of, radius, many * width).reshape(many, width) & tail
            for k in range(many):
                hit = _lanes(found[k], n)
                have = label[hit]
                low = have.min()
                if (have != low).any():
                    for other in np.unique(have):
                        if other != low:
                            label[label == other] = low
        moved = np.flatnonzero(label != np.arange(n))
        if len(moved):
            yield rows[label[moved]], rows[moved]


def plan_tables(n: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, number of keys) for n signatures.  Key bits grow with the
    logarithm of n, so that a bucket's chance members stay some 2**10; the
    number of keys follows, so that the recall at the radius does not change."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(2, n))) - 10)
    share = math.prod((BITS - radius - i) / (BITS - i) for i in range(bits))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, duplicate_of, distance): every document but the least of each
    group of near copies, the one that stays, and the bits in which their
    signatures differ (they may exceed the radius along a chain of copies).

    Null and empty texts, and texts without a word, have no signature and are
    never copies; one of any length has the signature of all its words.  Rows
    that repeat a doc_id count as one document, and a null doc_id is in no
    group.  An empty table gives no rows; other columns are ignored.  Ties don't
    arise: the least doc_id stays."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig, count = signatures(batch.column("text"))
        has = np.flatnonzero(count)
        cols = [batch.column("doc_id").take(pa.array(has))] + [pa.array(T.signed(sig[has, i])) for i in range(BITS // 64)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *_SIG])

    schema = "doc_id bigint, " + ", ".join(f"{s} bigint" for s in _SIG)
    signed = stored(map_text(keyed_texts(docs), sign, schema), "simhash")
    reps = signed.groupBy(*_SIG).agg(F.min("doc_id").alias("rep"))
    n = signed.count()
    bits, many = plan_tables(n, radius)
    sampled = np.stack([np.random.default_rng(1000 + t).choice(BITS, bits, replace=False) for t in range(many)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.stack([part.column(s).to_numpy(zero_copy_only=False) for s in _SIG], 1).view(np.uint64)
                bit = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8).reshape(len(sig), -1), axis=1)
                weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                for t in range(many):
                    key = T.mix((bit[:, sampled[t]] * weight).sum(1, dtype=np.uint64) * np.uint64(512) + np.uint64(t))
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(key)), part.column("rep"), *(part.column(s) for s in _SIG)], ["bucket", "rep", *_SIG])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = table["bucket"].to_numpy()
        rep = table["rep"].to_numpy()
        sig = np.stack([table[s].to_numpy() for s in _SIG], 1).view(np.uint64)
        del table, held
        order = np.argsort(bucket, kind="stable")
        start = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        size = np.diff(np.append(start, len(order)))
        large = np.flatnonzero(size > LARGE)
        rest = np.ones(len(bucket), bool)
        for s, m in zip(start[large].tolist(), size[large].tolist(), strict=True):
            # every two of its parts meet in some task
            rows = order[s : s + m]
            rest[rows] = False
            parts_ = -(-m // (LARGE // 2))
            for i, j in itertools.combinations(range(parts_), 2):
                both = np.concatenate([rows[i::parts_], rows[j::parts_]])
                key = T.signed(T.mix(bucket[both[:1]].view(np.uint64) + np.uint64(i << 20 | j)))[0]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64())] * 2 + [pa.array(np.full(len(both), key)), pa.array(rep[both]), *(pa.array(T.signed(sig[both, k])) for k in range(len(_SIG)))], _names)
        rest = np.flatnonzero(rest)
        a, b, found = [], [], 0
        for i, j in bucket_pairs(sig[rest], bucket[rest], radius):
            a.append(rep[rest[i]])
            b.append(rep[rest[j]])
            found += len(i)
            if found > ENOUGH:  # a cluster of m copies gives m * m / 2 pairs, and m - 1 of them join it
                x, y = spanning(np.concatenate(a), np.concatenate(b))
                a, b, found = [x], [y], 0
        if a:
            x, y = spanning(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *[pa.nulls(len(x), pa.int64())] * (2 + len(_SIG))], _names)

    key_schema = "bucket bigint, rep bigint, " + ", ".join(f"{s} bigint" for s in _SIG)
    _names = ["a", "b", "bucket", "rep", *_SIG]
    keyed = reps.select("rep", *_SIG).mapInArrow(keys, key_schema)
    pieces = max(parts(docs), -(-n * many * 48 // PART_BYTES))
    edges, todo = None, keyed
    while todo is not None:
        done = stored(todo.repartition(pieces, "bucket").mapInArrow(compare, f"a bigint, b bigint, {key_schema}"), "pairs")
        own = done.where("a is not null").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        todo = done.where("a is null").drop("a", "b")
        todo = None if todo.isEmpty() else todo
    joined = components(edges).select(F.col("node").alias("rep"), "root")
    grouped = signed.join(reps, _SIG).join(joined, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"), *_SIG)
    one = grouped.groupBy("doc_id").agg(F.min("root").alias("root"), *(F.min_by(s, "root").alias(s) for s in _SIG))
    kept = one.where("doc_id = root").select("root", *(F.col(s).alias(f"k{s}") for s in _SIG))
    distance = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"k{s}"))) for s in _SIG[1:]), F.bit_count(F.col(_SIG[0]).bitwiseXOR(F.col(f"k{_SIG[0]}"))))
    return one.where("doc_id <> root").join(kept, "root").select("doc_id", F.col("root").alias("duplicate_of"), distance.cast("int").alias("distance"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group left, that of the least doc_id, all
    columns as they came, whatever their names.  Null, empty and wordless texts
    are no copies and stay, as do rows without an id and all rows that repeat
    the id of one that stays; an empty table stays empty."""
    return without(docs, near_duplicates(docs, radius))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
