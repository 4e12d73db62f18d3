"""Benchmark decontamination: rare n-gram seeds, then local alignment.

An item's seeds are all of its n-grams that are rare in the corpus (which of
them an edited copy keeps is not known before): those that at most FREQUENT of
the documents hold.  An item of which fewer than half are rare, since it is
itself in many documents, keeps them all.  Wherever a document holds a seed, the
window in which the item would lie is a candidate; windows with too few of the
item's words for any alignment to reach the threshold are dropped, the others
aligned with it by Smith-Waterman over words (match +2, mismatch -1, gap -1).  A
passage whose score reaches `threshold` of the item's own score, or that of
EXCERPT words, is a copy, also when words were changed, dropped or put in.

The documents are scanned twice, for the n-grams' counts and for the copies,
without a shuffle of text: items go to the executors in groups of at most
`group_words` words, so what is broadcast has a fixed bound; a larger benchmark
takes more groups, each with its own passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import bound_batches, keyed_texts, load, map_text, slices, without

SEED = 3
THRESHOLD = 0.4
#: Shorter items are too short to tell an edited copy from chance: they are sought word for word.
LEAST_WORDS = 8
#: Words of a long item that are a copy, whatever its length.
EXCERPT = 50
#: An n-gram is frequent if more than this share of the documents holds it, and more than so many.
FREQUENT, LEAST_FREQUENT = 0.001, 100
GROUP_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of the alignment matrix that are computed at once.
CELLS = 1 << 20
#: Words of windows that are looked up at once.
SIFTED = 1 << 21


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best local alignment of each pair of rows.

    items (n, a) and windows (n, b) hold word hashes; 0 pads an item and 1 a
    window, which match nothing.  start..end are places in the window.  Of
    equal scores the one that ends in the earliest row and column is taken."""
    n, b = windows.shape
    place = np.arange(1, b + 1, dtype=np.int32)
    score = np.zeros((n, b + 1), np.int32)
    origin = np.broadcast_to(np.arange(b + 1, dtype=np.int32), (n, b + 1)).copy()
    best, begin, finish = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    rows = np.arange(n)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        diagonal = score[:, :-1] + np.where((windows == word) & (word > 1), MATCH, MISMATCH).astype(np.int32)
        up = score[:, 1:] + GAP
        cell = np.maximum(diagonal, up)
        source = np.where(diagonal >= up, origin[:, :-1], origin[:, 1:])
        fresh = cell <= 0
        cell[fresh] = 0
        source[fresh] = np.broadcast_to(place, cell.shape)[fresh]
        # gaps in the item run along the row: a running maximum of score minus their cost
        key = (cell - GAP * place).astype(np.int64) * (b + 2) + (b + 1 - place)
        run = np.maximum.accumulate(key, axis=1)
        reach = (run // (b + 2)).astype(np.int32) + GAP * place
        from_ = b + 1 - (run % (b + 2)).astype(np.int64)
        longer = reach > cell
        score[:, 1:] = np.where(longer, reach, cell)
        origin[:, 1:] = np.where(longer, np.take_along_axis(source, from_ - 1, 1), source)
        top = score[:, 1:].argmax(1)
        value = score[rows, top + 1]
        better = value > best
        best[better], begin[better], finish[better] = value[better], origin[rows, top + 1][better], top[better] + 1
    return best, begin, finish


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """smith_waterman of (item, window) pairs of any lengths, in batches of like sizes."""
    out = np.zeros((3, len(pairs)), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    i = 0
    while i < len(order):
        a = b = 0
        j = i
        while j < len(order):
            x, y = pairs[order[j]]
            if j > i and max(b, len(y)) * (j - i + 1) > CELLS // 8:
                break
            a, b = max(a, len(x)), max(b, len(y))
            j += 1
        items, windows = np.zeros((j - i, a), np.uint64), np.ones((j - i, b), np.uint64)
        for k in range(i, j):
            x, y = pairs[order[k]]
            items[k - i, : len(x)], windows[k - i, : len(y)] = x, y
        out[:, order[i:j]] = smith_waterman(items, windows)
        i = j
    return out[0], out[1], out[2]


class Items:
    """A group of benchmark items: words, and n-grams as seeds.

    Items of fewer words than an n-gram have no seeds; they are kept apart, as
    `whole`, from their words to their ids."""

    def __init__(self, ids: np.ndarray, words: np.ndarray, first: np.ndarray, n: int):
        self.ids, self.words, self.first, self.n = ids, words, first, n
        size = np.diff(first)
        self.whole: dict[tuple[int, ...], list[int]] = {}
        for i in np.flatnonzero((size > 0) & (size < n)).tolist():
            self.whole.setdefault(tuple(words[first[i] : first[i + 1]].tolist()), []).append(int(ids[i]))
        gram, at = T.shingles(words, first, n)
        item = T.owners(first)[at]
        order = np.argsort(gram, kind="stable")
        self._seeds(gram[order], item[order], (at - first[item])[order])
        self.vocabulary = T.distinct(worded(words, T.owners(first)))

    def _seeds(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.gram, self.seed_item, self.seed_place = gram, item, place
        self.seed_gram, self.seed_from, self.seed_many = np.unique(gram, return_index=True, return_counts=True)

    def without(self, frequent: np.ndarray) -> None:
        """Drops the seeds that are among the n-grams given, but for items of which half or more are."""
        gone = np.isin(self.gram, frequent)
        lost = np.bincount(self.seed_item[gone], minlength=len(self.ids))
        all_ = np.bincount(self.seed_item, minlength=len(self.ids))
        keep = ~gone | (2 * lost >= all_)[self.seed_item]
        self._seeds(self.gram[keep], self.seed_item[keep], self.seed_place[keep])

    def need(self, threshold: float) -> np.ndarray:
        """Words that must match, of each item."""
        size = np.diff(self.first)
        return np.where(size < LEAST_WORDS, size, np.minimum(threshold * size, EXCERPT)) - 1e-9


def worded(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Keys of (word, item)."""
    with np.errstate(over="ignore"):
        return T.mix(words + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of keys occur, their place among sorted_keys)."""
    if not len(sorted_keys) or not len(keys):
        z = np.zeros(0, np.int64)
        return z, z
    # most keys are sifted out by 16 of their bits
    sieve = np.zeros(1 << 16, bool)
    sieve[(sorted_keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(sieve[(keys & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.searchsorted(sorted_keys, keys[at])
    place[place == len(sorted_keys)] = 0
    hit = sorted_keys[place] == keys[at]
    return at[hit], place[hit]


def hits_to_windows(items: Items, h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(text, item, from, to) of windows of words in which a seed says an item
    may lie; windows of one text and item that overlap are one."""
    gram, at = T.shingles(h, first, n)
    hit, place = find(items.seed_gram, gram)
    if not len(hit):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    many = items.seed_many[place]
    slot = np.repeat(items.seed_from[place], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    word = np.repeat(at[hit], many)
    text = T.owners(first)[word]
    item, offset = items.seed_item[slot], items.seed_place[slot]
    length = np.diff(items.first)[item]
    slack = 4 + length // 3
    low = np.maximum(word - offset - slack, first[text])
    high = np.minimum(word - offset + length + slack, first[text + 1])
    order = np.lexsort((low, item, text))
    text, item, low, high = text[order], item[order], low[order], high[order]
    # one key a text and item, so that the reach of the windows before grows within it only
    pair = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
    span = len(h) + 1
    reach = np.maximum.accumulate(pair * span + high)
    new = np.r_[True, (pair * span + low)[1:] > reach[:-1]]
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(new)) - 1
    return text[start], item[start], low[start], reach[stop] - pair[stop] * span


def hopeful(items: Items, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Which windows hold enough of the item's words to reach the threshold if all of them matched."""
    need = items.need(threshold)[item]
    size = high - low
    out = np.zeros(len(item), bool)
    begin = 0
    ends = np.cumsum(size)
    while begin < len(item):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SIFTED, "right")))
        n = size[begin:end]
        own = np.repeat(np.arange(end - begin), n)
        word = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[begin:end], n)
        hit, _ = find(items.vocabulary, worded(h[word], item[begin:end][own]))
        out[begin:end] = np.bincount(own[hit], minlength=end - begin) >= need[begin:end]
        begin = end
    return np.flatnonzero(out)


SCHEMA = "doc_id bigint, item_id bigint, score double, start_word int, end_word int"


def _groups(benchmark: DataFrame, n: int, limit: int):
    """Items in groups of at most limit words (one item at least)."""
    ids, texts, held = [], [], 0
    plain = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for row in plain.distinct().orderBy("item_id", "text").toLocalIterator():
        words = len(row["text"]) // 2 + 1
        if texts and held + words > limit:
            yield _items(ids, texts, n)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += words
    if texts:
        yield _items(ids, texts, n)


def _items(ids: list[int], texts: list[str], n: int) -> Items:
    h, first, *_ = T.words(pa.array(texts, pa.large_string()))
    return Items(np.array(ids, np.int64), h, first, n)


def _frequent(plain: DataFrame, items: Items, n: int, limit: float) -> np.ndarray:
    """The items' n-grams that more than `limit` documents hold."""
    group = plain.sparkSession.sparkContext.broadcast(items.seed_gram)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = group.value
        seen = np.zeros(len(grams), np.int64)
        for batch in batches:
            for part in slices(batch):
                h, first, *_ = T.words(part.column("text"))
                gram, at = T.shingles(h, first, n)
                hit, place = find(grams, gram)
                one = T.distinct(T.owners(first)[at[hit]].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
                seen += np.bincount((one & np.uint64((1 << 40) - 1)).astype(np.int64), minlength=len(grams))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["gram", "docs"])

    bound_batches(plain.sparkSession)
    found = plain.select("text").mapInArrow(count, "gram bigint, docs bigint").groupBy("gram").agg(F.sum("docs").alias("docs")).where(F.col("docs") > limit)
    return items.seed_gram[np.array([r["gram"] for r in found.collect()], np.int64)]


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED, threshold: float = THRESHOLD, group_words: int = GROUP_WORDS) -> DataFrame:
    """SCHEMA: documents and the items that they hold a copy of, the alignment's
    share of the item's full score, and the words of the best passage.

    Items of fewer than LEAST_WORDS words must occur word for word, those of
    fewer than n words as the document's only words.  Null and empty texts on
    either side, and those without a word, match nothing; rows without an id
    are left out.  Texts and items of any length are taken whole.  Rows that
    repeat an id give one row for each item, with the best score, then the
    first passage.  An empty table on either side gives no rows; other columns
    are ignored."""
    spark = docs.sparkSession
    plain = keyed_texts(docs)
    limit = max(LEAST_FREQUENT, FREQUENT * docs.count())
    found = None
    for items in _groups(benchmark, n, group_words):
        if len(items.seed_gram):
            items.without(_frequent(plain, items, n, limit))
        elif not items.whole:
            continue
        group = spark.sparkContext.broadcast(items)

        def score(batch: pa.RecordBatch, group=group) -> pa.RecordBatch | None:
            own = group.value
            h, first, *_ = T.words(batch.column("text"))
            rows: list[tuple] = []
            if own.whole:
                for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n)).tolist():
                    rows += [(d, i, 1.0, 0, int(first[d + 1] - first[d])) for i in own.whole.get(tuple(h[first[d] : first[d + 1]].tolist()), [])]
            text, item, low, high = hits_to_windows(own, h, first, n)
            some = hopeful(own, h, item, low, high, threshold)
            if len(some):
                text, item, low, high = text[some], item[some], low[some], high[some]
                got, begin, end = align([(own.words[own.first[i] : own.first[i + 1]], h[a:b]) for i, a, b in zip(item.tolist(), low.tolist(), high.tolist(), strict=True)])
                keep = np.flatnonzero(got >= MATCH * own.need(threshold)[item])
                text, item, at = text[keep], item[keep], low[keep] - first[text[keep]]
                share = np.round(got[keep] / (MATCH * np.diff(own.first)[item]), 6)
                rows += zip(text.tolist(), own.ids[item].tolist(), share.tolist(), (at + begin[keep]).tolist(), (at + end[keep]).tolist(), strict=True)
            if not rows:
                return None
            text, ids, share, start, stop = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(ids, pa.int64()), pa.array(share, pa.float64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc_id", "item_id", "score", "start_word", "end_word"])

        part = map_text(plain, score, SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), F.col("end_word").alias("e"))).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("x.score").alias("score"), (-F.col("x.s")).alias("start_word"), F.col("x.e").alias("end_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a copy of an item, all columns as they came,
    whatever their names.  Null, empty and wordless texts stay, as do rows
    without an id; of rows that repeat an id all go if one of them holds a
    copy.  An empty table on either side leaves docs as they are."""
    return without(docs, leaks(docs, benchmark))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES_BY_NAME = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
