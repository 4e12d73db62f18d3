"""Fuzzy repeated passages by collinear chaining.

1. Seeds: the minimizers of runs of K words (one in any W consecutive runs).
2. Every place of a seed is joined to the seed's first place, so that a seed of
   m places gives m links and not their square.  Mostly that place is in the
   passage's source.  Where steps 3 and 4 find no passage over a seed, its text
   may be common elsewhere, and the place is joined to the seed's next first
   places and to the PLACES before its own document as well.  Up to 2 * PLACES
   earlier places that is all of them.  Beyond, such places are paired with the
   next of their document, and the pairs are seeds of their own, of about 12,
   then 22, then 44 words.  At the last length the first holder holds a passage
   by itself.  Places that no passage covers even then are compared with all
   earlier places of their seed, however many: by the words around both, on
   the seed's diagonal and, if HALF of a passage's words match there, on one
   other diagonal on each side.  Those that hold a passage there are links too.
3. Links of one pair of documents that lie on one diagonal become segments;
   segments are chained in order, with linear gap costs, by prefix maxima in a
   Fenwick tree.
4. Chains are aligned word by word, and extended at both ends.  Stretches of
   MIN_WORDS words or more that score LEAST_SCORE (+1 a word matched, MISS a
   word not) are passages: a document's copy of text that an earlier one holds.
   Words are compared by 16 bits of their hashes: of words that differ one in
   65,536 counts as matched.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .common import BROADCAST_IDS, bound_batches, keyed_texts, load, map_text, one_row_an_id, parts, sized, slices, stored, whole_groups

K, W = 6, 10
#: Places of a seed, first ones and last ones, that a later place is joined to.
PLACES = 2
#: How far apart the seeds are that are paired where a seed has more places and none gives a passage.
STEPS = (1, 2, 4)
MIN_WORDS = 40
#: Cost of a word that a chain skips on either side, in words covered.
GAP_COST = 0.1
#: Chains are cut where they skip more words than this.
MAX_GAP = 64
#: Words between the seeds that are kept of a word that is repeated over and over.
APART = 32
#: Words aligned beyond both ends of a chain.
REACH = 48
MISS = -2
LEAST_SCORE = 10
#: Words that must match for a stretch to have MIN_WORDS words and LEAST_SCORE.
LEAST_MATCHED = -(-(LEAST_SCORE - MISS * MIN_WORDS) // (1 - MISS))
#: Words that must match near a seed on its diagonal for others to be tried: one of two diagonals has so many.
HALF = -(-LEAST_MATCHED // 2)
#: Words on each side of a seed that another diagonal may reach.
SIDE = REACH + MAX_GAP
#: Places of a seed of which one least document is kept for equal words; of more, one for every LARGE // 2.
LARGE = 1 << 13
#: So many of these parts of a seed's places go to a task together, and meet those of one other task.
TOGETHER = 4
#: Places of a seed up to this are compared pair by pair, more in blocks of about so many pairs.
FEW, BLOCK = 48, 1 << 16
#: Where more than one in DENSE pairs share their word, all are compared.
DENSE = 32
#: Bits that tell which words stand on one side of a place.
BITS = 1 << 11
#: Documents to be cut, up to which their cuts are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CUTS = 200_000


class Fenwick:
    """Prefix maxima of (value, item) under point updates."""

    def __init__(self, n: int):
        self.n, self.best = n, [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: float, item: int) -> None:
        i += 1
        while i <= self.n:
            if value > self.best[i][0]:
                self.best[i] = (value, item)
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """The best of places before i."""
        found = (-np.inf, -1)
        while i > 0:
            if self.best[i][0] > found[0]:
                found = self.best[i]
            i -= i & -i
        return found


def chain(b: list[int], a: list[int], n: list[int], cost: float = GAP_COST) -> list[list[int]]:
    """Chains of segments (b, a, length), as lists of their numbers in order.

    The best chain's score is the words it covers less the cost of the words
    skipped on both sides; every segment belongs to one chain at most: when
    two chains share their beginning, the one of higher score has it all and
    the other starts where they part."""
    m = len(b)
    order = sorted(range(m), key=lambda i: (b[i], a[i]))
    ends = sorted({a[i] + n[i] for i in order})
    tree = Fenwick(len(ends))
    score, parent = [0.0] * m, [-1] * m
    pending = sorted(order, key=lambda i: b[i] + n[i])
    at = 0
    for i in order:
        while at < m and b[pending[at]] + n[pending[at]] <= b[i]:
            j = pending[at]
            tree.put(bisect_right(ends, a[j] + n[j]) - 1, score[j] + cost * (b[j] + n[j] + a[j] + n[j]), j)
            at += 1
        value, j = tree.top(bisect_right(ends, a[i]))
        gain = value - cost * (b[i] + a[i])
        score[i], parent[i] = (n[i] + gain, j) if gain > 0 else (float(n[i]), -1)
    used = [False] * m
    out = []
    for i in sorted(range(m), key=lambda i: (-score[i], b[i], a[i])):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = parent[i]
        if path:
            out.append(path[::-1])
    return out


def segments(doc: np.ndarray, src: np.ndarray, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (document, source, place in each) merged along diagonals where
    seeds overlap or nearly touch: (doc, src, b, a, words), sorted."""
    order = np.lexsort((b, b - a, src, doc))
    doc, src, b, a = doc[order], src[order], b[order], a[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1]) | (b[1:] - b[:-1] > W)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    doc, src, sb, sa, n = doc[start], src[start], b[start], a[start], b[last] + K - b[start]
    order = np.lexsort((sa, sb, src, doc))
    return doc[order], src[order], sb[order], sa[order], n[order]


def chains_of(doc: np.ndarray, src: np.ndarray, b: np.ndarray, a: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, source, segments) of every chain, cut at gaps over MAX_GAP."""
    if not len(doc):
        return
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])])
    stop = np.append(start[1:], len(doc))
    bl, al, nl = b.tolist(), a.tolist(), n.tolist()
    for s, e, d, r in zip(start.tolist(), stop.tolist(), doc[start].tolist(), src[start].tolist(), strict=True):
        if e - s == 1:
            yield d, r, [(bl[s], al[s], nl[s])]
            continue
        for path in chain(bl[s:e], al[s:e], nl[s:e]):
            part: list[tuple[int, int, int]] = []
            for i in path:
                x = (bl[s + i], al[s + i], nl[s + i])
                if part and max(x[0] - part[-1][0] - part[-1][2], x[1] - part[-1][1] - part[-1][2]) > MAX_GAP:
                    yield d, r, part
                    part = []
                part.append(x)
            yield d, r, part


def match_words(x: np.ndarray, y: np.ndarray, seg: list[tuple[int, int, int]]) -> np.ndarray:
    """For each word of x the place in y of the word aligned with it, or -1."""
    out = np.full(len(x), -1, np.int64)

    def diagonal(b: int, a: int, n: int) -> None:
        skip = max(0, -b, -a)
        b, a, n = b + skip, a + skip, n - skip
        n = min(n, len(x) - b, len(y) - a)
        if n > 0:
            same = np.flatnonzero(x[b : b + n] == y[a : a + n])
            out[b + same] = a + same

    b0, a0, _ = seg[0]
    diagonal(b0 - REACH, a0 - REACH, REACH)
    b1 = a1 = None
    for b, a, n in seg:
        if b1 is not None and b > b1 and a > a1:
            if b - b1 == a - a1:
                diagonal(b1, a1, b - b1)
            else:
                for i, j, size in SequenceMatcher(None, x[b1:b].tolist(), y[a1:a].tolist(), autojunk=False).get_matching_blocks():
                    out[b1 + i : b1 + i + size] = np.arange(a1 + j, a1 + j + size)
        diagonal(b, a, n)
        b1, a1 = b + n, a + n
    diagonal(b1, a1, REACH)
    return out


def stretches(hit: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Best-scoring stretches (+1 matched, MISS not) of LEAST_SCORE and `least`
    words, found one after another in what the better ones leave."""
    out, todo = [], [(0, len(hit))]
    while todo:
        s, e = todo.pop()
        if e - s < least:
            continue
        acc = np.concatenate([[0], np.cumsum(np.where(hit[s:e], 1, MISS))])
        low = np.minimum.accumulate(acc)
        end = int((acc - low).argmax())
        begin = int(acc[: end + 1].argmin())
        if acc[end] - acc[begin] < LEAST_SCORE:
            continue  # nor does anything else here
        if end - begin >= least:
            out.append((s + begin, s + end))
        todo += [(s, s + begin), (s + end, e)]
    return sorted(out)


SCHEMA = "doc_id bigint, start_word int, end_word int, source_id bigint, source_start int, source_end int, matched int"
_CHAIN = "doc_id bigint, src bigint, b0 int, a0 int"
_REQUEST = f"at bigint, kind int, {_CHAIN}, lo int, hi int, payload binary"
_SEED = "hash bigint, doc_id bigint, pos int, open boolean"
_LINK = "doc_id bigint, b int, hash bigint, open boolean, " + ", ".join(f"s{j} bigint, a{j} int" for j in range(2 * PLACES))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _joined(seeds: DataFrame, n: int) -> DataFrame:
    """_LINK: the places of each seed that an earlier document has too, with its
    first places (s0 the very first) and its last before this document.  Places
    that are not open get no links; they are listed, for longer seeds to be made
    of them, if PLACES others come before."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)]
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0])
            h, doc, pos, free = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, _names(_SEED), strict=True))
            row = np.arange(len(h))
            new = np.r_[True, h[1:] != h[:-1]]
            head = np.maximum.accumulate(np.where(new, row, 0))
            mine = np.maximum.accumulate(np.where(new | np.r_[True, doc[1:] != doc[:-1]], row, 0))
            at = np.flatnonzero((row >= old) & (free & (mine > head) | (row - head >= PLACES)))
            begin, end, linked = head[at], mine[at], free[at]
            cols = []
            for k in range(2 * PLACES):
                first = k < PLACES
                place = begin + k if first else end - 1 - (k - PLACES)
                none = ~(linked & ((place < end) if first else (place >= begin + PLACES)))
                cols += [pa.array(x[np.where(none, 0, place)], mask=none) for x in (doc, pos)]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), pa.array(h[at]), pa.array(linked), *cols], _names(_LINK))
            # of a seed that goes on: its first places, those before its last document, and that one's last
            s, m, e = int(head[-1]), int(mine[-1]), len(h)
            keep = np.unique(np.r_[s : min(s + PLACES, e), max(s, m - PLACES) : m + 1, max(m, e - PLACES) : e])
            held = [h[keep], doc[keep], pos[keep], free[keep]]

    return seeds.repartition(n, "hash").sortWithinPartitions("hash", "doc_id", "pos").mapInArrow(link, _LINK)


def _lengthened(late: DataFrame, n: int, step: int) -> DataFrame:
    """_SEED: each place paired with the one `step` places on in its document; open if both are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)]
        for batch in batches:
            h, doc, pos, free = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, ("hash", "doc_id", "b", "open"), strict=True))
            held = [x[max(0, len(h) - step) :] for x in (h, doc, pos, free)]
            some = np.flatnonzero((doc[step:] == doc[:-step]) & (pos[step:] - pos[:-step] <= step * MAX_GAP))
            if len(some):
                g, _ = T.shingles(np.stack([h[some], h[some + step]], 1).ravel().view(np.uint64), np.arange(len(some) + 1) * 2, 2)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(g)), pa.array(doc[some]), pa.array(pos[some]), pa.array(free[some] & free[some + step])], _names(_SEED))

    return late.repartition(n, "doc_id").sortWithinPartitions("doc_id", "b", "hash").mapInArrow(run, _SEED)


def _pairs(joined: DataFrame, places: range) -> DataFrame:
    """(doc_id, src, b, a) of the links to the places named."""
    links = F.array(*(F.struct(F.col(f"s{j}").alias("src"), F.col(f"a{j}").alias("a")) for j in places))
    return joined.where(f"s{places[0]} is not null").select("doc_id", "b", F.explode(links).alias("x")).where("x.src is not null").select("doc_id", "x.src", "b", "x.a")


def _uncovered(joined: DataFrame, found: DataFrame) -> DataFrame:
    """joined, open only where no passage found holds the seed's words."""
    ranges = sized(stored(found.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__ranges")), "covered"), BROADCAST_CUTS)
    inside = F.exists("__ranges", lambda r: (r["start_word"] <= F.col("b")) & (F.col("b") + K <= r["end_word"]))
    return joined.join(ranges, F.col("doc_id") == F.col("__doc"), "left").withColumn("open", ~F.coalesce(inside, F.lit(False))).drop("__doc", "__ranges")


def _more_links(joined: DataFrame, n: int) -> DataFrame | None:
    """(doc_id, src, b, a) for the open places: links to the other places of
    their seeds, and those of the longer seeds made of them."""
    loose = stored(joined.where("open and s1 is not null"), "loose")
    if loose.isEmpty():
        return None
    links = _pairs(loose, range(1, 2 * PLACES))
    # longer seeds are of places whose seeds are open somewhere
    open_ = sized(stored(loose.select(F.col("hash").alias("__hash")).distinct(), "open"))
    late = joined.where("s1 is not null or s0 is null").join(open_, F.col("hash") == F.col("__hash"), "left_semi")
    for step in STEPS:
        longer = stored(_joined(_lengthened(late, n, step), n), "links")
        if longer.isEmpty():
            break
        links = links.unionByName(_pairs(longer, range(2 * PLACES)))
        late = longer.where("s1 is not null or s0 is null")
    return links


def _around(texts: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(SIDE + K + SIDE, rows): the words around each place, `before` of which
    come before it.  What is outside of its text is a number of the row's own."""
    rows, wide = len(before), 2 * SIDE + K
    out = np.empty((rows, wide), np.uint16)
    out[:] = (T.mix(np.arange(rows, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)[:, None]
    size = np.minimum(np.diff(first), wide - SIDE + before)
    out.ravel()[_ranges(np.arange(rows) * wide + SIDE - before, size)] = texts[_ranges(first[:-1], size)]
    return np.ascontiguousarray(out.T)


def _matching(words: np.ndarray, doc: np.ndarray, part: np.ndarray, open_: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (i, j) of places of one seed (start[k]..stop[k], sorted by document)
    that have HALF words in common on their diagonal, and how many; i is open and
    in a later document.  Of a seed dealt in two parts, the pairs between them."""
    size = stop - start
    few = np.flatnonzero((size <= FEW) & (size > 1))
    mine = _ranges(start[few], size[few])
    rank, of = mine - np.repeat(start[few], size[few]), mine
    for shift in range(1, int(size[few].max(initial=0))):
        some = rank >= shift
        rank, of = rank[some], of[some]
        i = of[open_[of]]
        i = i[(doc[i - shift] < doc[i]) & ((part[i] < 0) | (part[i] != part[i - shift]))]
        for at in range(0, len(i), BLOCK):
            x = i[at : at + BLOCK]
            same = np.zeros(len(x), np.uint8)
            for w in words:
                same += w[x] == w[x - shift]
            hit = np.flatnonzero(same >= HALF)
            if len(hit):
                yield x[hit], x[hit] - shift, same[hit]
    for s, e in zip(start[size > FEW].tolist(), stop[size > FEW].tolist(), strict=True):
        every = np.arange(s, e)
        sides = [(every, every)] if part[s] < 0 else [(every[part[s:e] == p], every[part[s:e] != p]) for p in np.unique(part[s:e]).tolist()]
        for one, other in sides:
            for i, j, same in _alike(words, one[open_[one]], other):
                good = doc[j] < doc[i]
                if good.any():
                    yield i[good], j[good], same[good]


def _alike(words: np.ndarray, one: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs (i of one, j of other, words in common), j < i, of HALF words in common
    or more.  Where few places share a word it is looked up who does; where
    many do, all are compared."""
    if not len(one) or not len(other):
        return
    n, w = len(other), words[:, other]
    order = np.argsort(w, 1, kind="stable")
    w_sorted = np.take_along_axis(w, order, 1)
    new = np.concatenate([np.ones((len(w), 1), bool), w_sorted[:, 1:] != w_sorted[:, :-1]], 1)
    shared = np.array([(np.diff(np.append(np.flatnonzero(x), n)).astype(np.float64) ** 2).sum() for x in new])
    const = (w == w[:, :1]).all(1) & (words[:, one] == w[:, :1]).all(1)
    dense, rare = np.flatnonzero((shared > n * n / DENSE) & ~const), np.flatnonzero((shared <= n * n / DENSE) & ~const)
    # places of other by (word, place), of all rare columns one after another
    order = order[rare].astype(np.int32).ravel()
    key = w_sorted[rare]
    begin, stop = (np.stack([np.searchsorted(k, words[t, one], side) for k, t in zip(key, rare.tolist(), strict=True)]) if len(rare) else np.zeros((0, len(one)), np.int64) for side in ("left", "right"))
    base = np.arange(len(rare))[:, None] * n
    before = np.searchsorted(other, one)  # those of other that come earlier
    rows = max(1, BLOCK // n)
    for k in range(0, len(one), rows):
        x = one[k : k + rows]
        top = int(before[k + len(x) - 1])
        if not top:
            continue
        same = np.full((len(x), n), const.sum(), np.uint8)
        for t in dense.tolist():
            same[:, :top] += words[t, x][:, None] == w[t, None, :top]
        lo, hi = (z[:, k : k + len(x)] for z in (begin, stop))
        at = order[_ranges((lo + base).ravel(), (hi - lo).ravel())]
        at = at + np.repeat(np.tile(np.arange(len(x)) * n, len(rare)), (hi - lo).ravel())
        np.add.at(same.reshape(-1), at, np.uint8(1))
        hit = np.flatnonzero(same >= HALF)
        i, j = hit // n, hit % n
        good = j < before[k + i]
        yield x[i[good]], other[j[good]], same.reshape(-1)[hit[good]]


class Nearby:
    """Which words stand around each place on either side, by BITS bits."""

    def __init__(self, around: np.ndarray):
        self.sides = []
        for near, all_ in ((slice(SIDE - 1, SIDE - REACH - 1, -1), slice(0, SIDE)), (slice(SIDE + K, SIDE + K + REACH), slice(SIDE + K, None))):
            word = np.ascontiguousarray(around[near].T) % BITS
            held = np.zeros((around.shape[1], BITS // 8), np.uint8)
            for s in range(0, len(held), 4096):
                has = np.zeros((len(held[s : s + 4096]), BITS), bool)
                has[np.arange(len(has)), around[all_, s : s + 4096] % BITS] = True
                held[s : s + 4096] = np.packbits(has, 1, bitorder="little")
            self.sides.append(((word >> 3).astype(np.uint8), np.uint8(1) << (word & 7).astype(np.uint8), held.ravel()))

    def may_bend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether _bent may find a passage: its scores are at most those where a
        word of i counts as matched if j has it anywhere on that side."""
        hits = []
        for byte, bit, held in self.sides:
            hits.append((held[(j * (BITS // 8))[:, None] + byte[i]] & bit[i]) != 0)
        total = sum(np.bitwise_count(h.view(np.uint64)).sum(1, dtype=np.int16) for h in hits)
        # MIN_WORDS words with LEAST_SCORE have so many beside the seed, and what reaches beyond has more
        some = np.flatnonzero(total >= LEAST_MATCHED - K)
        left, right = (np.zeros((REACH + 1, len(some)), np.int8) for _ in range(2))
        for acc, h in ((left, hits[0]), (right, hits[1])):
            step = np.ascontiguousarray(h[some].T).view(np.int8) * np.int8(1 - MISS) + np.int8(MISS)
            for t in range(REACH):
                np.add(acc[t], step[t], out=acc[t + 1])
        beyond = np.maximum(left.max(0, initial=-100) + right[-1].astype(np.int16), left[-1].astype(np.int16) + right.max(0, initial=-100)) >= -K
        later = np.maximum.accumulate(right[::-1], 0)[::-1]
        need = np.maximum(0, MIN_WORDS - K - np.arange(REACH + 1))
        fits = (left + later[need] >= LEAST_SCORE - K).any(0)
        out = np.zeros(len(i), bool)
        out[some] = beyond | fits
        return out


def _hopeful(pairs: Iterator[tuple[np.ndarray, ...]], nearby: Nearby, n: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs (i, j) that may hold a passage, on the diagonal or off it."""
    for i, j, same in pairs:
        for k in range(0, len(i), n):
            x, y = i[k : k + n], j[k : k + n]
            good = same[k : k + n] >= LEAST_MATCHED
            rest = np.flatnonzero(~good)
            good[rest] = nearby.may_bend(x[rest], y[rest])
            if good.any():
                yield x[good], y[good]


def _some(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, n at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in itertools.chain(pairs, [None]):
        held += [pair] if pair else []
        if held and (pair is None or sum(len(x) for x, _ in held) >= n):
            x, y = (np.concatenate(z) for z in zip(*held, strict=True))
            yield from ((x[k : k + n], y[k : k + n]) for k in range(0, len(x), n))
            held = []


def _on_diagonal(hit: np.ndarray) -> np.ndarray:
    """(first, end) of the best stretch of each row of matches, end 0 where a row
    has no passage.  A passage that reaches beyond the row on a side has a score
    of 0 at least within it, and so two thirds of REACH + K words or more."""
    acc = np.concatenate([np.zeros((len(hit), 1), np.int16), np.cumsum(np.where(hit, 1, MISS), 1, dtype=np.int16)], 1)
    low = np.minimum.accumulate(acc, 1)
    end = (acc - low).argmax(1)
    row = np.arange(len(hit))
    begin = np.where(np.arange(acc.shape[1]) <= end[:, None], acc, np.int16(1 << 14)).argmin(1)
    good = (end - begin >= MIN_WORDS) & (acc[row, end] - acc[row, begin] >= LEAST_SCORE) | (hit.sum(1) >= 2 * (REACH + K) // 3)
    for k in np.flatnonzero(~good & (hit.sum(1) >= LEAST_MATCHED) & ((begin >= MIN_WORDS) | (hit.shape[1] - end >= MIN_WORDS))).tolist():
        for s, e in stretches(hit[k])[:1]:
            begin[k], end[k], good[k] = s, e, True
    return np.stack([begin, np.where(good, end, 0)])


def _bent(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(before, after, whether) for columns of words around a seed: the words of x
    before and after the seed that a passage has, if on each side it may leave the
    seed's diagonal for one other."""
    reach = []
    for way, seed in ((-1, SIDE - 1), (1, SIDE + K)):
        straight, best = np.zeros(x.shape[1], np.int8), [np.zeros(x.shape[1], np.int8)]
        other = np.full((2 * MAX_GAP + 1, x.shape[1]), -128, np.int8)
        for t in range(REACH):
            at = seed + way * t
            # y's word is not on the other side of the seed
            lo, hi = (max(-MAX_GAP, -t), MAX_GAP + 1) if way > 0 else (-MAX_GAP, min(MAX_GAP, t) + 1)
            now = other[lo + MAX_GAP : hi + MAX_GAP]
            np.maximum(now, straight, out=now)
            now += (y[at + lo : at + hi] == x[at]).view(np.int8) * np.int8(1 - MISS)
            now += np.int8(MISS)
            straight = straight + np.where(x[at] == y[at], 1, MISS).astype(np.int8)
            best.append(np.maximum(now.max(0), straight))
        reach.append(np.stack(best).astype(np.int16))
    left, right = reach
    n = np.arange(x.shape[1])
    a, b = left.argmax(0), right.argmax(0)
    beyond = np.maximum(left[a, n] + right[-1], left[-1] + right[b, n]) >= -K
    over = left[a, n] + right[-1] >= left[-1] + right[b, n]
    before, after, score = np.where(over, a, REACH), np.where(over, REACH, b), np.full(len(n), -1000)
    for k in range(REACH + 1):
        least = max(0, MIN_WORDS - K - k)
        end = least + right[least:].argmax(0)
        now = K + left[k] + right[end, n]
        more = (now > score) & (now >= LEAST_SCORE)
        before, after, score = np.where(more, k, before), np.where(more, end, after), np.where(more, now, score)
    return np.stack([before, after, (score >= LEAST_SCORE) | beyond])


def _bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(number, place in x, place in y) for columns of words around a seed: where the
    longest run of matches before the seed begins, and the longest after it."""
    out, n = [], np.arange(x.shape[1])
    for begin, low, high in ((SIDE - REACH, 0, SIDE), (SIDE + K, SIDE + K, len(y))):
        run = np.zeros((high - low + 1, len(n)), np.int16)
        best, here, there = np.ones(len(n), np.int16), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for t in range(begin, begin + REACH):
            run[1:] = np.where(y[low:high] == x[t], run[:-1] + 1, 0)
            k = run.argmax(0)
            long = run[k, n]
            more = long > best
            best, here, there = np.where(more, long, best), np.where(more, t + 1 - long, here), np.where(more, low + k - long, there)
        some = np.flatnonzero(best > 1)
        out.append(np.stack([some, here[some] - SIDE, there[some] - SIDE]))
    return np.concatenate(out, 1)


_PAIR = "doc_id bigint, src bigint, b int, a int"


def _rest_links(rest: DataFrame, joined: DataFrame, words: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """_PAIR: of all earlier places of the seeds of rest (doc_id, b, hash), those
    that hold a passage on the diagonal; of those that hold the same words of the
    document around a place, the one in the least document."""
    hot = sized(stored(rest.select(F.col("hash").alias("__hash")).distinct(), "hot"))
    held = joined.join(hot, F.col("hash") == F.col("__hash"), "left_semi")
    # those not listed themselves are among a seed's first places
    firsts = F.explode(F.array(*(F.struct(F.col(f"s{j}").alias("doc_id"), F.col(f"a{j}").alias("b")) for j in range(PLACES)))).alias("x")
    first = held.where("s0 is not null").select("hash", firsts).where("x.doc_id is not null").select("hash", "x.doc_id", "x.b", F.lit(0).alias("open"))
    places = held.select("hash", "doc_id", "b", F.lit(0).alias("open")).unionByName(first).unionByName(rest.select("hash", "doc_id", "b", F.lit(1).alias("open")))
    places = places.groupBy("hash", "doc_id", "b").agg(F.max("open").alias("open"))
    at, b = F.col("doc_id"), F.col("b")
    requests = places.select(at.alias("at"), F.lit(1).alias("kind"), "doc_id", F.col("hash").alias("src"), b.alias("b0"), F.col("open").alias("a0"), F.greatest(F.lit(0), b - SIDE).alias("lo"), (b + K + SIDE).alias("hi"), F.lit(None).cast("binary").alias("payload"))
    requests = stored(requests, "places")
    cut = _cut(requests, words(requests), n).select(F.col("src").alias("hash"), "doc_id", F.col("b0").alias("b"), F.col("a0").alias("open"), "words")
    many = stored(requests.groupBy("src").count().where(F.col("count") > LARGE).select(F.col("src").alias("__src"), F.ceil(F.col("count") / (LARGE // 2)).cast("int").alias("__parts")), "many")
    none = F.lit(-1)
    if many.isEmpty():
        dealt = cut.withColumns({"sub": none, "part": none, "i": none, "j": none})
    else:
        sub = F.pmod(F.xxhash64("doc_id"), F.col("__parts")).cast("int")
        each = lambda x: F.floor(x / TOGETHER).cast("int")
        dealt = cut.join(sized(many), F.col("hash") == F.col("__src"), "left").withColumn("sub", F.coalesce(sub, none)).withColumn("part", each(F.col("sub")))
        # a part meets itself, with no part named, and every other
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("part") < 0, F.array(none)).otherwise(F.sequence(F.lit(0), each(F.col("__parts") - 1)))))
        dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).withColumn("part", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group", 2 * LARGE):
            table = table.combine_chunks()
            doc, b, open_, part, sub = (table[c].to_numpy() for c in ("doc_id", "b", "open", "part", "sub"))
            group = table["group"].to_numpy()
            texts, at = _flat(table["words"], np.uint16)
            around = _around(texts, at, np.minimum(b, SIDE))
            left, right = -np.minimum(b, SIDE), np.diff(at) - np.minimum(b, SIDE)  # words there are, from the place
            near, nearby = slice(SIDE - REACH, SIDE + K + REACH), Nearby(around)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            found: list[np.ndarray] = []
            for i, j in _some(_hopeful(_matching(around[near], doc, part, open_ == 1, start, np.append(start[1:], len(group))), nearby)):
                one, other = around[:, i], around[:, j]
                first, end = _on_diagonal((one[near] == other[near]).T)
                good = np.flatnonzero(end)
                found.append(np.stack([i[good], first[good], end[good], sub[j[good]], j[good]]))
                bent = np.flatnonzero(end == 0)
                if len(bent):
                    before, after, good = _bent(one[:, bent], other[:, bent])
                    bent, before, after = (z[good == 1] for z in (bent, before, after))
                    found.append(np.stack([i[bent], -1 - before, after, sub[j[bent]], j[bent]]))
                if sum(f.shape[1] for f in found) > BLOCK:
                    found = [_least(np.concatenate(found, 1))]
            if found:
                i, first, _, _, j = _least(np.concatenate(found, 1))
                turn = np.flatnonzero(first < 0)
                bends = [_bends(around[:, i[t]], around[:, j[t]]) + np.array([[k], [0], [0]]) for k, t in ((k, turn[k : k + 256]) for k in range(0, len(turn), 256))]
                t, p, q = np.concatenate([np.zeros((3, 0), np.int64), *bends], 1)
                x, y = i[turn[t]], j[turn[t]]
                inside = (p >= left[x]) & (p < right[x]) & (q >= left[y]) & (q < right[y])
                x, y, p, q = (z[inside] for z in (x, y, p, q))
                cols = [np.r_[doc[i], doc[x]], np.r_[doc[j], doc[y]], np.r_[b[i], (b[x] + p).astype(np.int32)], np.r_[b[j], (b[y] + q).astype(np.int32)]]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _names(_PAIR))

    dealt = dealt.select(F.xxhash64("hash", "i", "j").alias("group"), "doc_id", "b", "open", "part", "sub", "words")
    return dealt.repartition(n, "group").sortWithinPartitions("group", "doc_id", "b").mapInArrow(run, _PAIR)


def _least(found: np.ndarray) -> np.ndarray:
    """Of columns (i, first, end, part of j, j), for each of the first four the least j; j follow the documents."""
    found = found[:, np.lexsort(found[::-1])]
    return found[:, np.r_[True, (found[:4, 1:] != found[:4, :-1]).any(0)]] if found.shape[1] else found


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of flat, of `size` items each."""
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size * flat.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(col: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(items, first): those of row i are first[i]..first[i+1]; a null has none."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0].. for size[0] places, then start[1].. and so on."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _chains(links: DataFrame, n: int) -> DataFrame:
    """Requests for the words of both sides of every chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "doc_id"):
            doc, src, b, a, size = segments(*(table[c].to_numpy() for c in ("doc_id", "src", "b", "a")))
            new = np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1])]
            alone = new & np.r_[new[1:], True]
            one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
            paths = list(chains_of(*(x[many] for x in (doc, src, b, a, size))))
            parts_ = np.array([len(seg) for *_, seg in paths], np.int64)
            flat = np.array([x for *_, seg in paths for x in seg], np.int32).reshape(-1, 3)
            head = np.cumsum(parts_) - parts_
            tail = head + parts_ - 1
            doc, src = (np.concatenate([x[one], np.array([p[i] for p in paths], np.int64)]) for i, x in enumerate((doc, src)))
            single = np.stack([b[one], a[one], size[one]], 1).astype(np.int32)
            first, last = np.concatenate([single, flat[head]]), np.concatenate([single, flat[tail]])
            lo, hi = np.maximum(0, first[:, :2] - REACH), last[:, :2] + last[:, 2:] + REACH
            seg = _binary(np.concatenate([single, flat]).ravel(), np.concatenate([np.full(len(one), 3), parts_ * 3]))
            for kind, at, payload in ((1, doc, seg), (2, src, pa.nulls(len(doc), pa.binary()))):
                cols = [pa.array(at), pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(src), pa.array(first[:, 0].copy()), pa.array(first[:, 1].copy()), pa.array(lo[:, kind - 1].copy()), pa.array(hi[:, kind - 1].copy()), payload]
                yield from (pa.RecordBatch.from_arrays([c.slice(i, 20000) for c in cols], _names(_REQUEST)) for i in range(0, len(doc), 20000))

    return links.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, _REQUEST)


def _cut(requests: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """The words that each request asks for, in place of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, text = None, np.zeros(0, np.uint16)  # the document whose words came last
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, at, lo, hi = (batch.column(c).to_numpy() for c in ("kind", "at", "lo", "hi"))
            given = np.flatnonzero(kind == 0)
            flat, first = _flat(batch.column("payload").take(pa.array(given)), np.uint16)
            all_ = np.concatenate([text, flat])
            begin = np.concatenate([[0], len(text) + first[:-1], [len(all_)]])  # of the texts: the one held, and those of the batch
            which = np.cumsum(kind == 0)
            whose = np.concatenate([[at[0] - 1 if owner is None else owner], at[given]])
            some = np.flatnonzero((kind != 0) & (at == whose[which]))
            if len(some):
                base, end = begin[which[some]], begin[which[some] + 1]
                start = np.minimum(base + lo[some], end)
                size = np.minimum(base + hi[some], end) - start
                cols = [batch.column(c).take(pa.array(some)) for c in ("doc_id", "src", "b0", "a0", "kind", "lo")]
                yield pa.RecordBatch.from_arrays([*cols, _binary(all_[_ranges(start, size)], size), batch.column("payload").take(pa.array(some))], _names(_WORDS))
            if len(given):
                owner, text = at[given[-1]], all_[begin[-2] :]

    # a document's words come before the requests for them
    return words.unionByName(requests).repartition(n, "at").sortWithinPartitions("at", "kind").mapInArrow(run, _WORDS)


_WORDS = f"{_CHAIN}, kind int, lo int, words binary, seg binary"


def _aligned(cut: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the first side of a chain whose other side is in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            doc, src, b0, a0, kind, lo = (table[c].to_numpy() for c in _names(_WORDS)[:6])
            open_ = kind[-1] == 1
            held = table.slice(len(doc) - 1).to_batches() if open_ else []
            same = (doc[1:] == doc[:-1]) & (src[1:] == src[:-1]) & (b0[1:] == b0[:-1]) & (a0[1:] == a0[:-1])
            left = np.flatnonzero(same & (kind[:-1] == 1) & (kind[1:] == 2))
            if not len(left):
                continue
            words, first = _flat(table["words"], np.uint16)
            seg, seg_at = _flat(table["seg"], np.int32)
            seg = seg.reshape(-1, 3)
            seg_at //= 3
            many = np.diff(seg_at)[left]
            rows: list[tuple] = []

            def tell(k: int, to: np.ndarray) -> None:
                for s, e in stretches(to >= 0):
                    there = to[s:e][to[s:e] >= 0]
                    rows.append((int(doc[k]), int(lo[k] + s), int(lo[k] + e), int(src[k]), int(lo[k + 1] + there.min()), int(lo[k + 1] + there.max() + 1), len(there)))  # noqa: B023

            # one segment: a chain is a diagonal, and most are soon known to be too short
            one = left[many == 1]
            if len(one):
                x0, x1, y0, y1 = first[one], first[one + 1], first[one + 1], first[one + 2]
                b, a = seg[seg_at[one], 0] - lo[one] + x0, seg[seg_at[one], 1] - lo[one + 1] + y0
                back = np.minimum(np.minimum(b - x0, a - y0), REACH)
                size = np.minimum(np.minimum(x1 - b, y1 - a), seg[seg_at[one], 2] + REACH) + back
                hit = words[_ranges(b - back, size)] == words[_ranges(a - back, size)]
                at = np.cumsum(size) - size
                good = np.flatnonzero(np.add.reduceat(hit, at, dtype=np.int64) >= LEAST_MATCHED) if len(hit) else np.zeros(0, np.int64)
                for i in good.tolist():
                    k = int(one[i])
                    to = np.full(int(x1[i] - x0[i]), -1, np.int64)
                    s, m = int(b[i] - back[i] - x0[i]), int(size[i])
                    on = np.flatnonzero(hit[at[i] : at[i] + m])
                    to[s + on] = int(a[i] - back[i] - y0[i]) + on
                    tell(k, to)
            for k in left[many > 1].tolist():
                path = seg[seg_at[k] : seg_at[k + 1]] - np.array([lo[k], lo[k + 1], 0])
                to = match_words(words[first[k] : first[k + 1]], words[first[k + 1] : first[k + 2]], path.tolist())
                if (to >= 0).sum() >= LEAST_MATCHED:
                    tell(k, to)
            if rows:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _names(SCHEMA))

    keys = _names(_CHAIN)
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, SCHEMA)


def passages(docs: DataFrame) -> DataFrame:
    """SCHEMA: stretches of a document's words that an earlier document (one of
    lesser doc_id) holds too, give or take edits, and where.

    Overlapping stretches from several sources are all listed; of those of the
    same words in the document, the one from the least source.  Null and empty
    texts, and those of fewer than K words, have no seeds; a null doc_id is
    left out.  A text of any length is taken whole.  Rows that repeat a doc_id
    count as one document, of the longest text (of equally long ones the
    greatest).  Repeats within one document are not sought.  An empty table
    gives no rows; other columns are ignored.  Ties between equal alignments
    go to the leftmost."""
    n = parts(docs)
    plain = one_row_an_id(keyed_texts(docs))

    def seed(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, *_ = T.words(batch.column("text"))
        g, at = T.minimizers(h, first, K, W)
        own = T.owners(first)[at]
        # of a row of equal seeds (a word over and over) one in APART words, each a seed of its own
        new = np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1])][: len(g)]
        nth = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]) // APART
        keep = np.flatnonzero(new | np.r_[True, nth[1:] != nth[:-1]][: len(g)])
        g, at, own, nth = g[keep], at[keep], own[keep], nth[keep].astype(np.uint64)
        g = np.where(nth > 0, T.mix(g + nth), g)
        return pa.RecordBatch.from_arrays([pa.array(T.signed(g)), batch.column("doc_id").take(pa.array(own)), pa.array((at - first[own]).astype(np.int32)), pa.array(np.ones(len(g), bool))], _names(_SEED))

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, *_ = T.words(batch.column("text"))
        size = np.diff(first).astype(np.int32)
        payload = _binary((h >> np.uint64(48)).astype(np.uint16), size)
        zero, none = pa.array(np.zeros(len(size), np.int32)), pa.nulls(len(size), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), zero, none, none, zero, zero, zero, pa.array(size), payload], _names(_REQUEST))

    def words(requests: DataFrame) -> DataFrame:
        """Those of the documents asked for, where these are few."""
        asked = stored(requests.select(F.col("at").alias("__at")).distinct(), "asked")
        few = asked.count() <= BROADCAST_IDS
        return map_text(plain.join(F.broadcast(asked), F.col("doc_id") == F.col("__at"), "left_semi") if few else plain, spell, _REQUEST)

    def aligned(links: DataFrame, few: bool) -> DataFrame:
        requests = stored(_chains(links, n), "chains")
        return _aligned(_cut(requests, words(requests) if few else map_text(plain, spell, _REQUEST), n), n)

    joined = stored(_joined(map_text(plain, seed, _SEED), n), "links")
    found = stored(aligned(_pairs(joined, range(1)), False), "passages")
    links = _more_links(_uncovered(joined, found), n)
    if links is not None:
        found = found.unionByName(stored(aligned(links, True), "passages"))
        # places with more before them than those linked
        rest = stored(_uncovered(joined.where(f"s{2 * PLACES - 1} is not null"), found).where("open").select("doc_id", "b", "hash"), "rest")
        if not rest.isEmpty():
            found = found.unionByName(aligned(_rest_links(rest, joined, words, n), True))
    least = F.min(F.struct("source_id", "source_start", "source_end", "matched")).alias("x")
    return found.groupBy("doc_id", "start_word", "end_word").agg(least).select("doc_id", "start_word", "end_word", "x.*")


def cut_words(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs without the words of spans (doc_id, start_word, end_word), all
    columns as they came; n_chars, where there is one, follows the new text.

    Words go with what stands between them and up to the next word kept.  A
    document that loses all its words is dropped; one without spans is not
    touched, be it empty or of any length.  A null text stays null, a row
    without an id stays.  Rows that repeat an id are all cut at the same words.
    Spans may overlap, repeat, or name documents that are not there.  An empty
    table on either side leaves docs as they are, and columns may have any
    names."""
    ranges = spans.groupBy(F.col("doc_id").alias("__cut_doc_id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__cut"))
    ranges = sized(stored(ranges, "cuts"), BROADCAST_CUTS)
    joined = docs.join(ranges, docs["doc_id"] == F.col("__cut_doc_id"), "left").drop("__cut_doc_id")
    bound_batches(docs.sparkSession)
    schema = docs.schema
    names = schema.names
    t = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans_of = part.column(part.schema.get_field_index("__cut"))
                some = np.flatnonzero(spans_of.is_valid().to_numpy(zero_copy_only=False))
                cols = [part.column(i) for i in range(len(names))]
                if len(some):
                    texts = cols[t].to_pylist()
                    raw, offsets = T.buffers(cols[t].take(pa.array(some)))
                    start, _ = T.spans(raw, offsets, T.WORD)
                    first = np.searchsorted(start, offsets)
                    gone = np.zeros(part.num_rows, bool)
                    for k, row in enumerate(some.tolist()):
                        begin = start[first[k] : first[k + 1]]
                        keep = np.ones(len(begin), bool)
                        for x in spans_of[row].as_py():
                            keep[x["start_word"] : x["end_word"]] = False
                        gone[row] = not keep.any()
                        # a word reaches to the start of the next one; what stands before the first word stays
                        size = np.diff(np.r_[offsets[k], begin, offsets[k + 1]])
                        texts[row] = raw[offsets[k] : offsets[k + 1]][np.repeat(np.r_[True, keep], size)].tobytes().decode()
                    cols[t] = pa.array(texts, cols[t].type)
                    if "n_chars" in names:
                        i = names.index("n_chars")
                        old = cols[i].to_pylist()
                        touched = set(some.tolist())
                        cols[i] = pa.array([len(texts[r]) if r in touched and not gone[r] else v for r, v in enumerate(old)], cols[i].type)
                    out = pa.RecordBatch.from_arrays(cols, names)
                    yield out.filter(pa.array(~gone))
                else:
                    yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, schema)


def op10_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op10_collinear_passages": op10_collinear_passages}
