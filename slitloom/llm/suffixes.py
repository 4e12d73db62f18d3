"""Exact repeats of LENGTH words, by suffix arrays sorted in two stages.

Which suffixes must meet: every run of LENGTH words has a least shingle of K
words; all copies of the run have the same one.  Each shingle that is least in
runs of two places or more belongs to the first document that has it, its
home, and every stretch of text belongs to the home of its runs.  Copies of a
run therefore meet in one home, wherever they come from.  The words of texts,
32 bits each, are exchanged once to be cut into stretches; stretches of the
same words then meet and go to their home once, with the places of the others
beside them.

In a home the stretches are one text, and its suffixes are sorted in two
stages: the suffixes whose first word does not exceed the next (all that are
smaller than their successors are among them) are sorted directly; the others
are induced by scanning the buckets of first words in order, since such a
suffix follows the place of its successor.  Runs of suffixes whose adjacent
common prefixes have LENGTH words or more are the copies of one run of words;
all but the first of them are repeats.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .common import keyed_texts, load, map_text, one_row_an_id, parts, stored

LENGTH = 50
K = 8
#: Words whose suffixes are sorted at once; a home of more is sorted whole.
SORTED = 1 << 20
#: Stretches that a task remembers as told, and places that it holds, before it goes on without.
SEEN = 1 << 18
_STEP = 8


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the values of key."""
    order = np.argsort(key)
    ranked = np.empty(len(key), np.int64)
    sorted_ = key[order]
    ranked[order] = np.cumsum(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return ranked


def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(rank)
    if by < len(rank):
        out[: len(rank) - by] = rank[by:]
    return out


def block_ranks(text: np.ndarray) -> np.ndarray:
    """Rank of the _STEP words from each place on; 0 stands beyond the end."""
    rank, width = text.astype(np.int64) + 1, 1
    while width < _STEP:
        rank = _dense(rank << 32 | _shifted(rank, width))
        width *= 2
    return rank


def suffix_array(text: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
    """Places of the suffixes of text in order; text holds numbers from 0, and a
    suffix that ends comes before one that goes on."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    follows = np.append(text[1:], -1)
    direct = text <= follows
    rank, width = block_ranks(text) if rank is None else rank, _STEP
    # stage one: direct sort by ranks of twice as many words each time, only what is still tied
    order = np.flatnonzero(direct)
    group = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    while True:
        place = order[tied]
        by = np.lexsort((rank[place], group[tied]))
        order[tied] = place = place[by]
        key, own = rank[place], group[tied]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        # a group is named by the place at which it starts
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        if not len(tied):
            break
        rank = _dense(rank << 32 | _shifted(rank, width))
        width *= 2
    # stage two: induce the others bucket by bucket
    symbols = int(text.max()) + 1
    count = np.bincount(text, minlength=symbols)
    begin = np.concatenate([[0], np.cumsum(count)])
    induced = np.bincount(text[~direct], minlength=symbols)
    head = begin[:-1].copy()
    array = np.empty(n, np.int64)
    first = text[order]
    rank_in = np.arange(len(order)) - np.searchsorted(first, np.arange(symbols))[first]
    array[begin[first] + induced[first] + rank_in] = order
    # buckets s..e are scanned together if none of their suffixes is induced from another of them
    low = np.full(symbols, -1, np.int64)
    np.maximum.at(low, text[~direct], follows[~direct])
    lows = low.tolist()
    # the last suffix follows the empty one, which is the least of all
    array[head[text[-1]]] = n - 1
    head[text[-1]] += 1
    s = 0
    while s < symbols:
        e = s + 1
        while e < symbols and lows[e] < s:
            e += 1
        place = array[begin[s] : begin[e]]
        prior = place[place > 0] - 1
        prior = prior[~direct[prior]]
        if len(prior):
            symbol = text[prior]
            by = np.argsort(symbol, kind="stable")
            prior, symbol = prior[by], symbol[by]
            start = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
            size = np.diff(np.append(start, len(symbol)))
            array[head[symbol] + np.arange(len(symbol)) - np.repeat(start, size)] = prior
            head[symbol[start]] += size
        s = e
    return array


def common_prefixes(text: np.ndarray, array: np.ndarray, limit: int, rank: np.ndarray | None = None) -> np.ndarray:
    """Words, up to limit, that each suffix in the array shares with the one before it."""
    n = len(text)
    rank = block_ranks(text) if rank is None else rank
    out = np.zeros(n, np.int64)
    alive = np.arange(1, n)
    while len(alive):
        a, b = array[alive] + out[alive], array[alive - 1] + out[alive]
        inside = (a < n) & (b < n) & (out[alive] < limit)
        alive, a, b = alive[inside], a[inside], b[inside]
        same = rank[a] == rank[b]
        left, a, b = alive[~same], a[~same], b[~same]
        for j in range(_STEP):
            ok = (a + j < n) & (b + j < n)
            left, a, b = left[ok], a[ok], b[ok]
            ok = text[a + j] == text[b + j]
            left, a, b = left[ok], a[ok], b[ok]
            out[left] += 1
        alive = alive[same]
        out[alive] += _STEP
    return np.minimum(out, limit)


def repeats(stretch: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(place, first place) of every run of `length` words that an earlier
    place has too, in the stretches laid end to end with a mark after each."""
    size = np.array([len(x) for x in stretch])
    words = np.concatenate(stretch)
    _, number, count = np.unique(words, return_inverse=True, return_counts=True)
    # common words get small numbers: rare words in a row, which part the scans, are few
    by = np.argsort(-count, kind="stable")
    name = np.empty(len(by), np.int64)
    name[by] = np.arange(len(by))
    end = np.cumsum(size + 1) - 1
    text = np.empty(len(words) + len(size), np.int64)
    is_end = np.zeros(len(text), bool)
    is_end[end] = True
    text[~is_end] = name[number]
    text[end] = len(by) + np.arange(len(end))
    rank = block_ranks(text)
    array = suffix_array(text, rank)
    shared = common_prefixes(text, array, length, rank) >= length
    start = np.maximum.accumulate(np.where(shared, 0, np.arange(len(array))))
    member = shared | np.append(shared[1:], False)
    place, group = array[member], start[member]
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    first = np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, len(group)))) if len(group) else place
    later = place != first
    return place[later], first[later]


_ROW = "at bigint, kind int, home bigint, lo int, hi int, payload binary"
_NAMES = [f.split()[0] for f in _ROW.split(", ")]
SCHEMA = "doc_id bigint, start_word int, end_word int, source_id bigint"


def _runs(batch: pa.RecordBatch, length: int) -> pa.RecordBatch | None:
    """(hash, doc_id, start, many, again): runs start..start+many of a text have
    this least shingle; `again` says that the text has it at several places, so
    that these runs may be alike themselves."""
    h, first, *_ = T.words(batch.column("text"))
    g, at = T.shingles(h, first, K)
    w = length - K + 1
    if len(g) < w:
        return None
    own = T.owners(first)[at]
    low = T.sliding_min(g, w)
    whole = np.flatnonzero(own[: len(low)] == own[w - 1 :])
    if not len(whole):
        return None
    low, owner, place = low[whole], own[whole], at[whole]
    new = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])
    many = np.diff(np.append(new, len(low)))
    owner = owner[new]
    salt = T.mix(np.arange(len(first), dtype=np.uint64))
    key = np.sort(g ^ salt[own])
    twice = T.distinct(key[1:][key[1:] == key[:-1]])
    mine = low[new] ^ salt[owner]
    again = np.zeros(len(new), bool)
    if len(twice):
        again = twice[np.minimum(np.searchsorted(twice, mine), len(twice) - 1)] == mine
    return pa.RecordBatch.from_arrays(
        [pa.array(T.signed(low[new])), batch.column("doc_id").take(pa.array(owner)), pa.array((place[new] - first[owner]).astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(again)], ["hash", "doc_id", "start", "many", "again"]
    )


def _homes(runs: DataFrame, n: int) -> DataFrame:
    """(doc_id, home, start, many) of the runs whose shingle is least in two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the first row of the shingle at hand
        sent = False
        for batch in batches:
            col = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "doc_id", "start", "many", "again")]
            m = len(col[0])
            if not m:
                continue
            start = np.r_[True, col[0][1:] != col[0][:-1]]
            begin = np.flatnonzero(start)
            size = np.diff(np.append(begin, m))
            goes = np.repeat(size > 1, size) | col[4]
            home = np.repeat(col[1][begin], size)
            extra: list[tuple] = []
            if held is not None and held[0] == col[0][0]:
                goes[: size[0]] = True
                home[: size[0]] = held[1]
                if not sent:
                    extra.append((held[1], held[1], held[2], held[3]))
                now_sent = True
            else:
                now_sent = bool(goes[0])
            if len(begin) > 1:
                b = begin[-1]
                held, sent = tuple(int(c[b]) for c in col), bool(goes[b])
            else:
                held = held if held is not None and held[0] == col[0][0] else tuple(int(c[0]) for c in col)
                sent = now_sent
            keep = np.flatnonzero(goes)
            data = [col[1][keep], home[keep], col[2][keep], col[3][keep]]
            if extra:
                data = [np.append(x, np.array([e[i] for e in extra], x.dtype)) for i, x in enumerate(data)]
            if len(data[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], ["doc_id", "home", "start", "many"])

    return runs.repartition(n, "hash").sortWithinPartitions("hash", "doc_id", "start").mapInArrow(run, "doc_id bigint, home bigint, start int, many int")


def _stretches(homes: DataFrame, n: int, length: int) -> DataFrame:
    """Requests for the words of a document's successive runs of one home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(4)]
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("doc_id", "home", "start", "many"), strict=True)]
            doc, home, start, many = held
            if not len(doc):
                continue
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (home[1:] != home[:-1]) | (start[1:] != start[:-1] + many[:-1])])
            last = np.append(new[1:], len(doc)) - 1
            doc, home, lo, many = doc[new], home[new], start[new], start[last] + many[last] - start[new]
            go = len(doc) - (batch is not None)  # the last one may go on
            held = [x[go:] for x in (doc, home, lo, many)]
            if go:
                lo, hi = lo[:go].astype(np.int32), (lo + many + length - 1)[:go].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc[:go]), pa.array(np.ones(go, np.int32)), pa.array(home[:go]), pa.array(lo), pa.array(hi), pa.nulls(go, pa.binary())], _NAMES)

    return homes.repartition(n, "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, _ROW)


_SPELT = "home bigint, same binary, at bigint, lo int, hi int, payload binary"
_PLACED = "home bigint, kind int, at bigint, lo int, hi int, rep bigint, rep_lo int, payload binary"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


def _spelt(requests: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """The requests with their words; of those of the same words in a home, which
    `same` tells, a task gives the words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text = None, np.zeros(0, np.uint32)
        seen: set[bytes] = set()
        for batch in batches:
            col = batch.to_pydict()
            out: list[tuple] = []
            for k in range(batch.num_rows):
                if col["kind"][k] == 0:
                    at, text = col["at"][k], np.frombuffer(col["payload"][k], np.uint32)
                elif col["at"][k] == at:
                    data = text[col["lo"][k] : col["hi"][k]].tobytes()
                    same = hashlib.blake2b(data, digest_size=16, salt=(col["home"][k] & (1 << 64) - 1).to_bytes(8, "little")).digest()
                    out.append((col["home"][k], same, at, col["lo"][k], col["hi"][k], None if same in seen else data))
                    if len(seen) < SEEN:
                        seen.add(same)
            if out:
                yield _batch(_SPELT, out)

    return words.unionByName(requests).repartition(n, "at").sortWithinPartitions("at", "kind").mapInArrow(run, _SPELT)


def _placed(spelt: DataFrame, n: int) -> DataFrame:
    """Per home the words of its distinct stretches, at their first places (kind 0),
    and the other places of each (kind 1), without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, rep, told = None, (0, 0, 0, 0), False
        for batch in batches:
            out: list[tuple] = []
            for home, own, at, lo, hi, data in zip(*(batch.column(c).to_pylist() for c in ("home", "same", "at", "lo", "hi", "payload")), strict=True):
                if own != same:
                    same, rep, told = own, (home, at, lo, hi), False
                else:
                    out.append((home, 1, at, lo, hi, rep[1], rep[2], None))
                if not told and data is not None:
                    told = True
                    out.append((rep[0], 0, *rep[1:], None, None, data))
            if out:
                yield _batch(_PLACED, out)

    return spelt.repartition(n, "same").sortWithinPartitions("same", "at", "lo").mapInArrow(run, _PLACED)


def _solve(rows: list[tuple[int, int, bytes]], length: int) -> tuple[list[tuple], dict[tuple[int, int], int]]:
    """(repeats as rows of SCHEMA, source of each stretch whose first run is one)
    of distinct stretches (document, place, words) of one home or of several."""
    stretch = [np.frombuffer(data, np.uint32) for *_, data in rows]
    place, first = repeats(stretch, length)
    order = np.argsort(place)
    place, first = place[order], first[order]
    if not len(place):
        return [], {}
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in stretch])])
    docs, los = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mine, theirs = np.searchsorted(begin, place, "right") - 1, np.searchsorted(begin, first, "right") - 1
    start = place - begin[mine] + los[mine]
    new = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.append(new[1:], len(place)) - 1
    out = list(zip(docs[mine[new]].tolist(), start[new].tolist(), (start[last] + length).tolist(), docs[theirs[new]].tolist(), strict=True))
    head = np.flatnonzero(place == begin[mine])
    return out, dict(zip(zip(docs[mine[head]].tolist(), los[mine[head]].tolist(), strict=True), docs[theirs[head]].tolist(), strict=True))


def _found(placed: DataFrame, n: int, length: int) -> DataFrame:
    """SCHEMA of the repeats in each home, not yet merged over homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []  # of whole homes, and of the one at hand so far
        again: list[tuple[int, int, int, int, int]] = []
        source: dict[tuple[int, int], int] = {}
        words, home = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, again, words
            out: list[tuple] = []
            if rows:
                found, more = _solve(rows, length)
                out += found
                source.update(more)
            out += [(at, lo, hi, source.get((rep, rep_lo), rep)) for at, lo, hi, rep, rep_lo in again]
            rows, again, words = [], [], 0
            if out:
                yield _batch(SCHEMA, out)

        for batch in batches:
            for h, kind, at, lo, hi, rep, rep_lo, data in zip(*(batch.column(c).to_pylist() for c in ("home", "kind", "at", "lo", "hi", "rep", "rep_lo", "payload")), strict=True):
                if h != home:
                    if words >= SORTED:
                        yield from flush()
                    if not rows:
                        source.clear()
                    home = h
                if kind == 0:
                    rows.append((at, lo, data))
                    words += len(data) // 4
                else:  # a home's other places come after all of its words
                    again.append((at, lo, hi, rep, rep_lo))
                    if len(again) >= SEEN:
                        yield from flush()
        yield from flush()

    return placed.repartition(n, "home").sortWithinPartitions("home", "kind", "at", "lo").mapInArrow(run, SCHEMA)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """SCHEMA: the stretches of each document made up of runs of `length`
    words that occur before, in a lesser doc_id or further up; source_id has
    the first occurrence of the stretch's first run.

    Null and empty texts and those of fewer words have no runs; a null doc_id
    is left out.  Rows that repeat a doc_id count as one document, of the
    longest text (of equally long ones the greatest).  A text of any length is
    taken whole.  Ties don't arise: of equal runs the first is of the least
    doc_id, then furthest up.  An empty table gives no rows; other columns are
    ignored."""
    n = parts(docs)
    plain = one_row_an_id(keyed_texts(docs))

    def spell(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, *_ = T.words(batch.column("text"))
        size = np.diff(first).astype(np.int32)
        short = (h >> np.uint64(32)).astype(np.uint32)
        payload = pa.array([short[first[d] : first[d + 1]].tobytes() for d in range(len(size))], pa.binary())
        zero = pa.array(np.zeros(len(size), np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), zero, pa.nulls(len(size), pa.int64()), zero, pa.array(size), payload], _NAMES)

    runs = map_text(plain, lambda b: _runs(b, length), "hash bigint, doc_id bigint, start int, many int, again boolean")
    requests = stored(_stretches(_homes(runs, n), n, length), "stretches")
    found = _found(_placed(_spelt(requests, map_text(plain, spell, _ROW), n), n), n, length)
    own = Window.partitionBy("doc_id").orderBy("start_word", "end_word", "source_id")
    before = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start_word")).cast("int")).withColumn("island", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min(F.struct("start_word", "source_id")).alias("x"))
    return merged.select("doc_id", "start_word", "end_word", F.col("x.source_id").alias("source_id"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(load(spark, sf_dir, "documents"))


_SQL = rf"""
with t as (select distinct on (doc_id) doc_id, text from documents where doc_id is not null order by doc_id, length(text) desc nulls last, text desc),
w as (select doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from t),
p as (select doc_id, words, unnest(range(len(words) - {LENGTH - 1})) as pos from w where len(words) >= {LENGTH}),
g as (select doc_id, pos, md5(array_to_string(list_slice(words, pos + 1, pos + {LENGTH}), ' ')) as gram from p),
f as (select doc_id, pos, first_value(doc_id) over o as src, first_value(pos) over o as place from g window o as (partition by gram order by doc_id, pos)),
d as (select doc_id, pos, src from f where doc_id <> src or pos <> place),
i as (select *, case when pos <= max(pos) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) + {LENGTH} then 0 else 1 end as new from d),
j as (select *, sum(new) over (partition by doc_id order by pos) as island from i)
select doc_id, cast(min(pos) as int) as start_word, cast(max(pos) + {LENGTH} as int) as end_word, arg_min(src, pos) as source_id from j group by doc_id, island
"""
ORACLES = {"op2_suffix_array_dedup": _SQL}
QUERIES_BY_NAME = {"op2_suffix_array_dedup": op2_suffix_array_dedup}
