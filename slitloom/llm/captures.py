"""Capture index of web pages by external merge.

Capture runs (one for each input partition) are sorted by URL key and time
where they are made, and written to the shared folder; more than FAN_IN of them
are merged to fewer.  Ranges of (key, time, page) are cut from a sample of the
keys, so that a URL of very many captures is spread over several, and each range
is one task: it reads the row groups of its range from every run, a few rows at a
time, and merges them by a loser tree that holds one row a run.  What a task
holds depends on the number of runs alone.  The partitions in order are one
globally ordered index, with each URL's captures numbered in its history; where a
history goes on from another range, so do its numbers.

The URL key is the host's labels reversed, joined by commas, then `)` and the
path and query: `http://www.Example.com:80/a?b` is `com,example)/a?b`.
The table `pages` has no capture time, so that in the registered query a page's
time is its place in the crawl: page 0 at 2024-01-01 00:00:00, one page a second.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, load, parts, stored

EPOCH = 1_704_067_200


class LoserTree:
    """Merges sorted runs: each step replays one path of log2(k) matches.

    Runs are iterators of (key, ...) tuples; of equal keys the run of the
    lower number wins."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._build(i)

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a comes before run b."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _build(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at > 0:
            if self.tree[at] == -1:
                self.tree[at] = winner
                return
            if self._wins(self.tree[at], winner):
                self.tree[at], winner = winner, self.tree[at]
            at //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while True:
            winner = self.tree[0] if self.k > 1 else 0
            item = self.head[winner]
            if item is None:
                return
            yield item
            self.head[winner] = next(self.runs[winner], None)
            at = (winner + self.k) // 2
            while at > 0:
                if self._wins(self.tree[at], winner):
                    self.tree[at], winner = winner, self.tree[at]
                at //= 2
            if self.k > 1:
                self.tree[0] = winner


def url_key(url: Column) -> Column:
    """The sort-friendly form of a URL; null for null, and for one without a host."""
    rest = F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, "#.*$", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(rest, "^[^/?]*", "")
    path = F.when(F.left(path, F.lit(1)) == "/", path).otherwise(F.concat(F.lit("/"), path))
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path))


SCHEMA = "page_id bigint, url_key string, captured bigint, digest string, length bigint, capture_no int, changed boolean"
_RUN = "url_key string, captured bigint, page_id bigint, digest string, length bigint"
_FIELDS = [f.split()[0] for f in _RUN.split(", ")]
#: Runs that a task merges at once; more are merged to fewer first.
FAN_IN = 128
#: Rows of each run that a merging task holds.
HELD = 512
#: Bytes of a run's row groups, of which a task reads those of its range, and of their pages.
GROUP_BYTES, PAGE_BYTES = 1 << 20, 1 << 16
#: Keys sampled for each range, and the rows below which no further range is made.
SAMPLES, LEAST_ROWS = 64, 4096

Key = tuple[str, int, int, str]


def _order(row: tuple) -> Key:
    return row[0], row[1], row[2], row[3] or ""


def _read(uri: str, low: Key | None = None, high: Key | None = None) -> Iterator[tuple[Key, str | None, int]]:
    """(key, digest, length) of a run's rows with low <= key < high, HELD rows at a time."""
    system, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source, buffer_size=PAGE_BYTES)
        groups = []
        for g in range(file.metadata.num_row_groups):
            seen = file.metadata.row_group(g).column(0).statistics
            if seen is None or not seen.has_min_max or ((low is None or seen.max >= low[0]) and (high is None or seen.min <= high[0])):
                groups.append(g)
        for batch in file.iter_batches(HELD, groups, use_threads=False):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = _order(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield key, row[3], row[4]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, 8192)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema.names)


_RUN_ARROW = pa.schema([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string()), ("length", pa.int64())])
_ARROW = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.int64()), ("digest", pa.string()), ("length", pa.int64()), ("capture_no", pa.int32()), ("changed", pa.bool_())])


def _merged(files: list[str], low: Key | None = None, high: Key | None = None) -> Iterator[tuple[Key, str | None, int]]:
    return iter(LoserTree([_read(f, low, high) for f in files]))


def _runs(plain: DataFrame, fan_in: int) -> tuple[DataFrame, list[str]]:
    """Sorted runs, at most fan_in of them, and their files: one for each task that
    read pages, merged in groups of fan_in as often as it takes."""
    spark = plain.sparkSession
    small = {"parquet.block.size": GROUP_BYTES, "parquet.page.size": PAGE_BYTES}
    runs = stored(plain.sortWithinPartitions(*_FIELDS[:4]), "runs", **small)
    files = sorted(runs.inputFiles())
    while len(files) > fan_in:
        groups = [files[i : i + fan_in] for i in range(0, len(files), fan_in)]
        shared = spark.sparkContext.broadcast(groups)

        def merge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    yield from _batches((key[:3] + (digest, length) for key, digest, length in _merged(shared.value[g])), _RUN_ARROW)

        fewer = stored(spark.range(0, len(groups), 1, len(groups)).mapInArrow(merge, _RUN), "runs", **small)
        discard(runs)
        runs, files = fewer, sorted(fewer.inputFiles())
    return runs, files


def _bounds(runs: DataFrame, ranges: int) -> list[Key]:
    """The keys at which the ranges but the first begin, from a sample of SAMPLES keys a range."""
    n = runs.count()
    ranges = min(ranges, max(1, n // LEAST_ROWS))
    step = max(1, n // (SAMPLES * ranges))
    keys = ("url_key", "captured", "page_id")
    some = runs.where(F.pmod(F.xxhash64(*keys), F.lit(step)) == 0).select(*keys).collect()
    order = sorted((r[0], r[1], r[2], "") for r in some)
    return sorted({order[i * len(order) // ranges] for i in range(1, ranges)}) if order else []


def _carried(runs: DataFrame, bounds: list[Key]) -> list[tuple[int, str | None]]:
    """For each bound the captures of its URL before it, and the digest of the last of them."""
    keys = pa.array(sorted({b[0] for b in bounds}), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        for batch in batches:
            some = batch.filter(pc.is_in(batch.column("url_key"), keys))
            for row in zip(*(some.column(c).to_pylist() for c in _FIELDS[:4]), strict=True):
                key = _order(row)
                have = seen.setdefault((key[0], bisect_right(bounds, key)), [0, key, None])
                have[0] += 1
                if key >= have[1]:
                    have[1], have[2] = key, row[3]
        rows = ((k, r, n, at[1], at[2], digest) for (k, r), (n, at, digest) in seen.items())
        yield from _batches(rows, pa.schema([("url_key", pa.string()), ("range", pa.int32()), ("n", pa.int64()), ("captured", pa.int64()), ("page_id", pa.int64()), ("digest", pa.string())]))

    counted = runs.mapInArrow(count, "url_key string, range int, n bigint, captured bigint, page_id bigint, digest string")
    found = counted.groupBy("url_key", "range").agg(F.sum("n").alias("n"), F.max(F.struct("captured", "page_id", "digest")).alias("last")).collect()  # at most two rows a range
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["url_key"], r["range"])):
        by.setdefault(r["url_key"], []).append((r["range"], r["n"], r["last"]["digest"]))
    out = []
    for i, b in enumerate(bounds):
        before = [x for x in by.get(b[0], []) if x[0] <= i]
        out.append((sum(x[1] for x in before), before[-1][2] if before else None))
    return out


def captures(pages: DataFrame, time: str | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """SCHEMA, in order of (url_key, captured, page_id, digest) over all partitions.

    `time` names a column of capture times (seconds, or timestamps); without
    one a page's time is its place in the crawl.  capture_no counts a URL's
    captures from 1; `changed` says whether the page differs from the one
    before (the first does).  Rows whose URL is null or has no host, or whose
    page_id or time is null, are left out; a null page is one without digest,
    and of length 0; an empty one is a page, a very long one is known by its
    digest.  Captures at the same time are in order of page_id, then digest,
    none first; rows that repeat are captures of their own.  An empty table
    gives no rows; other columns are ignored."""
    spark = pages.sparkSession
    at = F.col(time).cast("bigint") if time else F.col("page_id").cast("bigint") + EPOCH
    plain = pages.select(
        url_key(F.col("url").cast("string")).alias("url_key"),
        at.alias("captured"),
        F.col("page_id").cast("bigint").alias("page_id"),
        F.md5(F.col("html").cast("string")).alias("digest"),
        F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).cast("bigint").alias("length"),
    ).where("url_key is not null and page_id is not null and captured is not null")
    runs, files = _runs(plain, fan_in)
    bounds = _bounds(runs, parts(pages))
    carried = _carried(runs, bounds) if bounds else []

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                low, high = bounds[i - 1] if i else None, bounds[i] if i < len(bounds) else None
                last, (number, before) = (low[0], carried[i - 1]) if i else (None, (0, None))

                def numbered(low=low, high=high, last=last, number=number, before=before) -> Iterator[tuple]:
                    for (key, when, page, _), digest, length in _merged(files, low, high):
                        number = number + 1 if key == last else 1
                        yield page, key, when, digest, length, number, number == 1 or digest != before
                        last, before = key, digest

                yield from _batches(numbered(), _ARROW)

    # one task a range, in order of the ranges
    return spark.range(0, len(bounds) + 1, 1, len(bounds) + 1).mapInArrow(merge, SCHEMA)


def op3_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(load(spark, sf_dir, "pages"))


_SQL = f"""
with a as (select page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') as rest, html from pages where page_id is not null),
b as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*\\.', '') as host,
  regexp_replace(rest, '^[^/?]*', '') as path from a),
c as (select page_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when left(path, 1) = '/' then path else '/' || path end as url_key,
  page_id + {EPOCH} as captured, md5(html) as digest, coalesce(octet_length(encode(html)), 0)::bigint as length from b where host <> '')
select page_id, url_key, captured, digest, length, cast(row_number() over w as int) as capture_no,
  row_number() over w = 1 or digest is distinct from lag(digest) over w as changed
from c window w as (partition by url_key order by captured, page_id, digest nulls first)
"""
ORACLES = {"op3_capture_index": _SQL}
QUERIES_BY_NAME = {"op3_capture_index": op3_capture_index}
