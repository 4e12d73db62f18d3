"""Quality rules from tokeniser fertility.

Two public vocabularies measure each text: a byte-level one gives characters
per token and the entropy of the token distribution, a piece vocabulary with
byte fallback the share of its tokens that are bare bytes.  Each language (or,
where the language is unknown, each script) has its own rejection bands: the
corpus median plus or minus `WIDTH` robust deviations, from counts over all
documents.  A band leans on its parent's, that of the script, and this on that
of all documents, as if the parent's were PRIOR documents more: bands of many
documents are their own, those of a few nearly their parent's.  Text that a language's own prose is not made of (symbol noise,
shouting, tables, repeated words) is cut into shorter or fewer kinds of token
and leaves the band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from . import vocab as V
from .common import load, map_text, stored, without

LEVEL_VOCAB = "byte_bpe_multi_50k.tiktoken"
PIECE_VOCAB = "piece_bpe_32k.model"
#: Robust deviations from the median at which a document is rejected.
WIDTH = 4.5
#: Tokens at which the sampling error of a ratio is as large as its spread among long texts.
HALF = 100.0
#: Least robust deviation, in the metric's unit: a corpus of one template has none of its own.
FLOOR = {"chars_per_token": 0.02, "byte_share": 0.004, "entropy": 0.05}
#: Documents that a band's parent counts as.
PRIOR = 30
#: The deviation that the band of all documents leans on, in the metric's unit: wide enough to reject no prose.
PRIOR_SPREAD = {"chars_per_token": 1.0, "byte_share": 0.1, "entropy": 1.5}
_STEP = 1000.0

_SCRIPTS = ["latin", "greek", "cyrillic", "semitic", "indic", "cjk", "hangul", "other"]
_LEAD = np.full(256, 8, np.int64)
_LEAD[65:91] = _LEAD[97:123] = 0
for _lo, _hi, _k in ((0xC3, 0xCB, 0), (0xCD, 0xD0, 1), (0xD0, 0xD4, 2), (0xD6, 0xDC, 3), (0xE0, 0xE1, 4), (0xE3, 0xEA, 5), (0xEA, 0xEE, 6), (0xF0, 0xF5, 7)):
    _LEAD[_lo:_hi] = _k

SCHEMA = "doc_id bigint, lang string, script string, n_tokens bigint, chars_per_token double, byte_share double, entropy double"


def measure(ids: pa.Array, lang: pa.Array, col: pa.Array, folder: str) -> pa.RecordBatch:
    """SCHEMA's row of each text; the metrics of a text without tokens are null."""
    raw, offsets = T.buffers(col)
    n = len(offsets) - 1
    start, end, first = V.chunks(raw, offsets)
    level = V.byte_level(LEVEL_VOCAB, folder)
    model, byte = V.pieces(PIECE_VOCAB, folder)

    def encode(new: list[str]):
        split = [s.split() for s in new]
        got = iter(model.encode([w for ws in split for w in ws], num_threads=1))
        rows = []
        for ws in split:
            mine = [next(got) for _ in ws]
            rows.append((sum(map(len, mine)), sum(i in byte for ids in mine for i in ids)))
        return rows, [level.encode_ordinary(s) for s in new]

    cache = V.cache(("fertility", folder), lambda: V.Chunks(encode, 2))
    which = cache.look(raw, start, end)
    tokens, size = cache.gather(which)
    count = V.sum_by(size, first)
    piece, bare = V.sum_by(cache.rows[which, 0], first), V.sum_by(cache.rows[which, 1], first)
    own = np.repeat(np.arange(n, dtype=np.int64), count)
    kind = np.sort(own << 20 | tokens)
    new = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
    many = np.diff(np.r_[new, len(kind)]).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.bincount(kind[new] >> 20, weights=many * np.log2(many), minlength=n)
        entropy = np.log2(count) - mass / count
        acc = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ratio = (acc[offsets[1:]] - acc[offsets[:-1]]) / count
        share = bare / piece
    none = count == 0
    letters = np.zeros((n, 9), np.int64)
    kinds = _LEAD[raw]
    seen = np.flatnonzero(kinds < 8)
    if len(seen):
        where = np.searchsorted(offsets, seen, "right") - 1
        letters = np.bincount(where * 9 + kinds[seen], minlength=9 * n).reshape(n, 9)
    best = letters.argmax(1)
    script = [None if not letters[i, k] else _SCRIPTS[k] for i, k in enumerate(best.tolist())]
    return pa.RecordBatch.from_arrays(
        [ids, lang, pa.array(script, pa.string()), pa.array(count.astype(np.int64)), pa.array(ratio, mask=none), pa.array(share, mask=none | (piece == 0)), pa.array(np.maximum(entropy, 0), mask=none)],
        ["doc_id", "lang", "script", "n_tokens", "chars_per_token", "byte_share", "entropy"],
    )


def metrics(docs: DataFrame, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """One row of measurements for each row of docs."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return map_text(plain, lambda b: measure(b.column("doc_id"), b.column("lang"), b.column("text"), folder), SCHEMA)


_CELL = ["metric", "level", "key", "octave"]
_TWO_SIDED = {"chars_per_token": True, "byte_share": False, "entropy": True}


def _stacked(rows: DataFrame) -> DataFrame:
    """Each measurement under its language, its script and all documents: (_CELL, x, tokens)."""
    cells = []
    for metric in FLOOR:
        octave = F.col("octave") if metric == "entropy" else F.lit(0)
        for level, key in (("band", F.col("band")), ("wide", F.col("wide")), ("all", F.lit(""))):
            cells.append(F.struct(F.lit(metric).alias("metric"), F.lit(level).alias("level"), key.alias("key"), octave.alias("octave"), F.col(metric).alias("x")))
    return rows.select("n_tokens", F.explode(F.array(*cells)).alias("c")).select("c.*", F.col("n_tokens").alias("tokens")).where("x is not null")


def _median(values: DataFrame) -> DataFrame:
    """(_CELL, v, docs): the median v of each cell, exact to the histogram's step."""
    cells = values.groupBy(*_CELL, "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*_CELL)
    ranked = cells.withColumn("upto", F.sum("n").over(whole.orderBy("v"))).withColumn("docs", F.sum("n").over(whole))
    return ranked.where("2 * upto >= docs").groupBy(*_CELL).agg(F.min("v").alias("v"), F.max("docs").alias("docs"))


def bands(rows: DataFrame) -> DataFrame:
    """(level, key, limits): for each language, each script and all documents a
    map from metric and octave to the centre and spread of its band and the
    number of its documents: the median and the median deviation scaled by the
    text's sampling error, from histograms of steps of 1/1000."""
    values = _stacked(rows)
    centre = stored(_median(values.withColumn("v", F.round(F.col("x") * _STEP))).withColumnRenamed("v", "centre"), "centres")
    off = values.join(centre, _CELL).withColumn("v", F.round(F.abs(F.col("x") * _STEP - F.col("centre")) / F.sqrt(1 + HALF / F.greatest(F.col("tokens"), F.lit(1)))))
    spread = _median(off).drop("docs")
    floor = F.element_at(F.create_map(*(F.lit(y) for x in FLOOR.items() for y in x)), F.col("metric"))
    named = centre.join(spread, _CELL)
    entry = F.struct(F.concat_ws(":", "metric", "octave"), F.struct((F.col("centre") / _STEP).alias("centre"), F.greatest(F.col("v") * 1.4826 / _STEP, floor).alias("spread"), F.col("docs").cast("double").alias("docs")))
    return named.groupBy("level", "key").agg(F.map_from_entries(F.collect_list(entry)).alias("limits"))


def leaning(own: tuple[float, float, float], parent: tuple[float, float]) -> tuple[float, float]:
    """(centre, spread) of a band (centre, spread, documents) that leans on its parent."""
    centre, spread, docs = own
    return (docs * centre + PRIOR * parent[0]) / (docs + PRIOR), (docs * spread + PRIOR * parent[1]) / (docs + PRIOR)


def whole_bands(found: DataFrame) -> dict[str, tuple[float, float]]:
    """(centre, spread) of the bands of all documents, by metric and octave: one of
    an octave of entropy leans on the octave's before it, the others on PRIOR_SPREAD."""
    row = found.where("level = 'all'").first()  # a few numbers for each power of two
    out: dict[str, tuple[float, float]] = {}
    parent: dict[str, tuple[float, float]] = {}
    for name in sorted(row["limits"] if row else {}, key=lambda x: (x.split(":")[0], int(x.split(":")[1]))):
        metric, own = name.split(":")[0], row["limits"][name]
        wide = leaning((own["centre"], own["spread"], own["docs"]), (own["centre"], PRIOR_SPREAD[metric]))
        out[name] = leaning((own["centre"], own["spread"], own["docs"]), parent[metric]) if metric in parent else wide
        parent[metric] = out[name]
    return out


def judged(docs: DataFrame, folder: str = V.TOKENIZER_DIR, width: float = WIDTH) -> DataFrame:
    """metrics() and `kept`: whether all three metrics lie in their bands.

    Characters per token and entropy are banded on both sides, byte share
    above only.  Entropy grows with length, so its bands are by language and
    power of two of the token count.  Null and empty texts have no tokens and
    are rejected; a text of any length is measured whole.  Rows that repeat
    are judged one by one and alike, and count for the bands each; a null
    doc_id is judged too.  A value on a band's limit is rejected.  An empty
    table gives no rows; other columns are ignored."""
    rows = stored(metrics(docs, folder), "fertility")
    rows = rows.select(
        "*",
        F.coalesce("lang", "script", F.lit("none")).alias("band"),
        F.coalesce("script", F.lit("none")).alias("wide"),
        F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int").alias("octave"),
    )
    # written first, so that the planner knows its size before it chooses to broadcast it
    found = stored(bands(rows), "bands")
    out = rows
    for level in ("band", "wide"):
        own = found.where(F.col("level") == level).select(F.col("key").alias(level), F.col("limits").alias(f"{level}_limits"))
        out = out.join(own, level, "left")
    whole = whole_bands(found)
    whole_limits = F.create_map(*(F.lit(x) for name, (centre, spread) in whole.items() for x in (name, [centre, spread]))) if whole else F.lit(None).cast("map<string,array<double>>")
    ok = F.col("n_tokens") > 0
    for metric, both in _TWO_SIDED.items():
        name = F.concat_ws(":", F.lit(metric), F.col("octave") if metric == "entropy" else F.lit("0"))
        limit = F.try_element_at(whole_limits, name)
        centre, spread = limit[0], limit[1]
        for level in ("wide", "band"):
            own = F.try_element_at(f"{level}_limits", name)
            n = F.coalesce(own["docs"], F.lit(0.0))
            centre = (n * F.coalesce(own["centre"], F.lit(0.0)) + PRIOR * centre) / (n + PRIOR)
            spread = (n * F.coalesce(own["spread"], F.lit(0.0)) + PRIOR * spread) / (n + PRIOR)
        z = (F.col(metric) - centre) / (spread * F.sqrt(1 + HALF / F.greatest(F.col("n_tokens"), F.lit(1))))
        ok = ok & F.coalesce((F.abs(z) if both else z) < width, F.lit(True))
    return out.select("doc_id", "band", "n_tokens", "chars_per_token", "byte_share", "entropy", ok.alias("kept"))


def fertile(docs: DataFrame, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """The measurements of the documents that stay (see judged)."""
    return judged(docs, folder).where("kept").select("doc_id", "band", "n_tokens", *(F.round(m, 9).alias(m) for m in ("chars_per_token", "byte_share", "entropy")))


def keep_fertile(docs: DataFrame, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """docs without the rejected ones, all columns as they came.  A doc_id
    stays if any of its rows does; rows without an id are dropped, since no
    later stage could name them."""
    rejected = judged(docs, folder).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    return without(docs.where(F.col("doc_id").isNotNull()), rejected.select("doc_id"))


def op6_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertile(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op6_tokeniser_fertility": op6_tokeniser_fertility}
