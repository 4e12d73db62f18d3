"""Arrow-native text kernels shared by the training-data operators.

Every kernel takes the UTF-8 buffer of an Arrow string column and works on the
bytes of all documents of a batch at once, so that no Python object is made
per word.  A *word* is a maximal run of bytes that are ASCII letters or digits
or belong to a character outside ASCII; ASCII letters are folded to lower case
and so are the two-byte Latin, Greek and Cyrillic capitals that `utf8_lower`
folds.  A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_SLAB = 1 << 20

_rng = np.random.default_rng(0x51173)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _need(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, _SLAB + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            _powers, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of a uint64 over all bits."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of member bytes; none crosses a text."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z
    inside = member[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a random byte
    table times powers of an odd number; spans may be of any length."""
    out = np.zeros(len(start), np.uint64)
    i, n = 0, len(raw)
    while i < len(start):
        base = int(start[i])
        j = max(int(np.searchsorted(end, base + _SLAB, "right")), i + 1)
        top = int(end[j - 1])
        up, down = _need(top - base + 1)
        with np.errstate(over="ignore"):
            acc = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_TABLE[raw[base:top]] * up[: top - base], out=acc[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = (acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def words(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, start, end, raw): the hashes of all words in order;
    words first[d]..first[d+1] belong to text d; byte spans in the folded raw."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    raw, offsets = buffers(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    start, end = spans(raw, offsets, WORD)
    return span_hashes(raw, start, end), np.searchsorted(start, offsets), start, end, raw


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of all runs of k words that stay within a text."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _MULT + h[j : n - k + 1 + j]
    owner = owners(first)
    at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    return mix(acc[at]), at


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step] if step else out, out[step:])
        have += step
    return out


def minimizers(h: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the shingles of k words that are smallest in some
    window of w consecutive shingles of their text: two texts that share
    k + w - 1 words in a row share one of these.  A text with fewer than w
    shingles gives its smallest one."""
    g, at = shingles(h, first, k)
    if not len(g):
        return g, at
    owner = owners(first)[at]
    n = len(g)
    picked = np.zeros(n, bool)
    if n >= w:
        low = sliding_min(g, w)
        whole = owner[: n - w + 1] == owner[w - 1 :]
        m = len(low)
        # a shingle is picked if it equals the minimum of a whole window that holds it
        low = np.where(whole, low, np.uint64(0))
        for j in range(w):
            picked[j : j + m] |= (g[j : j + m] == low) & whole
    count = np.bincount(owner, minlength=len(first) - 1)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    for d in np.flatnonzero((count > 0) & (count < w)):
        picked[begin[d] + int(np.argmin(g[begin[d] : begin[d] + count[d]]))] = True
    keep = np.flatnonzero(picked)
    return g[keep], at[keep]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 that Spark's bigint holds."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
