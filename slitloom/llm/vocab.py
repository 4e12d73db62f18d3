"""Public vocabularies, applied to each distinct chunk of a batch once.

A text is cut before every single space that a visible ASCII character or a
letter's lead byte follows.  The pre-tokenisation pattern of the byte-level
vocabularies always has a token border there, so the chunks' ids in a row are
the ids of the whole text.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa

from . import text as T

TOKENIZER_DIR = "/opt/tokenizers"
#: The published pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers before it starts afresh.
REMEMBERED = 300_000

_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = True
_FOLLOWS[0xC3:0xE1] = True  # lead bytes that no white space outside ASCII begins with
_FOLLOWS[0xE4:0xF5] = True
_MODELS: dict = {}
_CACHES: dict = {}


def cache(key: tuple, make) -> "Chunks":
    """This process's chunks for one purpose; those of other purposes are let
    go, since a worker that serves several stages would keep them all."""
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = make()
    return _CACHES[key]


def byte_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def byte_level(name: str, folder: str = TOKENIZER_DIR):
    """The byte-level encoder of a rank file, loaded once in each process."""
    import tiktoken

    key = (folder, name)
    if key not in _MODELS:
        _MODELS[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=byte_ranks(os.path.join(folder, name)), special_tokens={})
    return _MODELS[key]


def pieces(name: str, folder: str = TOKENIZER_DIR):
    """(model, which ids are bytes) of a piece vocabulary."""
    import sentencepiece

    key = (folder, name)
    if key not in _MODELS:
        model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name))
        _MODELS[key] = model, frozenset(i for i in range(model.vocab_size()) if model.is_byte(i))
    return _MODELS[key]


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): chunks first[d]..first[d+1] make up text d."""
    n = len(raw)
    head = np.zeros(n + 1, bool)
    if n:
        head[:-2] = (raw[:-1] == 0x20) & _FOLLOWS[raw[1:]]
        head[1:-1] &= raw[:-1] != 0x20  # a run of spaces stays whole
        head[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(head[:n])
    end = np.append(start[1:], n)[: len(start)]
    return start, end, np.searchsorted(start, offsets)


class Chunks:
    """Per distinct chunk a row of `width` numbers and a list of ids, both from
    encode(list of chunks), remembered."""

    def __init__(self, encode, width: int):
        self.encode, self.width = encode, width
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.rows = np.zeros((0, self.width), np.int32)

    def look(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each chunk among those remembered."""
        h = T.span_hashes(raw, start, end)
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
        one = order[new]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        if len(self.index) > REMEMBERED:
            self.clear()
        keys = h[one].tolist()
        index = self.index
        known = [index.get(k, -1) for k in keys]
        missing = []
        data = raw.tobytes()
        for k, i in enumerate(known):
            if i < 0:
                known[k] = index[keys[k]] = len(index)
                missing.append(data[start[one[k]] : end[one[k]]].decode("utf-8", "replace"))
        if missing:
            rows, ids = self.encode(missing)
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
            self.rows = np.concatenate([self.rows, np.asarray(rows, np.int32).reshape(len(missing), self.width)])
        return np.array(known, np.int64)[group]

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks in a row, number of ids of each)."""
        size = np.diff(self.at)[which]
        total = int(size.sum())
        shift = np.repeat(self.at[which] - (np.cumsum(size) - size), size)
        return self.ids[shift + np.arange(total)], size


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[d]:first[d+1]]."""
    acc = np.concatenate([[0], np.cumsum(values)])
    return acc[first[1:]] - acc[first[:-1]]


def token_ids(col: pa.Array, name: str, folder: str = TOKENIZER_DIR) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): byte-level ids of each text, just as if it were encoded whole."""
    raw, offsets = T.buffers(col)
    start, end, first = chunks(raw, offsets)
    model = byte_level(name, folder)
    own = cache(("ids", folder, name), lambda: Chunks(lambda new: ([()] * len(new), [model.encode_ordinary(s) for s in new]), 0))
    which = own.look(raw, start, end)
    ids, size = own.gather(which)
    return ids, np.concatenate([[0], np.cumsum(sum_by(size, first))])


def token_counts(col: pa.Array, name: str, folder: str = TOKENIZER_DIR) -> np.ndarray:
    """Number of byte-level ids of each text."""
    raw, offsets = T.buffers(col)
    start, end, first = chunks(raw, offsets)
    model = byte_level(name, folder)
    own = cache(("count", folder, name), lambda: Chunks(lambda new: ([len(model.encode_ordinary(s)) for s in new], [()] * len(new)), 1))
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64)
    which = own.look(raw, start, end)
    return sum_by(own.rows[which, 0], first)
