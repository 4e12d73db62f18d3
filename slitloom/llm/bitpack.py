"""Token ids in the least bits that the vocabulary needs.

Ids are packed little-endian, 64 of them into exactly `bits` 64-bit words, so
that packing and unpacking are 64 vectorised shifts whatever the width, and id
i begins at bit i * bits.  Blocks of 1024 ids begin at the byte offsets given,
which let a reader unpack one block, or one id, without the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import vocab as V
from .common import keyed_texts, load, map_text

VOCAB = "byte_bpe_50k.tiktoken"
BLOCK = 1024


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs, one at least."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has one id at least")
    return max(1, (vocabulary - 1).bit_length())


def pack_groups(ids: np.ndarray, bits: int) -> np.ndarray:
    """(groups, bits) words of ids padded with zeros to a multiple of 64."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit {bits} bits")
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ceil(n * bits / 8) bytes."""
    return pack_groups(ids, bits).astype("<u8").tobytes()[: (len(ids) * bits + 7) // 8]


def unpack(data: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """Ids start..start+n; start is a multiple of 8 ids, so that it is at a byte."""
    if start % 8:
        skip = start % 8
        return unpack(data, bits, n + skip, start - skip)[skip:]
    raw = np.frombuffer(data, np.uint8)[start * bits // 8 : (start + n) * bits // 8 + 1]
    groups = -(-n // 64)
    full = np.zeros(groups * bits * 8, np.uint8)
    m = min(len(raw), len(full))
    full[:m] = raw[:m]
    words = full.view("<u8").reshape(groups, bits)
    out = np.zeros((groups, 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = lane & mask
    return out.reshape(-1)[:n].astype(np.int64)


def token_at(data: bytes, bits: int, i: int) -> int:
    """One id, from the bytes that hold it."""
    at = i * bits
    return int.from_bytes(data[at // 8 : (at + bits + 7) // 8], "little") >> at % 8 & (1 << bits) - 1


def pack_many(ids: np.ndarray, first: np.ndarray, bits: int) -> list[bytes]:
    """pack() of ids[first[d]:first[d+1]], all documents at once."""
    size = np.diff(first)
    groups = -(-size // 64)
    begin = np.concatenate([[0], np.cumsum(groups)])
    padded = np.zeros(int(begin[-1]) * 64, np.int64)
    shift = np.repeat(begin[:-1] * 64 - first[:-1], size)
    padded[np.arange(len(ids)) + shift] = ids
    data = pack_groups(padded, bits).astype("<u8").tobytes()
    stride = bits * 8
    return [data[b * stride : b * stride + (n * bits + 7) // 8] for b, n in zip(begin[:-1].tolist(), size.tolist(), strict=True)]


SCHEMA = "doc_id bigint, n_tokens bigint, bits int, packed binary, block_offsets array<bigint>"


def packed_tokens(docs: DataFrame, name: str = VOCAB, folder: str = V.TOKENIZER_DIR) -> DataFrame:
    """SCHEMA's row for each row of docs that has an id: the ids of its text,
    encoded whole, and the byte offsets of its blocks of BLOCK ids.

    Null and empty texts give no ids, no bytes and no blocks; a text of any
    length is packed whole.  Rows that repeat are packed one by one, a null
    doc_id is left out.  There are no ties.  An empty table gives no rows;
    other columns are ignored."""
    bits = width(len(V.byte_ranks(f"{folder}/{name}")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, first = V.token_ids(batch.column("text"), name, folder)
        size = np.diff(first)
        blocks = -(-size // BLOCK)
        at = np.concatenate([[0], np.cumsum(blocks)])
        offsets = (np.arange(at[-1]) - np.repeat(at[:-1], blocks)) * (BLOCK * bits // 8)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(size.astype(np.int64)),
                pa.array(np.full(len(size), bits, np.int32)),
                pa.array(pack_many(ids, first, bits), pa.binary()),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(offsets.astype(np.int64))),
            ],
            ["doc_id", "n_tokens", "bits", "packed", "block_offsets"],
        )

    return map_text(keyed_texts(docs), run, SCHEMA)


def op4_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_tokens(load(spark, sf_dir, "documents"))


QUERIES_BY_NAME = {"op4_token_bit_packing": op4_token_bit_packing}
