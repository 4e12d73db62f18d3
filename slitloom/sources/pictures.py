"""FITS and PNG files, and display codes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions import numeric as N

_CARD, _BLOCK = 80, 2880


def write_fits(path: str, img: np.ndarray) -> None:
    """32-bit float image, rows bottom up, big-endian."""
    h, w = img.shape
    entries = {"SIMPLE": "T", "BITPIX": -32, "NAXIS": 2, "NAXIS1": w, "NAXIS2": h, "BSCALE": "1.0", "BZERO": "0.0", "CREATOR": "'slitloom'"}
    cards = [f"{k:<8}= {v:>20}".ljust(_CARD) for k, v in entries.items()] + ["END".ljust(_CARD)]
    head = "".join(cards).encode()
    body = np.ascontiguousarray(img[::-1], ">f4").tobytes()
    with open(path, "wb") as f:
        f.write(head.ljust(-(-len(head) // _BLOCK) * _BLOCK))
        f.write(body.ljust(-(-len(body) // _BLOCK) * _BLOCK, b"\0"))


def read_fits(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        data = f.read()
    size: dict[str, int] = {}
    at, ended = 0, False
    while not ended:
        block = data[at : at + _BLOCK]
        if len(block) < _BLOCK:
            raise ValueError(f"{path}: no END card")
        for i in range(0, _BLOCK, _CARD):
            card = block[i : i + _CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                ended = True
                break
            if key in ("NAXIS1", "NAXIS2"):
                size[key] = int(card[10:].split("/")[0])
        at += _BLOCK
    w, h = size["NAXIS1"], size["NAXIS2"]
    body = data[at : at + 4 * w * h]
    if len(body) < 4 * w * h:
        raise ValueError(f"{path}: truncated image")
    return np.frombuffer(body, ">f4").reshape(h, w)[::-1].astype(np.float32)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _write_png(path: str, rows: np.ndarray, depth: int, colour: int) -> None:
    h, w = rows.shape[:2]
    raw = rows.astype(">u2" if depth == 16 else "u1").reshape(h, -1)
    lines = b"".join(b"\0" + r.tobytes() for r in raw)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">2I5B", w, h, depth, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 6)) + _chunk(b"IEND", b""))


def quantise(img: np.ndarray, low: float | None = None, high: float | None = None) -> np.ndarray:
    """0..65535, truncated; the range is the .05 to 99.95 percentile unless given."""
    low = N.percentile(img, 0.05) if low is None else low
    high = N.percentile(img, 99.95) if high is None else high
    return np.clip((img - low) * 65535.0 / max(high - low, 1e-12), 0, 65535).astype(np.uint16)


def write_png16(path: str, img: np.ndarray, low: float | None = None, high: float | None = None) -> None:
    _write_png(path, quantise(img, low, high), 16, 0)


def write_png_rgb(path: str, rgb: np.ndarray) -> None:
    _write_png(path, np.clip(rgb, 0, 255), 8, 2)


def read_png_gray(path: str) -> np.ndarray:
    """16-bit gray, or 8-bit gray scaled by 257; other kinds are refused."""
    with open(path, "rb") as f:
        data = f.read()
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError(f"{path}: not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, chunk = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + n
    if head is None or head[3] != 0 or head[2] not in (8, 16) or head[6]:
        raise ValueError(f"{path}: only plain 8- or 16-bit gray is read")
    w, h, depth = head[:3]
    step = depth // 8
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    before = np.zeros(w * step, np.int64)
    for y in range(h):
        kind, row = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 1:
            row = np.cumsum(row.reshape(-1, step), 0).reshape(-1) & 255
        elif kind == 2:
            row = (row + before) & 255
        elif kind in (3, 4):
            for i in range(len(row)):
                a, b = (row[i - step] if i >= step else 0), before[i]
                c = before[i - step] if i >= step else 0
                if kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    da, db, dc = abs(q - a), abs(q - b), abs(q - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                row[i] = (row[i] + p) & 255
        out[y] = before = row
    img = out.reshape(-1).view(">u2").astype(np.float32) if depth == 16 else out.astype(np.float32) * 257
    return img.reshape(h, w)


VELOCITY_SCALE = 1.5


def write_velocity_png(path: str, v: np.ndarray) -> None:
    write_png16(path, v, -VELOCITY_SCALE, VELOCITY_SCALE)


def read_velocity_png(path: str) -> np.ndarray:
    return (read_png_gray(path) / 65535.0 * 2 - 1) * VELOCITY_SCALE
