"""PNG pictures of eight bits a channel, to and from arrays; other formats where Pillow is installed."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Fixed values of the format: its first bytes, and the channels of its colour types without a palette.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(pixels: np.ndarray) -> bytes:
    """height x width x 1 (grey) or 3 (RGB)."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, c = pixels.shape
    rows = np.concatenate((np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)), axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray | None:
    """height x width x channels (RGB or grey, without alpha); null for damaged data and for what isn't handled."""
    if not data.startswith(SIGNATURE):
        return _pillow(data)
    try:
        at, packed, head = 8, [], b""
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            body = data[at + 8 : at + 8 + n]
            head, packed = (body, packed) if kind == b"IHDR" else (head, [*packed, body] if kind == b"IDAT" else packed)
            at += 12 + n
        w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
        if bits != 8 or interlaced or colour not in CHANNELS:
            return _pillow(data)
        c = CHANNELS[colour]
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, w * c + 1)
    except (struct.error, zlib.error, ValueError):
        return None
    out = _unfilter(lines, c).reshape(h, w, c)
    return out[:, :, :1] if c == 2 else out[:, :, :3]


def _unfilter(lines: np.ndarray, c: int) -> np.ndarray:
    """Undo each line's filter; the sums along a line go pixel by pixel only where the filter looks at two neighbours."""
    above = np.zeros((lines.shape[1] - 1) // c * c, np.uint8)
    out = np.empty((len(lines), len(above)), np.uint8)
    for y, (kind, *_) in enumerate(lines[:, :1].tolist()):
        x = lines[y, 1:]
        if kind == 1:
            x = np.cumsum(x.reshape(-1, c), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            x = x + above
        elif kind in (3, 4):
            line = np.zeros((len(x) // c + 1, c), np.int32)
            up = np.concatenate((np.zeros((1, c), np.int32), above.reshape(-1, c).astype(np.int32)))
            for k, v in enumerate(x.reshape(-1, c).astype(np.int32), start=1):
                a, b, d = line[k - 1], up[k], up[k - 1]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pd_ = np.abs(b - d), np.abs(a - d), np.abs(a + b - 2 * d)
                    guess = np.where((pa <= pb) & (pa <= pd_), a, np.where(pb <= pd_, b, d))
                line[k] = (v + guess) & 255
            x = line[1:].astype(np.uint8).ravel()
        out[y] = above = x
    return out


def _pillow(data: bytes) -> np.ndarray | None:
    try:
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except (ImportError, OSError, ValueError):
        return None


def decode_udf():
    """An Arrow UDF from bytes to struct(height, width, nChannels, data); BGR, as Spark's image source has it; null if undecodable."""

    @F.pandas_udf("height int, width int, nChannels int, data binary")
    def run(content: pd.Series) -> pd.DataFrame:
        out = []
        for d in content:
            a = None if d is None else decode(d)
            out.append((None,) * 4 if a is None else (a.shape[0], a.shape[1], a.shape[2], np.ascontiguousarray(a[:, :, ::-1]).tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "nChannels", "data"]).astype({"height": "Int32", "width": "Int32", "nChannels": "Int32"})

    return run
