"""TIFF pages as rows: image directories are walked, strips and tiles decoded, predictors undone.

`decode_pages` turns a column of TIFF bytes into one row per page: classic TIFF of either byte order, 1 to 32 bits in 8-bit
units, chunky or planar, uncompressed, PackBits, LZW or deflate, strips or tiles, predictors 1 and 2. `encode` writes one page
or several. A page that is damaged or of an unknown kind gives a row with `error` and no pixels; bytes that are no TIFF, and
null, give one such row.

`document_pages` stores each whole text as a TIFF, 64 samples wide, reads it back through `decode_pages`, and describes
what was read. Null and empty texts are one row of 64 zeros; repeated rows are rows of their own, equal texts give equal
values; ids and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._text import sliced

# Fixed values of the format: tags, field types and their sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


class TiffError(ValueError):
    """The bytes are not a TIFF that can be read."""


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; a width grows one code early."""
    fresh = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last = list(fresh), bytearray(), None
    width, acc, held = 9, 0, 0
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        while held >= width:
            held -= width
            code = acc >> held
            acc &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(fresh), 9, None
                continue
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out += entry
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held)
            acc &= (1 << held) - 1

    put(256)
    size, word = 258, b""
    for k in range(len(data)):
        nxt = word + data[k : k + 1]
        if len(nxt) == 1 or nxt in table:
            word = nxt
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[nxt] = size
        size += 1
        word = data[k : k + 1]
        if size == (1 << width) and width < 12:
            width += 1
        elif size >= 4094:
            put(256)
            table, size, width = {}, 258, 9
    if word:
        put(table[word] if len(word) > 1 else word[0])
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append((acc << (8 - held)) & 0xFF)
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data)


_DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


class _Directory:
    """The fields of one image directory."""

    def __init__(self, data: bytes, order: str, at: int):
        if at + 2 > len(data):
            raise TiffError("directory outside the file")
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise TiffError("directory outside the file")
        self.fields: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 0) * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            letter = {1: "B", 3: "H", 4: "I"}.get(kind)
            if letter and place + size <= len(data):
                self.fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
        (self.next,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)

    def get(self, tag: int, default: int | None = None) -> int:
        if tag not in self.fields or not self.fields[tag]:
            if default is None:
                raise TiffError(f"field {tag} is missing")
            return default
        return self.fields[tag][0]


def _page(data: bytes, order: str, d: _Directory) -> Page:
    width, height, samples = d.get(WIDTH), d.get(HEIGHT), d.get(SAMPLES, 1)
    bits = set(d.fields.get(BITS, (1,)))
    compression, predictor = d.get(COMPRESSION, 1), d.get(PREDICTOR, 1)
    planes = samples if d.get(PLANAR, 1) == 2 else 1
    chunk = samples // planes
    if len(bits) != 1 or (b := bits.pop()) not in (8, 16, 32):
        raise TiffError("bits per sample")
    if compression not in _DECODE:
        raise TiffError(f"compression {compression}")
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor}")
    kind = np.dtype(f"{order}u{b // 8}")
    tiled = TILE_OFFSETS in d.fields
    if tiled:
        bw, bh = d.get(TILE_WIDTH), d.get(TILE_HEIGHT)
        places, sizes = d.fields[TILE_OFFSETS], d.fields.get(TILE_SIZES, ())
    else:
        bw, bh = width, min(d.get(STRIP_ROWS, height), height)
        places, sizes = d.fields.get(STRIP_OFFSETS, ()), d.fields.get(STRIP_SIZES, ())
    if not width or not height or not bw or not bh:
        raise TiffError("no size")
    across, down = -(-width // bw), -(-height // bh)
    if len(places) < across * down * planes or len(sizes) < len(places):
        raise TiffError("blocks are missing")
    out = np.zeros((height, width, samples), kind)
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = (rest // across) * bh, (rest % across) * bw
        rows = bh if tiled else min(bh, height - y)
        try:
            block = _DECODE[compression](data[places[k] : places[k] + sizes[k]])
            a = np.frombuffer(block, kind, rows * bw * chunk).reshape(rows, bw, chunk)
        except (ValueError, zlib.error, IndexError) as e:
            raise TiffError(f"block {k}: {e}") from e
        if predictor == 2:
            a = np.add.accumulate(a.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
        h, w = min(rows, height - y), min(bw, width - x)
        out[y : y + h, x : x + w, plane * chunk : (plane + 1) * chunk] = a[:h, :w]
    return Page(width, height, samples, b, compression, tiled, out.astype(kind.newbyteorder("=")))


def decode(data: bytes) -> Iterator[Page | TiffError]:
    """The pages in order; an error in the place of one that can't be read."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        yield TiffError("not a TIFF")
        return
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        try:
            d = _Directory(data, order, at)
        except (TiffError, struct.error) as e:
            yield TiffError(str(e))
            return
        try:
            yield _page(data, order, d)
        except (TiffError, struct.error) as e:
            yield TiffError(str(e))
        at = d.next


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """Pages of height x width (x samples) unsigned integers as a TIFF, in strips of so many rows or in square tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for page in pages:
        a = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = a.shape
        kind = a.dtype.newbyteorder(order)
        places, sizes = [], []
        bw, bh = (tile, tile) if tile else (width, min(rows, height))
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = a[y : y + bh, x : x + bw]
                if tile and block.shape[:2] != (bh, bw):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
                coded = _ENCODE[compression](np.ascontiguousarray(block, kind).tobytes())
                places.append(len(out))
                sizes.append(len(coded))
                out += coded
                out += b"\0" * (len(out) & 1)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [kind.itemsize * 8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [bw]), TILE_HEIGHT: (4, [bh]), TILE_OFFSETS: (4, places), TILE_SIZES: (4, sizes)} if tile else {STRIP_ROWS: (4, [bh]), STRIP_OFFSETS: (4, places), STRIP_SIZES: (4, sizes)}
        entries = bytearray()
        for tag in sorted(fields):
            t, values = fields[tag]
            body = struct.pack(f"{order}{len(values)}{'HI'[t == 4]}", *values)
            if len(body) > 4:
                body, at = struct.pack(order + "I", len(out)), body
                out += at + b"\0" * (len(at) & 1)
            entries += struct.pack(order + "HHI", tag, t, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """media(doc_id, n_bytes, media) to doc_id, n_bytes, media_bytes, media_sha256, page, width, height, samples, bits, pixels, error."""
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, samples int, bits int, pixels binary, error string"
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column(column), strict=True):
                raw = data.as_py() or b""
                digest = hashlib.sha256(raw).hexdigest()
                for k, page in enumerate(decode(raw)):
                    if isinstance(page, Page):
                        pixels = page.pixels.tobytes()
                        rows.append((doc, n, len(raw), digest, k, page.width, page.height, page.samples, page.bits, pixels, None))
                        held += len(pixels)
                    else:
                        rows.append((doc, n, len(raw), digest, k, None, None, None, None, None, str(page)))
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), column).mapInArrow(run, schema)


def feature(pixels: np.ndarray) -> str:
    """An 8 x 8 average hash of a page (16 hex digits), and its mean and deviation in tenths."""
    h, w = pixels.shape
    y, x = (np.arange(9) * h) // 8, (np.arange(9) * w) // 8
    y[1:] = np.maximum(y[1:], y[:-1] + 1)  # fewer rows than cells: the last rows again
    sums = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(pixels, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    lo, hi = np.minimum(y[:-1], h - 1), np.minimum(y[1:], h)
    hi = np.maximum(hi, lo + 1)
    cell = (sums[hi][:, x[1:]] - sums[lo][:, x[1:]] - sums[hi][:, x[:-1]] + sums[lo][:, x[:-1]]) / ((hi - lo)[:, None] * (x[1:] - x[:-1])[None, :])
    bits = (cell > pixels.mean()).ravel()
    return f"{int(''.join('01'[int(v)] for v in bits), 2):016x}:{pixels.mean():.1f}:{pixels.std():.1f}"


def encode_documents(docs: DataFrame, width: int = 64) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, media: the text's bytes, filled with 0 to whole rows, as a grey page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw, offs in sliced(batches, "text"):
            media = []
            for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                page = np.zeros(max(1, -(-(y - x) // width)) * width, np.uint8)
                page[: y - x] = raw[x:y]
                media.append(encode([page.reshape(-1, width)]))
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def document_pages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, digest, tail, feat = [], [], [], []
            for w, h, data in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("pixels"), strict=True):
                raw = data.as_py()
                size.append(len(raw))
                digest.append(hashlib.sha256(raw).hexdigest())
                tail.append(zlib.crc32(raw[-64:]))
                feat.append(feature(np.frombuffer(raw, np.uint8).reshape(h, w)))
            yield pa.record_batch(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(tail, pa.int64()), b.column("media_bytes"), b.column("media_sha256"), pa.array(feat, pa.string())],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return decode_pages(encode_documents(docs)).mapInArrow(run, schema)
