"""Media columns: lossless PNG images in binary columns, read back with checks, and a low-frequency cosine hash."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the image format: its first bytes, and samples per pixel of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH = 64
#: Bytes of texts after which a batch of images is given out.
BATCH_BYTES = 1 << 26


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey image; each row takes the filter (none, left or above) with the least sum of differences."""
    rows, width = pixels.shape
    left = pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    above = pixels.copy()
    above[1:] -= pixels[:-1]
    each = np.stack([pixels, left, above])
    cost = np.minimum(each, np.uint8(0) - each).sum(axis=2, dtype=np.int64)
    pick = cost.argmin(axis=0)
    lines = np.empty((rows, width + 1), dtype=np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = each[pick, np.arange(rows)]
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Pixels (rows, width * channels) of an 8-bit, non-interlaced image; ValueError where it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("the image has no beginning or no end")
    width, rows, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only plain 8-bit images can be read")
    step = CHANNELS[colour]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != rows * (width * step + 1):
        raise ValueError("the image has another size than it says")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(rows, width * step + 1), step)


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the row filters: runs of rows with one filter are summed at once, mean and Paeth rows pixel by pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    rows, wide = out.shape
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    left = np.flatnonzero(kinds == 1)
    if len(left):
        out[left] = np.cumsum(out[left].reshape(len(left), wide // step, step), axis=1, dtype=np.uint8).reshape(len(left), wide)
    bounds = np.r_[0, np.flatnonzero(np.diff(kinds)) + 1, rows]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        kind = kinds[a]
        if kind == 2:
            before = out[a - 1] if a else np.zeros(wide, dtype=np.uint8)
            out[a:b] = np.cumsum(np.vstack([before, out[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for row in range(a, b):
                line, over = out[row].astype(int).tolist(), (out[row - 1].astype(int).tolist() if row else [0] * wide)
                for x in range(wide):
                    back, corner = (line[x - step], over[x - step]) if x >= step else (0, 0)
                    if kind == 3:
                        guess = (back + over[x]) // 2
                    else:
                        near = back + over[x] - corner
                        guess = min((back, over[x], corner), key=lambda v, near=near: abs(v - near))
                    line[x] = (line[x] + guess) & 255
                out[row] = line
    return out


@lru_cache(maxsize=1)
def _cosines(n: int = 32, low: int = 8) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hexadecimal: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 image exceed their median."""
    rows = pixels.shape[0]
    edges = np.arange(33) * rows // 32
    if rows >= 32:
        sums = np.add.reduceat(pixels.astype(np.float64), edges[:-1], axis=0) / np.diff(edges)[:, None]
    else:
        sums = pixels[edges[:-1]].astype(np.float64)
    small = sums.reshape(32, 32, -1).mean(axis=2)
    cosines = _cosines()
    low = np.round(cosines @ small @ cosines.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """(id_col, n_bytes long, media binary): each text as UTF-8, padded with bytes 0 to a positive multiple of 64, as
    a grey image of width 64. A null text is empty: one row of zeros. Ids are carried along as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, first, held = [], [], 0, 0
            for k, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                rows = max(1, -(-len(data) // WIDTH))
                sizes.append(len(data))
                held += len(data)
                media.append(write_png(np.frombuffer(data.ljust(rows * WIDTH, b"\0"), dtype=np.uint8).reshape(rows, WIDTH), level))
                if k + 1 == batch.num_rows or held > BATCH_BYTES:  # so that one batch stays far below 2 GB
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k + 1 - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])
                    sizes, media, first, held = [], [], k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """Read every image back (checksums tested) and describe it: payload size, digests and the cosine hash.

    Null or damaged media give null features and ``damaged`` true. Equal images give equal rows but for the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for data in batch.column(2).to_pylist():
                try:
                    pixels = read_png(data or b"")
                except (ValueError, zlib.error):
                    row = (None, None, None, None, None, None, True)
                else:
                    payload = pixels.tobytes()
                    wide = pixels if pixels.shape[1] % 32 == 0 else np.pad(pixels, ((0, 0), (0, -pixels.shape[1] % 32)))
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(wide), False)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "damaged"]
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n_bytes"), F.col(media_col).alias("media"))
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damaged boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
