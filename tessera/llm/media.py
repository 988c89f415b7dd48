"""Media columns: texts' bytes as grey PNG images in binary columns, and perceptual hashes of what is read back.

The PNG format is written and read here: signature, length-typed chunks with CRC-32 checks, zlib image
data, and the five line filters, undone with numpy.  The hash compares the low frequencies of the
image's cosine transform with their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import utf8_list

#: Pixels in a line.
WIDTH = 64
#: The image is averaged to this many lines and columns before the cosine transform.
GRID = 32
#: Low frequencies kept in each direction.
LOW = 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of (lines, columns); each line is stored as it is or as differences from the line above, whichever is smaller in sum."""
    above = np.zeros_like(pixels)
    above[1:] = pixels[:-1]
    up = pixels - above
    cost_up = np.minimum(up, np.uint8(0) - up).sum(axis=1, dtype=np.int64)
    cost_none = np.minimum(pixels, np.uint8(0) - pixels).sum(axis=1, dtype=np.int64)
    use_up = cost_up < cost_none
    rows = np.empty((len(pixels), pixels.shape[1] + 1), dtype=np.uint8)
    rows[:, 0] = np.where(use_up, 2, 0)
    rows[:, 1:] = np.where(use_up[:, None], up, pixels)
    header = struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The pixels of filtered lines of one byte a pixel (0 none, 1 left, 2 above, 3 mean of both, 4 Paeth's choice)."""
    out = np.empty_like(rows)
    at, blank = 0, np.zeros(rows.shape[1], dtype=np.uint8)
    while at < len(rows):
        kind, end = int(kinds[at]), at + 1
        while end < len(rows) and kinds[end] == kind:
            end += 1
        above = out[at - 1] if at else blank
        if kind == 0:
            out[at:end] = rows[at:end]
        elif kind == 1:
            out[at:end] = np.cumsum(rows[at:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[at:end] = np.cumsum(np.concatenate([above[None], rows[at:end]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for k in range(at, end):
                left = corner = 0
                line, up = rows[k].tolist(), (out[k - 1] if k else blank).tolist()
                for x, value in enumerate(line):
                    b = up[x]
                    if kind == 3:
                        guess = (left + b) >> 1
                    else:
                        p = left + b - corner
                        da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                        guess = left if da <= db and da <= dc else b if db <= dc else corner
                    left, corner = (value + guess) & 255, b
                    line[x] = left
                out[k] = line
        else:
            raise ValueError(f"unknown PNG filter {kind}")
        at = end
    return out


def read_png(data: bytes) -> np.ndarray:
    """The (lines, columns) of an 8-bit grey, non-interlaced PNG; raises ValueError where a checksum or the form is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, body, ended = 8, None, [], False
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(part) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged PNG chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown PNG chunk {kind!r}")
        at += size + 12
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    width, height = header[:2]
    rows = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(rows) != height * (width + 1):
        raise ValueError("image data of a wrong size")
    rows = rows.reshape(height, width + 1)
    return unfilter(rows[:, 0], rows[:, 1:])


def cosine_matrix(n: int, low: int) -> np.ndarray:
    """The first ``low`` rows of the orthonormal cosine transform of ``n`` values."""
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


_COSINES = cosine_matrix(GRID, LOW)


def averaged(pixels: np.ndarray) -> np.ndarray:
    """The image as GRID x GRID means of the pixels that each cell covers (a cell of few lines repeats one)."""
    out = pixels
    for axis in (0, 1):
        n = out.shape[axis]
        edges = np.arange(GRID) * n // GRID
        ends = np.maximum((np.arange(GRID) + 1) * n // GRID, edges + 1)
        total = np.concatenate([np.zeros_like(out[:1] if axis == 0 else out[:, :1], dtype=np.float64), np.cumsum(out, axis=axis, dtype=np.float64)], axis=axis)
        span = (ends - edges)[:, None] if axis == 0 else (ends - edges)[None, :]
        out = (total.take(ends, axis=axis) - total.take(edges, axis=axis)) / span
    return out


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies, but for the constant, lie above their median."""
    low = (_COSINES @ averaged(pixels) @ _COSINES.T).ravel().round(6)
    low[0] = 0
    return f"{int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), 'big'):016x}"


def store_images(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to lines of 64 pixels, as a PNG.

    A null or empty text gives one line of zeros; very long texts give as many lines as they need.
    Repeated rows and null ids are stored like any others; other columns are ignored; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8_list(batch.column(1))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                media = [write_png(np.frombuffer(padded(x), dtype=np.uint8).reshape(-1, WIDTH)) for x in part]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr(f"cast(`{id_column}` as bigint) as doc_id", f"`{text_column}` as text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def image_features(images: DataFrame) -> DataFrame:
    """What is read back from the column ``media``: payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes, media_sha256, feature; columns doc_id and n_bytes stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            media = batch.column("media").to_pylist()
            for data in media:
                pixels = read_png(data)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return images.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
