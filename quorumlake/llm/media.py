"""Media columns: Netpbm and BMP images decoded to numpy arrays, resized by area with integral images, and kept as NPY
tiles with difference hashes.

Defined results: null bytes and broken images give null columns; a null text is stored as an empty one; equal inputs
give equal outputs, so repeated rows agree; an empty table gives no rows. Nothing but the named columns is read, so
further columns don't matter.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROW = 192


def scaled(values: np.ndarray, top: int) -> np.ndarray:
    """Values from 0 to top as bytes from 0 to 255."""
    if not 0 < top < 65536:
        raise ValueError("maxval out of range")
    return values.astype(np.uint8) if top == 255 else np.rint(np.minimum(values, top) * (255 / top)).astype(np.uint8)


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary or plain PBM, PGM and PPM as (height, width, channels), scaled from any maxval to bytes."""
    kind, at, numbers = data[:2], 2, []
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    width, height = numbers[:2]
    if kind in (b"P5", b"P6"):
        channels = 3 if kind == b"P6" else 1
        return scaled(np.frombuffer(data, np.uint8 if numbers[2] < 256 else ">u2", width * height * channels, at + 1), numbers[2]).reshape(height, width, channels)
    if kind == b"P1":
        bits = np.array([c - 48 for c in data[at:] if c in b"01"][: width * height], np.uint8).reshape(height, width, 1)
        return (1 - bits) * np.uint8(255)
    if kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    if kind in (b"P2", b"P3"):
        channels = 3 if kind == b"P3" else 1
        return scaled(np.array([int(x) for x in data[at:].split()[: width * height * channels]], np.int64), numbers[2]).reshape(height, width, channels)
    raise ValueError("not a Netpbm image of a known kind")


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 24 or 32 bits, or of 1, 4 or 8 bits with a palette, as (height, width, 3)."""
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if header < 40 or bits not in (1, 4, 8, 24, 32) or packed not in ((0, 3) if bits > 8 else (0,)):
        raise ValueError("not a BMP image of a known kind")
    step = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)
    if bits <= 8:
        colors = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colors, 14 + header).reshape(colors, 4)[:, 2::-1]
        held = np.unpackbits(rows, axis=1)[:, : width * bits].reshape(abs(height), width, bits)
        pixels = palette[held @ (1 << np.arange(bits)[::-1])]
        return pixels[::-1] if height > 0 else pixels
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_ppm(payload: bytes) -> bytes:
    """A payload of whole rows of 192 bytes as an image 64 pixels wide."""
    return b"P6\n64 %d\n255\n" % (len(payload) // ROW) + payload


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by bilinear reads of the integral image, so that parts of pixels count in part."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def read(axis: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(axis.astype(np.int64), n - 1)
        part = (axis - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    cells = read(xs, w, read(ys, h, total).T).T
    return np.diff(np.diff(cells, axis=0), axis=1) * (height * width) / (h * w)


def gray_of(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0].astype(np.float64) if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(gray: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 means is below the one on its right."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tile_of(gray: np.ndarray, side: int) -> bytes:
    return npy(np.clip(np.rint(area_resize(gray, side, side)), 0, 255).astype(np.uint8))


def image_columns(df: DataFrame, key: str, image: str, side: int = 32) -> DataFrame:
    """For a column of image bytes: key, height, width, tile (NPY bytes of side x side gray) and dhash. Any writer of Spark stores them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1):
                try:
                    pixels = decode(data.as_py())
                    gray = gray_of(pixels)
                    rows.append((*pixels.shape[:2], tile_of(gray, side), difference_hash(gray)))
                except (ValueError, TypeError, IndexError, struct.error):
                    rows.append((None,) * 4)
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], [key, "height", "width", "tile", "dhash"])

    return df.select(key, image).mapInArrow(of, f"{key} {dict(df.dtypes)[key]}, height int, width int, tile binary, dhash string")


#: An output batch is passed on at this many bytes.
FLUSH = 4 << 20


def text_media(df: DataFrame, key: str = "doc_id", text: str = "text", side: int = 32, keep_bytes: bool = True) -> DataFrame:
    """Each text stored as an image, read back and described: the key, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature (the difference hash) and tile_sha256; with keep_bytes also media
    (the image) and tile (NPY bytes)."""
    fields = [(key, None), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile_sha256", pa.string()), ("media", pa.binary()), ("tile", pa.binary())]
    fields = fields if keep_bytes else fields[:-2]

    def row(value: str | None) -> tuple:
        raw = (value or "").encode("utf-8", "surrogatepass")
        media = encode_ppm(raw + b" " * (-len(raw) % ROW or (0 if raw else ROW)))
        pixels = decode(media)
        back, gray = pixels.tobytes(), gray_of(pixels)
        tile = tile_of(gray, side)
        out = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(gray), hashlib.sha256(tile).hexdigest())
        return (*out, media, tile) if keep_bytes else out

    def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([keys, *[pa.array(c, kind) for c, (_, kind) in zip(cols, fields[1:], strict=True)]], [n for n, _ in fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, begin, held = [], 0, 0
            for i, value in enumerate(b.column(1)):
                rows.append(row(value.as_py()))
                held += rows[-1][1] if keep_bytes else 200
                if held >= FLUSH:
                    yield batch(b.column(0).slice(begin, len(rows)), rows)
                    rows, begin, held = [], i + 1, 0
            if rows:
                yield batch(b.column(0).slice(begin, len(rows)), rows)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([f"`{key}` {dict(df.dtypes)[key]}", *[f"{n} {kinds[k]}" for n, k in fields[1:]]])
    return df.select(key, text).mapInArrow(of, schema)
