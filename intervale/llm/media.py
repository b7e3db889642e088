"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

Images are uint8 arrays of shape (height, width) or (height, width, 3). Defined results: null or undecodable bytes
give no image (None), and so do samples that are no numbers or lie outside their range; an image of any size resizes;
equal bytes give equal hashes.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text_batches, map_slices, table, text_of

#: Bytes in a row of the stored payload images; payloads are multiples of it.
ROW = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary Netpbm: P5 for one channel, P6 for three."""
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1-P6 as uint8 (bitmaps as 0 and 255; 16-bit samples by their high byte; other maxima scaled to 255)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    at, header = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("short Netpbm header")
        header.append(int(found[1]))
        at = found.end()
    width, height, most = header[0], header[1], (header[2] if len(header) > 2 else 1)
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("bad Netpbm header")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = width * height * (3 if kind in (b"P3", b"P6") else 1)
    if kind == b"P1":
        plain = np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:]), np.uint8)[:count].astype(np.int64) - 48
        if ((plain != 0) & (plain != 1)).any():
            raise ValueError("bad bitmap")
        values = (1 - plain) * 255
    elif kind in (b"P2", b"P3"):
        values = np.array([int(x) for x in re.sub(rb"#[^\n\r]*", b" ", data[at:]).split()[:count]], np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        values = (1 - bits[:, :width].astype(np.int64)).reshape(-1) * 255
    else:
        raw = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
        if most == 255:
            return raw.reshape(shape)
        values = raw.astype(np.int64)
    if len(values) != count:
        raise ValueError("short Netpbm data")
    if kind not in (b"P1", b"P4") and ((values < 0) | (values > most)).any():
        raise ValueError("sample out of range")
    if kind not in (b"P1", b"P4") and most != 255:
        values = values * 255 // most
    return values.astype(np.uint8).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    stride = (width * (1 if grey else 3) + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * (1 if grey else 3)] = image[::-1] if grey else image[::-1, :, ::-1].reshape(height, -1)
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if grey else b""
    offset = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits; a palette of greys gives one channel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    (offset,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("BMP of another kind")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if bits >= 24:
        step = bits // 8
        image = raw[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        if bits == 8:
            index = raw[:, :width]
        else:
            index = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            index = (index << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.uint8)[:, :width]
        (used,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + size).reshape(-1, 4)[:, 2::-1]
        image = palette[index]
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
            image = image[:, :, 0]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes | None) -> np.ndarray | None:
    """The image, or None where the bytes are null or neither format."""
    if not data:
        return None
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (ValueError, struct.error, IndexError, OverflowError, MemoryError):
        return None


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * size / parts
    low = np.minimum(at.astype(np.int64), size)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from an integral image: cost does not depend on the scale."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]), np.float64)
    np.cumsum(image, 0, np.float64, out=total[1:, 1:])
    np.cumsum(total[1:, 1:], 1, out=total[1:, 1:])
    row, row_rest = _edges(image.shape[0], height)
    column, column_rest = _edges(image.shape[1], width)
    below = np.minimum(row + 1, image.shape[0])
    right = np.minimum(column + 1, image.shape[1])
    row_rest, column_rest = (x.reshape(-1, 1, *[1] * (image.ndim - 2)) if k == 0 else x.reshape(1, -1, *[1] * (image.ndim - 2)) for k, x in enumerate((row_rest, column_rest)))
    top = total[row] * (1 - row_rest) + total[below] * row_rest
    at = top[:, column] * (1 - column_rest) + top[:, right] * column_rest
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    mean = sums * (height * width / (image.shape[0] * image.shape[1]))
    return np.clip(np.rint(mean), 0, 255).astype(np.uint8)


def npy_bytes(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of the tiles that cover the image; those at the far edges may be smaller."""
    return [(y, x, npy_bytes(image[y : y + side, x : x + side])) for y in range(0, image.shape[0], side) for x in range(0, image.shape[1], side)]


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 8 means is darker than its right neighbour."""
    grey = image if image.ndim == 2 else np.rint(image.astype(np.float64).mean(2)).astype(np.uint8)
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


_TILES = pa.list_(pa.struct([("row", pa.int32()), ("column", pa.int32()), ("npy", pa.binary())]))
SIDE, TILE = 32, 16


def described(image: np.ndarray | None, side: int = SIDE, tile: int = TILE) -> tuple[list[dict] | None, str | None]:
    """The NPY tiles of the image resized to side x side, and its difference hash."""
    if image is None:
        return None, None
    return [{"row": y, "column": x, "npy": b} for y, x, b in tiles(area_resize(image, side, side), tile)], difference_hash(image)


def media_features(df: DataFrame, column: str = "media", key: str = "doc_id", side: int = SIDE, tile: int = TILE) -> DataFrame:
    """For each row: key, height, width, tiles (array of row, column, npy) of the image resized to side x side, dhash.

    Null or undecodable media give nulls; rows are never dropped; other columns are left out.
    """
    schema = df.select(key).schema.simpleString()[7:-1] + ", height int, width int, tiles array<struct<row:int,column:int,npy:binary>>, dhash string"

    def work(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):  # one image at a time: what a batch holds is bounded by Spark, by rows and bytes
                image = decode(x.as_py())
                rows.append((*((None, None) if image is None else image.shape[:2]), *described(image, side, tile)))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            kinds = (pa.int32(), pa.int32(), _TILES, pa.string())
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[key, "height", "width", "tiles", "dhash"])

    by_text_batches(df.sparkSession)
    return df.select(key, F.col(column).cast("binary").alias("media")).mapInArrow(work, schema)


def payload_of(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW."""
    return raw + bytes((-len(raw)) % ROW or (0 if raw else ROW))


def stored_form(payload: bytes) -> bytes:
    """The payload as a grey image ROW pixels wide: Netpbm, or BMP where its number of rows is odd."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode_bmp(image) if len(image) % 2 else encode_pgm(image)


def media_digest(df: DataFrame) -> DataFrame:
    """Store each text's padded bytes as a grey image (stored_form), read the stored bytes back, describe both: digests,
    the image's difference hash as feature, and its NPY tiles.

    A null text counts as empty; rows are never dropped; repeated rows give repeated results.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<struct<row:int,column:int,npy:binary>>"

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in text_of(part.column(1)).cast(pa.large_binary()):
            raw = text.as_py()
            media = stored_form(payload_of(raw))
            image = decode(media)
            back = image.tobytes()
            cut, feature = described(image)
            out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature, cut))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _TILES)
        return pa.record_batch([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return map_slices(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
