"""Media columns: Netpbm and BMP decoded to numpy, area-resized by integral images, written as NPY tiles.

A payload of any bytes is kept losslessly as the samples of a 64 pixel wide, 8-bit RGB picture.
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
from pyspark.sql import functions as F

WIDTH = 64
ROW = WIDTH * 3


def encode_ppm(pixels: np.ndarray) -> bytes:
    """(h, w, 3) or (h, w) uint8 as binary PPM (P6) or PGM (P5)."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with up to 8 bits a sample: (h, w) for bitmaps and greymaps, (h, w, 3) for pixmaps.

    Samples keep their values (bitmaps: 0 white, 255 black turned to 0 black, 255 white).
    """
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    fields, at = [], 2
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h = fields[:2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        if fields[2] > 255:
            raise ValueError("more than 8 bits a sample")
        flat = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
        flat = ((1 - bits) * 255).astype(np.uint8)
    elif kind == b"P1":
        digits = [c for c in data[at:] if c in b"01"]
        flat = np.array([255 * (c == 48) for c in digits[: w * h]], np.uint8)
    else:
        flat = np.array(data[at:].split()[: w * h * depth], dtype=np.uint8)
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def encode_bmp(pixels: np.ndarray) -> bytes:
    """(h, w, 3) uint8 RGB as an uncompressed 24-bit bottom-up BMP."""
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHI", b"BM", 54 + h * stride, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0) + rows.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP as (h, w, 3) RGB."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packed = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("this kind of BMP isn't read")
    up, h = h > 0, abs(h)
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, h * stride, start).reshape(h, stride)[:, : w * bits // 8]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, offset=14 + head, count=start - 14 - head).reshape(-1, 4)
        out = colours[rows][:, :, 2::-1]
    else:
        out = rows.reshape(h, w, bits // 8)[:, :, 2::-1]
    return out[::-1] if up else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each target pixel covers, fractions of pixels counted, by an integral image."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(table: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
        low = np.minimum(np.floor(pos).astype(int), n - 1)
        part = (pos - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    ys, xs = np.arange(height + 1) * (h / height), np.arange(width + 1) * (w / width)
    sums = np.diff(np.diff(at(at(total, ys, h).T, xs, w).T, axis=0), axis=1)
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 area means is below its right neighbour's."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:] - 1e-9).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def read_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and these bytes with spaces up to a positive multiple of a row."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * ((-len(raw)) % ROW or (0 if raw else ROW))


def picture_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int64()), ("tiles_sha256", pa.string()), ("tile_hashes_sha256", pa.string())]
)


def tiles_of(data: bytes, tile: int = 64, height: int = 0, width: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, col, tile) of the decoded greymap of a file, area-resized if height and width are given."""
    image = grey(decode(data))
    if height and width:
        image = area_resize(image, height, width)
    image = np.floor(image + 0.5).astype(np.uint8)
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            yield y // tile, x // tile, image[y : y + tile, x : x + tile]


def tiles_digest(data: bytes) -> tuple[int, str, str]:
    """Number of a file's tiles, the SHA-256 of their NPY files one after another, and that of the difference hashes of the tiles read back from these."""
    n, files, hashes = 0, hashlib.sha256(), hashlib.sha256()
    for _, _, part in tiles_of(data):
        n += 1
        stored = npy(part)
        files.update(stored)
        hashes.update(difference_hash(read_npy(stored)).encode())
    return n, files.hexdigest(), hashes.hexdigest()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, payload = payload_of(text.as_py())
            stored = encode_ppm(picture_of(payload))
            back = decode(stored)
            read = back.tobytes()
            rows.append((i, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(grey(back)), *tiles_digest(encode_bmp(picture_of(payload)))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a PPM picture, read it back, and return digests and the difference hash.

    n_tiles and tiles_sha256 are of the NPY tiles that media_tiles() cuts from the same picture as BMP, and
    tile_hashes_sha256 of the difference hashes of these tiles, read back.

    A null text is empty (one row of spaces). Null ids and repeated rows pass through; an empty table gives an empty result; other columns
    are not read; equal texts give equal values. Rows never meet: no shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string, tile_hashes_sha256 string")


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "ppm") -> DataFrame:
    """(media_id, media): each text's payload as a PPM or BMP file in a binary column."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = encode_bmp if kind == "bmp" else encode_ppm
        for batch in batches:
            files = [store(picture_of(payload_of(t.as_py())[1])) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["media_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("media_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(apply, "media_id long, media binary")


def media_tiles(media: DataFrame, tile: int = 64, height: int = 0, width: int = 0) -> DataFrame:
    """(media_id, row, col, npy, dhash, error): the decoded greymap of each file, area-resized if height and
    width are given, cut into tiles of at most tile x tile as NPY bytes, each with its difference hash.

    A null or unreadable file gives one row with nulls and the reason in `error`.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for y, x, part in tiles_of(data.as_py() or b"", tile, height, width):
                        rows.append((i, y, x, npy(part), difference_hash(part), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(i, None, None, None, None, str(e) or type(e).__name__)]
                if rows:
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["media_id", "row", "col", "npy", "dhash", "error"])

    return media.select(F.col("media_id").cast("long"), "media").mapInArrow(apply, "media_id long, row int, col int, npy binary, dhash string, error string")
