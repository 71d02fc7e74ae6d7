"""Images as columns: Netpbm and BMP bytes, numpy arrays, tiles and hashes.

Decoded forms: Netpbm P1 to P6 with up to 8 bits a sample, and uncompressed BMP of
1, 4, 8, 24 or 32 bits a pixel, bottom-up or top-down. Tiles are area averages read off
an integral image, kept as NPY bytes; a difference hash tells for each pixel of
a 9 x 8 average whether its right neighbour is brighter.
"""
from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.scratch import new_path, text_of

#: Bytes are padded to a multiple of this, the width of the image that holds them.
WIDTH = 64
TILE = (16, 16)


class BadImage(ValueError):
    """Not an image of a form that is read here."""


# ------------------------------------------------------------------ forms
def encode_pgm(gray: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes()


def encode_ppm(rgb: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (rgb.shape[1], rgb.shape[0]) + rgb.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Gray as 8 bits with a gray palette, RGB as 24 bits; rows bottom-up."""
    height, width = image.shape[:2]
    gray = image.ndim == 2
    pixels = image if gray else image[:, :, ::-1]
    line = pixels.reshape(height, -1)
    pad = -line.shape[1] % 4
    if pad:
        line = np.pad(line, ((0, 0), (0, pad)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if gray else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.nbytes
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + line.size, 0, 0, start, 40, width, height, 1,
                       8 if gray else 24, 0, line.size, 2835, 2835, 256 if gray else 0, 0)
    return head + palette.tobytes() + line[::-1].tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([0-9]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise BadImage("a header that ends early")
        numbers.append(int(m[1]))
        at = m.end()
    width, height = numbers[:2]
    most = numbers[2] if len(numbers) > 2 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    if not 0 < most < 256:
        raise BadImage("more than 8 bits a sample")
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\r\n]*", b" ", data[at:]).split()[:count], dtype=np.uint8)
    elif kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:count], np.uint8) - ord("0")
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at + 1).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8, count, at + 1)
    if len(flat) != count:
        raise BadImage("fewer samples than the header says")
    if kind in (b"P1", b"P4"):
        flat = (1 - flat) * np.uint8(255)       # 1 is black
    elif most != 255:
        flat = (flat.astype(np.uint16) * 255 // most).astype(np.uint8)
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    start, head, width, height, _planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (1, 4, 8, 24, 32):
        raise BadImage(f"BMP of {bits} bits, packing {packing}")
    rows, used = abs(height), struct.unpack_from("<I", data, 46)[0]
    stride = (width * bits + 31) // 32 * 4
    lines = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if bits >= 24:
        step = bits // 8
        return np.ascontiguousarray(lines[:, :width * step].reshape(rows, width, step)[:, :, 2::-1])
    if bits == 8:
        index = lines[:, :width]
    else:
        index = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)
        index = (index << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, :width]
    palette = np.frombuffer(data, np.uint8, 4 * (used or 1 << bits), 14 + head).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return np.ascontiguousarray(palette[:, 0][index])
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if re.match(rb"P[1-6]\s", data):
        return decode_netpbm(data)
    raise BadImage("neither Netpbm nor BMP")


# ------------------------------------------------------------------ features
def gray_of(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return (image @ np.array([299, 587, 114]) // 1000).astype(np.uint8)


def _at_edges(sums: np.ndarray, parts: int) -> np.ndarray:
    """An integral over axis 0, read at the borders of equal parts (between two lines it is linear)."""
    borders = np.linspace(0, len(sums) - 1, parts + 1)
    low = np.minimum(borders.astype(np.int64), len(sums) - 2)
    share = (borders - low).reshape(-1, *[1] * (sums.ndim - 1))
    return sums[low] * (1 - share) + sums[low + 1] * share


def area_resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean brightness of each cell of a height x width grid, as float64."""
    rows, columns = gray.shape
    across = np.zeros((columns + 1, rows), np.int64)
    np.cumsum(gray.T, axis=0, dtype=np.int64, out=across[1:])
    strips = np.diff(_at_edges(across, width), axis=0)
    down = np.zeros((rows + 1, width))
    np.cumsum(strips.T, axis=0, out=down[1:])
    cells = np.diff(_at_edges(down, height), axis=0)
    return cells * (height * width / (rows * columns))


def difference_hash(gray: np.ndarray) -> str:
    cells = np.round(area_resized(gray, 8, 9), 6)
    return f"{int.from_bytes(np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes(), 'big'):016x}"


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(tile), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


# ------------------------------------------------------------------ columns
def payload_image(data: bytes) -> np.ndarray:
    """The bytes as samples of an image of WIDTH columns, with zeros at the end."""
    rows = max(1, -(-len(data) // WIDTH))
    return np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a gray image, a PGM where it has an odd
    number of lines, else a BMP. Null is the empty text: one line of zeros. Equal texts
    give equal bytes. Rows stay as they are, null identifiers too; other columns go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                media = []
                for data in part.column("data"):
                    image = payload_image(data.as_py())
                    media.append(encode_pgm(image) if len(image) % 2 else encode_bmp(image))
                yield pa.record_batch([part.column("id"), part.column("n_bytes"), pa.array(media, pa.binary())],
                                      ["id", "n_bytes", "media"])
    kind = docs.schema[id_col].dataType.simpleString()
    data = docs.select(F.col(id_col).alias("id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
                       text_of(text_col).cast("binary").alias("data"))
    return data.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def stored(media: DataFrame) -> DataFrame:
    """The column written to the shared folder and read back from there."""
    spark = media.sparkSession
    path = new_path(spark, "media")
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def media_features(media: DataFrame, media_col: str = "media", tile: tuple[int, int] = TILE) -> DataFrame:
    """The other columns of ``media`` with digests of the decoded samples and of the
    stored bytes, the difference hash and the NPY tile of each image. A null image has
    null features; bytes that are no image raise BadImage."""
    others = [f for f in media.schema if f.name != media_col]
    names = [f.name for f in others] + [x.split(" ")[0] for x in _FEATURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def features(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(kinds)
        image = decode(data)
        samples, gray = image.tobytes(), gray_of(image)
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data),
                hashlib.sha256(data).hexdigest(), difference_hash(gray), npy(area_resized(gray, *tile)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [features(x.as_py()) for x in part.column(media_col)]
                yield pa.record_batch([*(part.column(f.name) for f in others),
                                       *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), _FEATURES])
    return media.mapInArrow(run, schema)
