"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import map_texts, slices

#: Samples in a row of the image that holds a payload; payloads are padded with zero bytes to a multiple of it.
WIDTH = 64
#: Height and width of the tiles that images are resized to.
TILE = 16
#: Samples that are summed at a time.
STRIP = 1 << 20

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def to_pgm(samples: np.ndarray) -> bytes:
    """A grey image (height, width) of uint8 as binary PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def to_bmp(samples: np.ndarray) -> bytes:
    """A grey image (height, width) of uint8 as an 8-bit BMP with a grey palette, rows bottom up, padded to 4 bytes."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    grey = np.arange(256, dtype=np.uint8)
    palette = np.stack([grey, grey, grey, np.zeros(256, np.uint8)], axis=1)
    return head + info + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        found = _TOKEN.match(data, at)
        if found is None:
            raise ValueError("the header ends early")
        fields.append(int(found[1]))
        at = found.end()
    width, height, most = *fields[:2], fields[2] if len(fields) > 2 else 1
    depth = 3 if kind in b"36" else 1
    size = width * height * depth
    if kind in b"123":
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == b"1" else body.split())], np.int64)[:size]
    elif kind == b"4":
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        values = np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", size, at + 1)
    if values.size < size:
        raise ValueError("the image ends early")
    if kind in b"14":
        values, most = 1 - values, 1
    if most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // max(1, most)
    return values.astype(np.uint8, copy=False).reshape(height, width, depth)


def _bmp(data: bytes) -> np.ndarray:
    start, info = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packing} is not supported")
    stride = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    if height > 0:
        rows = rows[::-1]
    if bits >= 24:
        step = bits // 8
        return rows[:, : width * step].reshape(abs(height), width, step)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + info).reshape(used, 4)[:, 2::-1]
    if bits < 8:
        split = np.unpackbits(rows, axis=1).reshape(rows.shape[0], -1, bits)
        rows = split @ (1 << np.arange(bits)[::-1])
    pixels = palette[rows[:, :width]]
    return pixels[:, :, :1].copy() if (palette == palette[:, :1]).all() else pixels


def decode(data: bytes) -> np.ndarray:
    """An image (height, width, channels) of uint8 from Netpbm (P1 to P6) or uncompressed BMP bytes."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _edges(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(cells + 1) * (size / cells)
    low = np.minimum(at.astype(np.int64), size - 1)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target cell covers, pixels cut at its borders counted in part.

    The sums come from one integral image, read between its entries where a border cuts a pixel, so the cost does not
    depend on how many pixels a cell covers. The image is summed STRIP pixels at a time and only the integral's rows at
    the cells' borders are kept.
    """
    rows, cols, depth = image.shape
    (top, dy), (left, dx) = _edges(rows, height), _edges(cols, width)
    wanted = np.unique(np.r_[top, top + 1])
    total, sums = np.zeros((len(wanted), cols + 1, depth)), np.zeros((cols, depth))
    step = max(1, STRIP // max(1, cols * depth))
    for at in range(0, rows, step):
        strip = image[at : at + step].cumsum(0, dtype=np.float64) + sums
        here = (wanted > at) & (wanted <= at + len(strip))
        total[here, 1:] = strip[wanted[here] - at - 1].cumsum(1)
        sums = strip[-1]
    lower, upper = total[np.searchsorted(wanted, top)], total[np.searchsorted(wanted, top + 1)]
    part = lower + dy[:, None, None] * (upper - lower)
    part = part[:, left] + dx[None, :, None] * (part[:, left + 1] - part[:, left])
    cells = part[1:, 1:] - part[:-1, 1:] - part[1:, :-1] + part[:-1, :-1]
    return cells * (height * width / (rows * cols))


def dhash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: for an 8 by 9 resize, whether each cell is brighter than the one left of it."""
    grey = area_resize(image, 8, 9).mean(axis=2)
    return np.packbits(grey[:, 1:] > grey[:, :-1] + 1e-9).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to ``size`` by ``size``, rounded to uint8, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, size, size)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def pack(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text, padded with zero bytes to a positive multiple of WIDTH, as rows of samples."""
    data = text.encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // WIDTH))
    return np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


_SCHEMA = "height int, width int, channels int, samples binary, tile binary, dhash string"


def _describe(image: np.ndarray | None, size: int) -> tuple:
    if image is None or not image.size:
        return None, None, None, None, None, None
    return (*image.shape, image.tobytes(), npy_tile(image, size), dhash(image))


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
    return [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]


def decode_media(df: DataFrame, id_col: str, media_col: str, tile: int = TILE) -> DataFrame:
    """Each row's id with the decoded image of a binary column: height, width, channels, samples, NPY tile and dhash.

    Bytes that are null, cut short or of no supported format give nulls; nothing fails for one bad image. Repeated rows
    are each decoded, a null id stays null, other columns are ignored, and an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 64):
                rows = []
                for data in part.column(1).to_pylist():
                    try:
                        image = None if data is None else decode(data)
                    except (ValueError, struct.error, IndexError):
                        image = None
                    rows.append(_describe(image, tile))
                yield pa.RecordBatch.from_arrays([part.column(0), *_columns(rows)], names=names)

    source = df.select(F.col(id_col).alias("k"), F.col(media_col).cast("binary").alias("m"))
    names = ["k", *[x.split()[0] for x in _SCHEMA.split(", ")]]
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, {_SCHEMA}").withColumnRenamed("k", id_col)


def text_images(form: str, size: int) -> Callable[[list[str]], list[pa.Array]]:
    """A function from texts to arrays: stored image bytes, then what decode_media gives for those."""
    write = {"pgm": to_pgm, "bmp": to_bmp}[form]

    def run(texts: list[str]) -> list[pa.Array]:
        stored = [write(pack(t)) for t in texts]
        return [pa.array(stored, pa.binary()), *_columns([_describe(decode(x), size) for x in stored])]

    return run


def texts_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", tile: int = TILE) -> DataFrame:
    """Store each whole text losslessly as a grey image and read it back: ``media``, then the columns of decode_media.

    ``samples`` are the payload as read back: UTF-8 bytes and zero bytes up to a positive multiple of 64. Null and empty
    texts give one row of 64 zero samples. Equal texts give equal values, whatever their id. One pass, no shuffle; the
    largest thing held is a slice of up to 64 texts or the longest text. Repeated rows are each stored and other columns ignored.
    """
    return map_texts(df, id_col, text_col, f"media binary, {_SCHEMA}", text_images(form, tile), rows=64)
