"""Media columns: Netpbm and BMP images decoded to numpy arrays, area-resized by
integral images, and returned as NPY tiles with difference hashes.

``media_tiles`` is map-only: a row in, a row out, and a batch is answered in
slices of about a megabyte, so a task holds little however many images it has.

Decoded are Netpbm P1 to P6 (plain and raw, 1 to 16 bits a sample, comments in
headers) and uncompressed BMP of 1, 4, 8, 24 and 32 bits (with palettes, rows in
either order).  An area resize averages exactly the input area under each output
sample, also where edges cut through samples: the integral image is interpolated
at the output's edges, so the cost does not depend on the scale, and made by strips
of rows, so that an image of any size takes a few megabytes besides itself.  A difference
hash compares neighbours in an 8 x 9 resize of the brightness: 64 bits as hex.

Defined cases.  A null, empty, cut or unknown image gives null results and a
message in ``error``, and so does one with a sample above its own largest value;
other rows are not affected.  Equal bytes give equal rows.  Columns whose names the
result adds are a ValueError.  An empty table gives no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean

TILE = 32
_SLICE = 1 << 20
_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")
RESULT = "width int, height int, channels int, samples binary, tile binary, dhash string, error string"


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Height x width (x 3) samples, uint8 or uint16; bitmaps have 1 for black, as stored."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, header = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m or not m[1].isdigit():
            raise ValueError("bad Netpbm header")
        header.append(int(m[1]))
        at = m.end()
    w, h, top = header[0], header[1], header[2] if len(header) > 2 else 1
    if not (w and h and 0 < top < 65536):
        raise ValueError("bad Netpbm size")
    channels = 3 if kind in (b"P3", b"P6") else 1
    n, dtype = w * h * channels, np.dtype(np.uint8 if top < 256 else ">u2")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b" ", raw[at:])
        values = list(re.findall(rb"[01]", body)) if kind == b"P1" else body.split()
        if len(values) < n:
            raise ValueError("image is cut")
        whole = [int(v) for v in values[:n]]
        if max(whole) > top:
            raise ValueError("a sample is above the largest value")
        out = np.array(whole, dtype)
    else:
        at += 1  # one blank ends the header
        stride = (w + 7) // 8
        need = stride * h if kind == b"P4" else n * dtype.itemsize
        if len(raw) - at < need:
            raise ValueError("image is cut")
        if kind == b"P4":
            return np.unpackbits(np.frombuffer(raw, np.uint8, need, at).reshape(h, stride), axis=1)[:, :w]
        out = np.frombuffer(raw, dtype, n, at)
        if top not in (255, 65535) and out.max() > top:
            raise ValueError("a sample is above the largest value")
    return out.astype(dtype.newbyteorder("=")).reshape((h, w, 3) if channels == 3 else (h, w))


def encode_netpbm(image: np.ndarray) -> bytes:
    """Raw PGM or PPM of uint8 or uint16 samples."""
    top = 255 if image.dtype == np.uint8 else 65535
    head = b"P%d\n%d %d\n%d\n" % (6 if image.ndim == 3 else 5, image.shape[1], image.shape[0], top)
    return head + image.astype(np.uint8 if top == 255 else ">u2").tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Height x width x 3 (red, green, blue) uint8 samples."""

    def field(at: int, size: int, signed: bool = False) -> int:
        if at + size > len(raw):
            raise ValueError("image is cut")
        return int.from_bytes(raw[at : at + size], "little", signed=signed)

    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size = field(10, 4), field(14, 4)
    if size < 40:
        raise ValueError("BMP header of an old kind")
    w, h, bits, packed = field(18, 4, True), field(22, 4, True), field(28, 2), field(30, 4)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or not h:
        raise ValueError("BMP of a kind that is not supported")
    stride, rows = (w * bits + 31) // 32 * 4, abs(h)
    if len(raw) < start + stride * rows:
        raise ValueError("image is cut")
    body = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    if h > 0:
        body = body[::-1]
    if bits >= 24:
        return body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        index = body[:, :w]
    else:
        index = np.unpackbits(body, axis=1)
        if bits == 4:
            index = index.reshape(rows, -1, 4) @ np.array([8, 4, 2, 1], np.uint8)
        index = index[:, :w]
    colours = field(46, 4) or 1 << bits
    at = 14 + size
    if len(raw) < at + 4 * colours or index.max() >= colours:
        raise ValueError("palette is cut")
    return np.frombuffer(raw, np.uint8, 4 * colours, at).reshape(-1, 4)[:, 2::-1][index]


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit BMP of height x width x 3 uint8 samples."""
    h, w, _ = image.shape
    stride = (3 * w + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    sizes = [(14 + 40 + stride * h, 4), (0, 4), (54, 4), (40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (stride * h, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
    return b"BM" + b"".join(v.to_bytes(n, "little") for v, n in sizes) + body.tobytes()


def decode(raw: bytes) -> np.ndarray:
    return decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)


def area_resize(image: np.ndarray, height: int, width: int, strip: int = 1 << 18) -> np.ndarray:
    """Mean of the input area under each output sample, as float64; holds about ``strip`` samples, or one row."""
    h, w, more = *image.shape[:2], image.shape[2:]
    each = max(1, strip // max(1, int(np.prod(image.shape[1:]))))

    def edges(n: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(to + 1) * n / to
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (row, part), (col, share) = edges(h, height), edges(w, width)
    cut = np.empty((height + 1, width + 1, *more))  # the integral image at the output's corners
    above = np.zeros((1, w, *more))  # column sums of all rows before the strip
    for lo in range(0, h, each):
        sums = np.concatenate([above, image[lo : lo + each]])
        np.cumsum(sums, axis=0, out=sums)
        own = np.flatnonzero((row >= lo) & (row < lo + each))
        for k in range(0, len(own), each):
            e = own[k : k + each]
            x = sums[row[e] - lo]
            x += (sums[row[e] - lo + 1] - x) * part[e].reshape(-1, *[1] * (x.ndim - 1))
            total = np.zeros((len(e), w + 1, *more))
            np.cumsum(x, axis=1, out=total[:, 1:])
            left = total[:, col]
            cut[e] = left + (total[:, col + 1] - left) * share.reshape(1, -1, *[1] * len(more))
        above = sums[-1:].copy()
    return np.diff(np.diff(cut, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> str:
    small = area_resize(image, 8, 9)
    grey = np.round(small if image.ndim == 2 else small @ np.array([0.299, 0.587, 0.114]), 6)
    return np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def npy_bytes(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def tile_of(image: np.ndarray, size: int) -> np.ndarray:
    """A resize to ``size`` x ``size`` in the image's own sample type, halves to even."""
    return np.rint(area_resize(image, size, size)).astype(image.dtype)


def media_tiles(images: DataFrame, *, media_col: str = "media", size: int = TILE) -> DataFrame:
    """The rows of ``images`` with ``width, height, channels, samples, tile, dhash, error`` besides.

    ``samples`` are the decoded samples, row by row, little-endian; ``tile`` is an
    NPY file of ``size`` x ``size`` samples.
    """
    cols = images.columns
    at = cols.index(media_col)
    if clash := {c.lower() for c in cols} & {"width", "height", "channels", "samples", "tile", "dhash", "error"}:
        raise ValueError(f"columns that the result adds: {sorted(clash)}")
    added = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("samples", pa.binary()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def one(raw: bytes | None) -> tuple:
        try:
            if not raw:
                raise ValueError("no image")
            image = decode(raw)
            body = image.astype(image.dtype.newbyteorder("<")).tobytes()
            return image.shape[1], image.shape[0], 3 if image.ndim == 3 else 1, body, npy_bytes(tile_of(image, size)), difference_hash(image), None
        except ValueError as e:
            return None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, out = 0, 0, []
            for i, value in enumerate(batch.column(at)):
                out.append(one(value.as_py()))
                held += len(out[-1][3] or b"")
                if held > _SLICE or i + 1 == batch.num_rows:
                    more = [pa.array(c, f.type) for c, f in zip(zip(*out), added)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(out)).columns, *more], [*cols, *added.names])
                    first, held, out = i + 1, 0, []

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInArrow(lean(run), f"{fields}, {RESULT}")


def text_image(text: Column, width: int = 64) -> Column:
    """A raw PGM whose samples are the UTF-8 bytes of a text (null: empty), then zeros up to full rows."""
    body = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / width)).cast("int")
    head = F.encode(F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    return F.concat(head, F.rpad(body, rows * width, F.lit(bytearray(1))))
