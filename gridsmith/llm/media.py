"""Media columns: lossless 8-bit PNG samples, checked decoding, cosine-transform hashes.

``encode_png`` stores rows of 8-bit samples as a PNG; ``decode_png`` reads any
non-interlaced 8-bit PNG back: signature, chunk order, every chunk's CRC-32, the
zlib stream's own checksum, then the five row filters undone with numpy.
``cosine_hash`` reduces an image to 32 x 32 means and takes the signs of its
lowest 8 x 8 cosine coefficients against their median: 64 bits that survive
rescaling and small changes.

Null texts are empty; an empty text is one row of 192 spaces.  Equal texts give
equal values, and repeated rows repeated results.  Work is per row, with no
shuffle; a text of any length is one image of 192 samples a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
PAD = b" "
LEVEL = 1
HASH_SIDE, HASH_LOW = 32, 8
#: Channels of each PNG colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class MediaError(ValueError):
    """The stored bytes are not a whole, valid image."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, bpp: int) -> bytes:
    """Each row under the one of filters None, Sub and Up with the least sum of absolute values."""
    left = np.zeros_like(rows)
    left[:, bpp:] = rows[:, :-bpp]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tries = np.stack([rows, rows - left, rows - above])
    cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    pick = cost.argmin(axis=0)
    out = np.empty((rows.shape[0], rows.shape[1] + 1), np.uint8)
    out[:, 0] = pick
    out[:, 1:] = tries[pick, np.arange(rows.shape[0])]
    return out.tobytes()


def encode_png(samples: bytes, width: int = WIDTH, channels: int = 1, level: int = LEVEL, adaptive: bool = True) -> bytes:
    """Rows of 8-bit samples as a PNG.

    ``adaptive`` chooses a filter for each row (of those that undo as whole rows);
    without it rows are stored unfiltered.
    """
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    line = width * channels
    if not samples or len(samples) % line:
        raise MediaError("samples must fill a positive number of rows")
    rows = np.frombuffer(samples, np.uint8).reshape(-1, line)
    if adaptive:
        raw = _filtered(rows, channels)
    else:
        flat = np.zeros((rows.shape[0], line + 1), np.uint8)
        flat[:, 1:] = rows
        raw = flat.tobytes()
    head = struct.pack(">IIBBBBB", width, rows.shape[0], 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters; runs of rows without reference to each other go at once."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown row filter")
    n, line = rows.shape
    if not kinds.any():
        return rows
    sub = np.flatnonzero(kinds == 1)
    if sub.size:
        rows[sub] = np.cumsum(rows[sub].reshape(sub.size, -1, bpp), axis=1, dtype=np.uint8).reshape(sub.size, line)
    y = 0
    zero = np.zeros(line, np.uint8)
    while y < n:
        kind = kinds[y]
        if kind == 2:
            end = y
            while end < n and kinds[end] == 2:
                end += 1
            if y:
                rows[y] += rows[y - 1]
            rows[y:end] = np.cumsum(rows[y:end], axis=0, dtype=np.uint8)
            y = end
            continue
        if kind >= 3:
            # each sample needs the one before it: plain numbers are faster here than arrays of one
            row, up = bytearray(rows[y].tobytes()), (rows[y - 1] if y else zero).tobytes()
            a = c = 0
            for x in range(line):
                b = up[x]
                if x >= bpp:
                    a, c = row[x - bpp], up[x - bpp]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = (row[x] + guess) & 255
            rows[y] = np.frombuffer(row, np.uint8)
        y += 1
    return rows


def decode_png(stored: bytes) -> np.ndarray:
    """The samples as (height, width, channels); raises MediaError on any damage."""
    if stored[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, data, ended, last = 8, None, [], False, b""
    while at < len(stored):
        if at + 12 > len(stored):
            raise MediaError("cut chunk")
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if at + 12 + n > len(stored) or struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        at += 12 + n
        if head is None and kind != b"IHDR":
            raise MediaError("IHDR is not first")
        if kind == b"IHDR":
            if head is not None or n != 13:
                raise MediaError("IHDR is repeated or of a wrong length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            if data and last != b"IDAT":
                raise MediaError("IDAT chunks are parted")
            data.append(body)
        elif kind == b"IEND":
            ended = True
            break
        last = kind
    if head is None or not ended:
        raise MediaError("IHDR or IEND is missing")
    width, height, depth, colour, packing, filtering, laced = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or laced:
        raise MediaError("only non-interlaced images of 8 bits a sample")
    bpp = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width * bpp + 1):
        raise MediaError("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), bpp).reshape(height, width, bpp)


def _basis(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def _shrunk(gray: np.ndarray, side: int) -> np.ndarray:
    """Means of side x side blocks; images that are smaller than that are repeated by nearest rows or columns."""
    for axis in (0, 1):
        n = gray.shape[axis]
        if n >= side:
            cuts = np.arange(side) * n // side
            sizes = np.diff(np.append(cuts, n)).astype(float)
            gray = np.add.reduceat(gray, cuts, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
        else:
            gray = np.take(gray, np.arange(side) * n // side, axis=axis)
    return gray


_LOW = _basis(HASH_SIDE, HASH_LOW)


def cosine_hash(samples: np.ndarray) -> int:
    """64 bits: signs of the lowest 8 x 8 cosine coefficients against their median (the mean's is left out of the median)."""
    gray = samples.mean(axis=2) if samples.shape[2] > 1 else samples[:, :, 0].astype(np.float64)
    low = (_LOW @ _shrunk(gray, HASH_SIDE) @ _LOW.T).ravel().round(6)
    bits = low > np.median(low[1:])
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def store_and_describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text's bytes as a grey PNG, read it back and describe what was read.

    ``with_media`` adds the stored bytes as the binary column ``media`` and the
    hash as ``hash_bytes``.
    """
    schema = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    if with_media:
        schema |= {"media": "binary", "hash_bytes": "binary"}

    def make():
        def apply(keys, texts):
            out = [[] for _ in schema]
            for key, text in zip(keys, texts, strict=True):
                data = (text or "").encode()
                media = encode_png(data + PAD * (-len(data) % WIDTH or (0 if data else WIDTH)))
                samples = decode_png(media)
                payload = samples.tobytes()
                feature = cosine_hash(samples)
                row = (key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{feature:016x}", media, feature.to_bytes(8, "big"))
                for column, value in zip(out, row, strict=False):
                    column.append(value)
            return out

        return apply

    return arrow_map(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document stored as an image, read back and described."""
    return store_and_describe(table(spark, sf_dir, "documents"))
