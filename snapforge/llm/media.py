"""Media columns: lossless PNG images in binary columns, read back with checksum tests, and perceptual hashes.

Writer and reader are plain: zlib for the pixel stream, CRC-32 for every chunk, numpy for row filters
and their inverse. The hash is that of the image's low frequencies: grey levels on a 32 x 32 grid,
cosine transform, signs of the lowest 8 x 8 coefficients against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapforge.llm.common import texts

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of a row of WIDTH pixels of three 8-bit samples.
ROW = 3 * WIDTH
GRID, LOW = 32, 8
_K = np.arange(GRID)
COSINES = np.cos(np.pi * (2 * _K[None, :] + 1) * _K[:LOW, None] / (2 * GRID))


def pad(data: bytes, to: int = ROW) -> bytes:
    """data with bytes 32 up to a positive multiple of `to`."""
    return data + b" " * (max(to, -(-len(data) // to) * to) - len(data))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """payload, a positive multiple of ROW bytes, as a truecolour PNG of WIDTH pixels a row.

    Each row takes the filter of None, Sub and Up whose signed residuals have the least sum.
    """
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub = pixels.copy()
    sub[:, 3:] -= pixels[:, :-3]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (pixels, sub, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((len(pixels), ROW + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 0)[:, None], pixels, np.where((kind == 1)[:, None], sub, up))
    head = struct.pack(">IIBBBBB", WIDTH, len(pixels), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five row filters. Runs of rows with one filter go at once where numpy can do so."""
    out = rows.copy()
    n = len(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, n], strict=True) if n else ():
        kind = kinds[a]
        if kind == 1:
            x = out[a:b].reshape(b - a, -1, bpp)
            np.cumsum(x, axis=1, dtype=np.uint8, out=x)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for r in range(a, b):
                above = out[r - 1].astype(np.int32) if r else np.zeros(out.shape[1], np.int32)
                line = out[r].astype(np.int32)
                for i in range(0, len(line), bpp):
                    left = line[i - bpp : i] if i else np.zeros(bpp, np.int32)
                    over = above[i : i + bpp]
                    if kind == 3:
                        guess = (left + over) >> 1
                    else:
                        corner = above[i - bpp : i] if i else np.zeros(bpp, np.int32)
                        p = left + over - corner
                        dl, do, dc = abs(p - left), abs(p - over), abs(p - corner)
                        guess = np.where((dl <= do) & (dl <= dc), left, np.where(do <= dc, over, corner))
                    line[i : i + bpp] = (line[i : i + bpp] + guess) & 255
                out[r] = line
        elif kind:
            raise ValueError(f"no such row filter: {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples as (height, width, channels) of an 8-bit, non-interlaced PNG. Bad structure or checksums raise ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, stream, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("no head or no end")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit samples without palette or interlacing")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    except zlib.error as error:
        raise ValueError("bad pixel stream") from error
    if raw.size != height * (width * channels + 1):
        raise ValueError("the pixel stream has another size")
    raw = raw.reshape(height, width * channels + 1)
    return unfilter(raw[:, 0], raw[:, 1:], channels).reshape(height, width, channels)


def grid(samples: np.ndarray, size: int = GRID) -> np.ndarray:
    """Grey levels on size x size cells: means where an image is larger than the grid, its nearest pixels where it is smaller."""
    grey = samples[..., :3].mean(axis=2) if samples.shape[2] >= 3 else samples[..., 0].astype(float)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n >= size:
            edges = np.arange(size + 1) * n // size
            grey = np.add.reduceat(grey, edges[:-1], axis=axis) / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
        else:
            grey = np.take(grey, np.arange(size) * n // size, axis=axis)
    return grey


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: which of the lowest 8 x 8 cosine coefficients, the mean's aside, are above the median of them."""
    low = np.round(COSINES @ grid(samples) @ COSINES.T, 6).ravel()
    return np.packbits(np.r_[False, low[1:] > np.median(low[1:])]).tobytes()


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with their texts as PNG images in a binary column. Null is the empty text: one row of bytes 32.

    A column of that name already there is an error, as its values would be lost. Rows stay as they are,
    repeated ones and null ids too; very long texts become high images.
    """
    if media in docs.columns:
        raise ValueError(f"there is a column {media} already")

    @F.arrow_udf("binary")
    def png(column: pa.Array) -> pa.Array:
        return pa.array([encode_png(pad(x.encode("utf-8", "surrogatepass"))) for x in texts(column)], pa.binary())

    return docs.withColumn(media, png(F.col(text)))


def read_back(media: Column) -> Column:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the stored bytes.

    Null media: null fields. Damaged media raise.
    """

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def features(column: pa.Array) -> pa.Array:
        rows = []
        for data in column.to_pylist():
            if data is None:
                rows.append(None)
                continue
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples).hex()))
        return pa.array([None if r is None else dict(zip(FIELDS, r, strict=True)) for r in rows], pa.struct([pa.field(k, pa.string() if k in STRINGS else pa.int64()) for k in FIELDS]))

    return features(media)


FIELDS = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
STRINGS = ("payload_sha256", "media_sha256", "feature")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text's UTF-8, and what is read back of its image.

    Equal texts give equal values; null is the empty text, long texts are whole. Repeated rows and null
    ids have a row each. Columns other than doc_id and text are left out. Empty table: empty result.
    """
    rows = with_media(docs.select("doc_id", "text"), media="_media")
    return rows.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), read_back(F.col("_media")).alias("_r")).select("doc_id", "n_bytes", "_r.*")
