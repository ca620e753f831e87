import hashlib
import math
import zlib

import numpy as np
import pytest

from snapforge.llm import media


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 5000, 300_000])
def test_round_trip(size):
    data = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    payload = media.pad(data)
    assert len(payload) % 192 == 0 and payload.startswith(data) and set(payload[size:]) <= {32}
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


@pytest.mark.parametrize("bpp", [1, 3, 4])
def test_all_filters(bpp):
    rng = np.random.default_rng(bpp)
    want = rng.integers(0, 256, (40, 5 * bpp), np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    rows = np.zeros_like(want)
    for r in range(40):
        for i in range(want.shape[1]):
            a = int(want[r, i - bpp]) if i >= bpp else 0
            b = int(want[r - 1, i]) if r else 0
            c = int(want[r - 1, i - bpp]) if r and i >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            rows[r, i] = (int(want[r, i]) - (0, a, b, (a + b) // 2, near)[kinds[r]]) % 256
    assert (media.unfilter(kinds, rows, bpp) == want).all()


def test_damage_is_found():
    png = bytearray(media.encode_png(media.pad(b"hello")))
    for at in (3, 20, len(png) // 2, len(png) - 2):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(bytes(png[:-6]))


def test_hash_is_stable_under_brightness():
    rng = np.random.default_rng(1)
    x = np.kron(rng.integers(40, 200, (8, 8, 1)), np.ones((16, 16, 3))).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(media.cosine_hash(a), np.uint8))
    assert (bits(x) != bits(x + 20)).sum() <= 2 and (bits(x) != bits(x.transpose(1, 0, 2))).sum() > 8


def test_query(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 100_000), (None, "héllo")]
    got = media.media_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, t), r in zip(rows, got, strict=True):
        p = media.pad((t or "").encode())
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len((t or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and len(r["feature"]) == 16
    assert tuple(got[0])[1:] == tuple(got[4])[1:] and tuple(got[1])[1:] == tuple(got[2])[1:]
    assert media.media_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shape", [(1, 64, 3), (9, 64, 3), (32, 32, 3), (100, 64, 3), (40, 7, 1)])
def test_hash_is_that_of_a_plain_cosine_transform(shape):
    samples = np.random.default_rng(shape[0]).integers(0, 256, shape).astype(np.uint8)
    h, w = shape[:2]

    def cell(n, i):
        return range(i * n // 32, (i + 1) * n // 32) if n >= 32 else [i * n // 32]

    grey = [[float(np.mean([int(c) for c in samples[y, x]])) for x in range(w)] for y in range(h)]
    g = [[float(np.mean([grey[y][x] for y in cell(h, i) for x in cell(w, j)])) for j in range(32)] for i in range(32)]
    low = [round(sum(g[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "0" + "".join(str(int(c > middle)) for c in low[1:])
    assert media.cosine_hash(samples) == int(bits, 2).to_bytes(8, "big")


def test_clashing_and_repeated_rows(spark):
    rows = [(1, "a", b"x", "f"), (1, "a", b"y", "g"), (2, "word " * 400_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary, feature string")
    got = media.media_digests(df).collect()
    assert len(got) == 3 and tuple(got[0]) == tuple(got[1]) and got[2]["n_bytes"] == 2_000_000
    with pytest.raises(ValueError):
        media.with_media(df)
