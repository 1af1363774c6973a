"""Image functions against plain definitions; golden hashes; equal bytes on two runs."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearloom.functions import image


def picture(h, w, seed=1):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = 127 + 60 * np.sin(x / 7 + seed) + 50 * np.cos(y / 11)
    return np.clip(base[..., None] + r.integers(-20, 20, (h, w, 3)), 0, 255).astype(np.uint8)


def exif(how, order="<"):
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 2) + struct.pack(f"{order}HHII", 0x010F, 4, 1, 7) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, how, 0) + bytes(4)


def test_orientation():
    for how in range(1, 9):
        for order in "<>":
            t = exif(how, order)
            jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(t) + 8) + b"Exif\0\0" + t + b"\xff\xda"
            png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 0) + b"abcd" + bytes(4) + struct.pack(">I", len(t)) + b"eXIf" + t + bytes(4)
            assert image.orientation(jpeg) == image.orientation(png) == image.orientation(t) == how
    assert [image.orientation(x) for x in (None, b"", b"\xff\xd8", b"II*\0", exif(99), b"\xff\xd8\xff\xe1\xff\xffExif\0\0II")] == [1] * 6


def test_oriented():
    """Corners of a 2 x 3 picture after each turn, as the standard names them."""
    p = np.array([[1, 2, 3], [4, 5, 6]])
    want = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    assert {k: image.oriented(p, k).tolist() for k in want} == want


def resampled_by_hand(column, new):
    """One column of pixels, by the definition, in whole numbers."""
    import math

    old, out = len(column), []
    scale = old / new
    wide = max(scale, 1)
    kernel = lambda x: 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)
    for i in range(new):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - 3 * wide + 0.5)), min(old, int(centre + 3 * wide + 0.5))
        w = [kernel((k + 0.5 - centre) / wide) for k in range(lo, hi)]
        w = [x / sum(w) for x in w]
        total = 1 << 21
        for k, x in zip(range(lo, hi), w):
            total += int(column[k]) * int(x * (1 << 22) + (0.5 if x >= 0 else -0.5))
        out.append(min(max(total >> 22, 0), 255))
    return out


@pytest.mark.parametrize("old,new", [(50, 32), (32, 32), (7, 32), (301, 32), (5, 1)])
def test_resampling(old, new):
    p = picture(old, 4, old)[..., 0]
    got = image.resized(p, 4, new)
    assert [got[:, k].tolist() for k in range(4)] == [resampled_by_hand(p[:, k], new) if old != new else p[:, k].tolist() for k in range(4)]
    assert (image.resized(p.T, new, 4) == got.T).all()


def test_thumbnail():
    assert [image.thumbnail_size(*x) for x in ((1024, 3), (2048, 1024), (1000, 3000), (5000, 1), (1025, 1025), (3, 4000))] == [(1024, 3), (1024, 512), (341, 1024), (1024, 1), (1024, 1024), (1, 1024)]
    got = image.normalised(picture(60, 2100), 6, 1024)
    assert got.shape == (1024, 29, 3)
    assert image.normalised(np.full((4, 5), 9, np.uint8)).tolist() == np.full((4, 5, 3), 9).tolist()


def test_golden_hashes():
    """Hashes of stored recipes: these never change."""
    got = [f"{image.phash(picture(h, w, s)):016x}" for h, w, s in ((64, 64, 1), (200, 333, 2), (31, 17, 3))]
    assert got == GOLDEN
    turned = image.oriented(picture(64, 64, 1), 6)
    assert image.phash(image.oriented(turned, 8)) == image.phash(picture(64, 64, 1)) != image.phash(turned)


GOLDEN = ["b5aa9356b02fa03e", "d59337da31d88133", "fe8a3284f116b31d"]


def correlation_by_hand(a, t):
    light = lambda p: ((p[..., 0].astype(int) * 4899 + p[..., 1].astype(int) * 9617 + p[..., 2].astype(int) * 1868 + 8192) >> 14).astype(float)
    a, t = light(a), light(t)
    h, w = t.shape
    best = (-2.0, None)
    for y in range(a.shape[0] - h + 1):
        for x in range(a.shape[1] - w + 1):
            p = a[y : y + h, x : x + w]
            d = np.sqrt(((p - p.mean()) ** 2).sum() * ((t - t.mean()) ** 2).sum())
            v = ((p - p.mean()) * (t - t.mean())).sum() / d if d > 1e-9 else 0.0
            if v > best[0] + 1e-9:
                best = (v, (x, y))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_template(seed):
    a = picture(40, 50, seed)
    for y, x, h, w in ((0, 0, 9, 9), (25, 31, 15, 19), (7, 3, 5, 30)):
        t = np.clip(a[y : y + h, x : x + w].astype(int) + np.random.default_rng(seed).integers(-4, 5, (h, w, 3)), 0, 255).astype(np.uint8)
        value, at = correlation_by_hand(a, t)
        got = image.find_template(a, t)
        assert got[:4] == (*at, w, h) == (x, y, w, h) and got[4] == pytest.approx(value)
        assert image.find_template(t, a)[:4] == got[:4]
    assert image.find_template(a, np.full((5, 5, 3), 9, np.uint8)) == (0, 0, 5, 5, 1.0)
    assert image.find_template(np.zeros((9, 9, 3), np.uint8), a[:5, :5])[:4] == (0, 0, 5, 5)


def test_png_can_be_read(spark, tmp_path):
    p = picture(21, 34)
    data = image.png(p, {"b": "2", "a": "1"})
    assert data == image.png(p.copy(), {"a": "1", "b": "2"}) and data.index(b"a\x001") < data.index(b"b\x002")
    (tmp_path / "x.png").write_bytes(data)
    (tmp_path / "y.png").write_bytes(image.png(p[..., 0]))
    got = {r.origin[-5:]: image.pixels_of(r.height, r.width, r.nChannels, r.data) for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    assert (got["x.png"] == p).all() and (image.rgb(got["y.png"]) == image.rgb(p[..., 0])).all()
    assert zlib.crc32(data) == zlib.crc32(image.png(p, {"a": "1", "b": "2"}))


def test_evidence(spark, tmp_path):
    whole, part = picture(60, 80, 4), picture(60, 80, 4)[20:50, 30:70]
    for name, p in (("whole", whole), ("part", part)):
        (tmp_path / f"{name}.png").write_bytes(image.png(p))
    rows = spark.read.format("image").load(str(tmp_path)).select("image")
    a, b = (rows.filter(F.col("image.origin").endswith(f"{n}.png")).select(F.col("image").alias(x)) for n, x in (("part", "a"), ("whole", "b")))
    pairs = a.crossJoin(b).withColumns({"asset_id": F.lit("p"), "item_id": F.lit("w"), "score": F.lit(0.987654), "asset_hash": F.lit("sha256:ab")})
    one, two = (image.evidence(pairs).first() for _ in range(2))
    assert (one.x, one.y, one.w, one.h) == (30, 20, 40, 30) and hashlib.sha256(one.png).digest() == hashlib.sha256(two.png).digest()
    assert b"Similarity\x000.9877" in one.png and b"Matched\x00w" in one.png


def test_hashes_follow_orientation(spark, tmp_path):
    from clearloom.sources import assets

    p = picture(70, 90, 5)
    plain = image.png(p)
    turned = image.png(image.oriented(p, 8))  # shown upright by orientation 6
    t = exif(6)
    chunk = struct.pack(">I", len(t)) + b"eXIf" + t + struct.pack(">I", zlib.crc32(b"eXIf" + t))
    (tmp_path / "plain.png").write_bytes(plain)
    (tmp_path / "turned.png").write_bytes(turned[:33] + chunk + turned[33:])
    got = {r.title: r.phash for r in assets.image_index(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and len(set(got.values())) == 1
