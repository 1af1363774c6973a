"""Images in numpy, over Arrow batches: orientation, Lanczos resampling, grey values, perceptual hashes, template search, PNG.

Resampling is separable with 8-bit steps between: coefficients in fixed point, horizontal first. Rows of images are Spark's image fields (height, width, nChannels, data; BGR), with `content`, the file's bytes, where orientation is to be read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import fingerprint as fp

#: Longest side of a normalised image.
MOST_PIXELS = 1024
_BITS = 22


# ---- orientation
def _tiff_orientation(raw: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        return 1
    at = struct.unpack_from(f"{order}I", raw, 4)[0]
    if at + 2 > len(raw):
        return 1
    for i in range(struct.unpack_from(f"{order}H", raw, at)[0]):
        entry = at + 2 + 12 * i
        if entry + 12 > len(raw):
            return 1
        tag, kind = struct.unpack_from(f"{order}HH", raw, entry)
        if tag == 0x0112:
            value = struct.unpack_from(f"{order}H" if kind == 3 else f"{order}I", raw, entry + 8)[0]
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(content: bytes | None) -> int:
    """The EXIF orientation (1 to 8) of a JPEG, PNG or TIFF file; 1 where there is none or it can't be read."""
    raw = bytes(content or b"")
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] not in (0xDA, 0xD9):
            size = int.from_bytes(raw[at + 2 : at + 4], "big")
            if raw[at + 1] == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
                return _tiff_orientation(raw[at + 10 : at + 2 + size])
            at += 2 + size
        return 1
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(raw):
            size = int.from_bytes(raw[at : at + 4], "big")
            if raw[at + 4 : at + 8] == b"eXIf":
                return _tiff_orientation(raw[at + 8 : at + 8 + size])
            at += 12 + size
        return 1
    return _tiff_orientation(raw)


def oriented(pixels: np.ndarray, how: int) -> np.ndarray:
    """pixels as they are meant to be seen."""
    turns = {1: lambda x: x, 2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: x[::-1].swapaxes(0, 1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: x[:, ::-1].swapaxes(0, 1)}
    return turns[how](pixels)


# ---- resampling
def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def coefficients(old: int, new: int) -> np.ndarray:
    """new x old whole numbers: what each new pixel takes of each old one, times 2**22. The window grows when the image shrinks."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    first = np.maximum(0, (centre - 3 * wide + 0.5).astype(int))
    last = np.minimum(old, (centre + 3 * wide + 0.5).astype(int))
    at = np.arange(old)
    w = _lanczos((at + 0.5 - centre[:, None]) / wide) * ((at >= first[:, None]) & (at < last[:, None]))
    w /= w.sum(1, keepdims=True)
    return np.where(w < 0, np.ceil(w * (1 << _BITS) - 0.5), np.floor(w * (1 << _BITS) + 0.5)).astype(np.int64)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """8-bit pixels (height x width, or with channels), by Lanczos windows of 3."""
    def along(x: np.ndarray, n: int) -> np.ndarray:
        """The first axis."""
        if x.shape[0] == n:
            return x
        w = coefficients(x.shape[0], n).astype(float)  # products and sums stay far below 2**53, so floats are exact
        y = np.tensordot(w, x.astype(float), 1)
        return np.clip(np.floor((y + (1 << _BITS - 1)) / (1 << _BITS)), 0, 255).astype(np.uint8)

    return along(along(pixels.swapaxes(0, 1), width).swapaxes(0, 1), height)


def thumbnail_size(width: int, height: int, most: int = MOST_PIXELS) -> tuple[int, int]:
    """The size of an image whose longer side is at most `most`, with sides in proportion as near as whole pixels allow."""
    if max(width, height) <= most:
        return width, height
    aspect = width / height

    def near(x: float, key) -> int:
        return max(min(int(np.floor(x)), int(np.ceil(x)), key=key), 1)

    if aspect <= 1:
        return near(most * aspect, lambda n: abs(aspect - n / most)), most
    return most, near(most / aspect, lambda n: 0 if n == 0 else abs(aspect - most / n))


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Three channels: grey ones are repeated, a fourth goes."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return np.repeat(pixels.reshape(*pixels.shape[:2], 1), 3, 2)
    return pixels[..., :3]


def normalised(pixels: np.ndarray, how: int = 1, most: int = MOST_PIXELS) -> np.ndarray:
    """RGB pixels, turned upright, the longer side at most `most`."""
    x = rgb(oriented(pixels, how))
    return resized(x, *thumbnail_size(x.shape[1], x.shape[0], most))


def grey(pixels: np.ndarray) -> np.ndarray:
    x = rgb(pixels).astype(np.int64)
    return ((x[..., 0] * 19595 + x[..., 1] * 38470 + x[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)


def phash(pixels: np.ndarray) -> int:
    """64-bit perceptual hash of RGB or grey pixels, as an unsigned number."""
    return fp.phash(resized(grey(pixels), 32, 32))


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB or grey pixels of Spark's image fields (BGR, BGRA or grey)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return x[..., 2::-1] if channels >= 3 else x[..., 0]


# ---- template search
def find_template(image: np.ndarray, template: np.ndarray) -> tuple[int, int, int, int, float]:
    """(x, y, width, height, score) of the place in the image (RGB or grey) that correlates best with the template: the first one, row by row. If the template is larger than the image in any direction, they swap roles.

    Normalised cross-correlation: the numerator by FFT, the denominator by integral images; the best places by FFT are worked out again in whole numbers.
    """
    light = lambda p: ((rgb(p).astype(np.int64) * (4899, 9617, 1868)).sum(2) + 8192) >> 14
    a, t = light(image), light(template)
    if t.shape[0] > a.shape[0] or t.shape[1] > a.shape[1]:
        a, t = t, a
    h, w = t.shape
    if a.shape[0] < h or a.shape[1] < w:
        return 0, 0, w, h, 0.0  # each is larger in one direction
    n = h * w
    spread = n * int((t * t).sum()) - int(t.sum()) ** 2  # n squared times the template's variance
    if spread == 0:
        return 0, 0, w, h, 1.0

    def windows(x: np.ndarray) -> np.ndarray:
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1), np.int64)
        np.cumsum(np.cumsum(x, 0), 1, out=s[1:, 1:])
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    sums = windows(a)
    spreads = n * windows(a * a) - sums * sums
    shape = (a.shape[0] + h - 1, a.shape[1] + w - 1)
    cross = np.fft.irfft2(np.fft.rfft2(a - a.mean(), shape) * np.fft.rfft2((t - t.mean())[::-1, ::-1], shape), shape)[h - 1 : a.shape[0], w - 1 : a.shape[1]]
    score = np.where(spreads > 0, n * cross / np.sqrt(np.maximum(spreads, 1).astype(float) * spread), 0.0)
    best, found = None, None
    for y, x in zip(*np.nonzero(score >= score.max() - 1e-6)):  # row by row
        exact = n * int((a[y : y + h, x : x + w] * t).sum()) - int(sums[y, x]) * int(t.sum())
        value = exact / (int(spreads[y, x]) * spread) ** 0.5 if spreads[y, x] else 0.0
        if best is None or value > best + 1e-12:
            best, found = value, (int(x), int(y))
    return *found, w, h, float(best)


# ---- PNG
def png(pixels: np.ndarray, notes: dict[str, str] | None = None) -> bytes:
    """An 8-bit RGB or grey PNG: the same bytes for the same pixels and notes (tEXt chunks, in order of their names)."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = pixels.reshape(pixels.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    text = b"".join(chunk(b"tEXt", k.encode("latin-1", "replace") + b"\0" + v.encode("latin-1", "replace")) for k, v in sorted((notes or {}).items()))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + text + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


#: Height of both images, of the margin above, their distance, and colours.
TALL, MARGIN, GAP = 400, 60, 10
BACK, RED, BLUE = (11, 18, 32), (239, 68, 68), (56, 189, 248)


def composite(query: np.ndarray, source: np.ndarray, notes: dict[str, str]) -> tuple[bytes, tuple[int, int, int, int]]:
    """(PNG, box in the source's pixels): both images at one height side by side, the place of the query in the source framed. Verdict, score and names go along as notes of the file, not as drawn letters."""
    box = find_template(source, query)[:4]
    fit = lambda p: resized(rgb(p), max(int(p.shape[1] * TALL / p.shape[0]), 1), TALL)
    left, right, scale = fit(query), fit(source).copy(), TALL / source.shape[0]
    x, y, w, h = (int(v * scale) for v in box)
    for k in range(3):
        y0, y1, x0, x1 = max(y + k, 0), min(y + h - k, TALL - 1), max(x + k, 0), min(x + w - k, right.shape[1] - 1)
        if y0 <= y1 and x0 <= x1:
            right[[y0, y1], x0 : x1 + 1] = RED
            right[y0 : y1 + 1, [x0, x1]] = RED
    canvas = np.empty((TALL + MARGIN + 3 * GAP, left.shape[1] + right.shape[1] + 3 * GAP, 3), np.uint8)
    canvas[:] = BACK
    canvas[MARGIN - 8 : MARGIN - 4, GAP : GAP + left.shape[1]] = BLUE
    canvas[MARGIN - 8 : MARGIN - 4, 2 * GAP + left.shape[1] : -GAP] = RED
    canvas[MARGIN + GAP : MARGIN + GAP + TALL, GAP : GAP + left.shape[1]] = left
    canvas[MARGIN + GAP : MARGIN + GAP + TALL, 2 * GAP + left.shape[1] : 2 * GAP + left.shape[1] + right.shape[1]] = right
    return png(canvas, notes), box


# ---- tables
def image_phash(images: DataFrame, key: str) -> DataFrame:
    """key, phash (signed 64 bits) of rows with Spark's image fields; with `content`, of the image turned upright."""
    turned = "content" in images.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            how = [orientation(c) for c in pdf["content"]] if turned else [1] * len(pdf)
            values = [phash(normalised(pixels_of(h, w, c, d), o)) for h, w, c, d, o in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], how)]
            yield pd.DataFrame({key: pdf[key], "phash": [v - (1 << 64) if v >> 63 else v for v in values]})

    return images.select(key, "height", "width", "nChannels", "data", *(["content"] if turned else [])).mapInPandas(run, f"{key} string, phash long")


def evidence(pairs: DataFrame) -> DataFrame:
    """asset_id, item_id, png, x, y, w, h of matched pairs: asset_id, item_id, score, asset_hash, and a (the asset) and b (the work) as structs of Spark's image fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a, b = (pixels_of(x["height"], x["width"], x["nChannels"], x["data"]) for x in (r.a, r.b))
                data, box = composite(rgb(a), rgb(b), {"Verdict": "BLOCKED", "Similarity": f"{r.score:.4f}", "Asset": r.asset_hash, "Matched": str(r.item_id)})
                rows.append((r.asset_id, r.item_id, data, *box))
            yield pd.DataFrame(rows, columns=["asset_id", "item_id", "png", "x", "y", "w", "h"])

    return pairs.select("asset_id", "item_id", "score", "asset_hash", "a", "b").mapInPandas(run, "asset_id string, item_id string, png binary, x int, y int, w int, h int")
