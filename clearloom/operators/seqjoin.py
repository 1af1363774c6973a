"""Exact join by the matching-blocks ratio of difflib: pairs of texts whose ratio 2 M / T (M matched characters, T characters of both) is at least r.

No pair is made on lengths alone. With B blocks at most, M matched characters leave one block of M / B characters or more, so both texts share a window of that many characters:
- in a text of 200 characters or more difflib matches from characters that it doesn't call popular (more than 1 % of the text), so a block holds one of these, or begins both texts: B is their number plus 1;
- between two blocks at least one character is unmatched, so B <= T - 2 M + 1 too.
Windows of 4, 8 or 16 characters, whichever the bound allows, are an inverted index; keys hold the query's band of lengths, since M grows with it. Where blocks may be shorter than 4 characters (short texts, low ratios) the characters themselves are the index: 2 M / T >= r bounds the overlap of the multisets from below, so the rarest of (character, number of its occurrence) of both texts must meet (prefix filter). Survivors whose bounds (covered characters, common subsequences) don't rule them out are compared by difflib itself.

Equal texts are compared once. The keys of the indexed side, where they are few, filter the queries' windows before these leave their task.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of windows, longest first, and the ratio of lengths between bands.
WINDOWS, STEP = (16, 8, 4), 1.25
#: Keys of the indexed side up to which they go to all tasks, as 8 bytes each.
MOST_KEYS = 2_000_000
#: Cells of a matrix of two texts' characters up to which blocks are looked for in it.
MOST_CELLS = 1 << 18
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def band(n: int) -> int:
    return int(math.log(n) / math.log(STEP) + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _salt(b: int, size: int) -> np.uint64:
    return np.uint64((b * 64 + size + 1) * 0xD6E8FEB86659FD93 % 2**64)


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of `size` characters; equal hashes of different windows cost a comparison, no more."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * _PRIME + codes[i : i + n]
    return _mix(out)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def tokens(text: str, common: dict[str, int]) -> list[tuple[str, int]]:
    """(character, number of its occurrence), the rarest first in an order that all texts share."""
    counts = Counter(text)
    return sorted(((c, k) for c, n in counts.items() for k in range(1, n + 1)), key=lambda x: (-x[1] / common.get(x[0], 0.5), x))


def _token_keys(items: list[tuple[str, int]]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.array([ord(c) * (1 << 32) + k for c, k in items], np.uint64) * _PRIME)


def index_keys(text: str, least: float, common: dict[str, int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, size, keys) under which queries of a band find an indexed text; size 0: by characters."""
    n = len(text)
    lo, hi = max(1, math.floor(n * least / (2 - least))), math.ceil(n * (2 - least) / least)
    codes = characters(text)
    if n >= 200:
        counts = Counter(text)
        rare = np.array([c for c, k in counts.items() if k <= n // 100 + 1])
        anchors = np.flatnonzero(np.isin(codes, [ord(c) for c in rare])) if len(rare) else np.zeros(0, np.int64)
    else:
        anchors = np.arange(n)
    held: dict[int, np.ndarray] = {}
    every = None
    for b in range(max(0, band(lo) - 1), band(hi) + 2):
        low, high = max(lo, math.floor(STEP**b) - 1, 1), min(hi, math.ceil(STEP ** (b + 1)) + 1)
        if low > high:
            continue
        matched = max(1, math.ceil(least * (low + n) / 2 - 1e-6))
        blocks = min(len(anchors) + 1, math.floor((1 - least) * (high + n) + 1e-6) + 1)
        block = math.ceil(matched / blocks)
        size = next((s for s in WINDOWS if s <= min(block, n)), 0)
        if size:
            if size not in held:
                near = np.zeros(n - size + 1, bool)
                near[0] = True
                for d in range(size):
                    at = anchors - d
                    near[at[(at >= 0) & (at < len(near))]] = True
                held[size] = np.unique(windows(codes, size)[near])
            keys = held[size]
        else:
            every = every if every is not None else tokens(text, common)
            keys = _token_keys(every[: max(1, n - matched + 1)])
        yield b, size, keys ^ _salt(b, size)


def query_keys(text: str, least: float, common: dict[str, int], sizes: dict[int, list[int]]) -> Iterator[np.ndarray]:
    """Keys of a query; sizes: those that its band is indexed under."""
    n = len(text)
    b = band(n)
    codes = characters(text)
    for size in sizes.get(b, ()):
        if size:
            keys = np.unique(windows(codes, size))
        else:
            keys = _token_keys(tokens(text, common)[: max(1, n - math.ceil(n * least / (2 - least) - 1e-6) + 1)])
        yield keys ^ _salt(b, size)


def _covered(b2j: dict[str, list[int]], a: str, b: str) -> int:
    """The most characters of b that difflib can match where it calls some popular: a block begins both texts or holds a character that isn't, so what such runs cover bounds the blocks. b2j: the places in b of characters that aren't popular."""
    n, m = len(b), len(a)
    seen, ends = bytearray(n), {}
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    seen[:k] = b"\1" * k
    for j in sorted(j for places in b2j.values() for j in places):
        i = a.find(b[j])
        while i >= 0:
            if ends.get(i - j, 0) <= j:  # not in a run that was seen
                lo, hi = j, j + 1
                while lo and lo + i - j and a[lo - 1 + i - j] == b[lo - 1]:
                    lo -= 1
                while hi < n and hi + i - j < m and a[hi + i - j] == b[hi]:
                    hi += 1
                ends[i - j] = hi
                seen[lo:hi] = b"\1" * (hi - lo)
            i = a.find(b[j], i + 1)
    return sum(seen)


def _subsequence(a: str, masks: dict[str, int], lo: int, hi: int) -> int:
    """Length of the longest common subsequence of a and b[lo:hi], with a bit for each place of b; masks: the places of each character."""
    full = (1 << (hi - lo)) - 1
    v = full
    part = {c: masks.get(c, 0) >> lo & full for c in set(a)}
    for c in a:
        u = v & part[c]
        if u:
            v = ((v + u) | (v - u)) & full
    return hi - lo - v.bit_count()


def _longest(same: np.ndarray) -> tuple[int, int, int]:
    """(i, j, k): the longest diagonal run of a matrix of equal characters, k long, the first of equally long ones as difflib takes it."""
    k, runs, last = 0, same, None
    while runs.size and runs.any():
        k, last = k + 1, runs
        runs = runs[:-1, :-1] & same[k:, k:]
    return (*divmod(int(last.argmax()), last.shape[1]), k) if k else (0, 0, 0)


def _reaches(a: str, b: str, need: int) -> bool:
    """Whether difflib matches `need` characters, where it calls none popular. Blocks are taken as difflib takes them, as long as these and the longest common subsequences of what is left beside them reach that many."""
    masks: dict[str, int] = {}
    for j, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << j
    left = _subsequence(a, masks, 0, len(b))
    if left < need:
        return False
    same = characters(a)[:, None] == characters(b)
    matched, parts = 0, [(left, 0, len(a), 0, len(b))]
    while parts:
        most, i0, i1, j0, j1 = parts.pop()
        i, j, k = _longest(same[i0:i1, j0:j1])
        matched, left = matched + k, left - most + k
        for x0, x1, y0, y1 in ((i0, i0 + i, j0, j0 + j), (i0 + i + k, i1, j0 + j + k, j1)):
            if k and x0 < x1 and y0 < y1:
                most = _subsequence(a[x0:x1], masks, y0, y1)
                if most:
                    left += most
                    parts.append((most, x0, x1, y0, y1))
        if left < need:
            return False
    return matched >= need


def ratio_from(matcher: difflib.SequenceMatcher, a: str, b: str, least: float) -> float:
    """difflib's ratio where it is at least `least`, else 0. matcher has b as its second text. Bounds come first: most pairs that share a key are far below."""
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * total - 1e-9:
        return 0.0
    matcher.set_seq1(a)
    if matcher.quick_ratio() < least - 1e-9:
        return 0.0
    need = math.ceil(least * total / 2 - 1e-6)
    if matcher.bpopular:
        if _covered(matcher.b2j, a, b) < need:
            return 0.0
    elif len(a) * len(b) <= MOST_CELLS and not _reaches(a, b, need):
        return 0.0
    r = matcher.ratio()
    return r if r >= least else 0.0


def _texts(df: DataFrame, col: str, key: str) -> DataFrame:
    rows = df.select(F.col(col).alias("text")).filter(F.length(col) > 0)
    return rows.withColumn(key, F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates([key])


def ratio_pairs(left: DataFrame, right: DataFrame, least: float, l: str = "l_text", r: str = "r_text", lower: bool = True) -> DataFrame:
    """l_id, r_id (SHA-256 of the texts, see text_id), ratio of texts of `left` (difflib's first argument) and `right`, both lower-cased (unless lower is False), with a ratio of at least `least`, which is above 0. Null and empty texts meet nothing."""
    spark = left.sparkSession
    queries, refs = _texts(left, l, "l_id"), _texts(right, r, "r_id")
    cased = str.lower if lower else str
    chars = refs.select(F.explode(F.split(F.lower("text") if lower else "text", "")).alias("c")).filter(F.length("c") > 0).groupBy("c").agg(F.count("*").alias("n"))
    common = {x.c: x.n for x in chars.orderBy(F.desc("n"), "c").limit(5000).collect()}  # an order, no filter: any would do

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b, size, keys in index_keys(cased(text), least, common):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([rid] * len(keys)), pa.array(np.full(len(keys), b, np.int32)), pa.array(np.full(len(keys), size, np.int32))], names=["key", "r_id", "band", "size"])

    index = refs.mapInArrow(indexed, "key long, r_id string, band int, size int").persist()
    sizes: dict[int, list[int]] = {}
    for x in index.select("band", "size").distinct().collect():  # a few for each factor of 1.25 in length
        sizes.setdefault(x.band, []).append(x["size"])
    distinct = index.select("key").distinct()
    known = None
    if distinct.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        known = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["key"].to_numpy(np.int64)))  # at most 16 MB

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = known.value if known else None
        for batch in batches:
            for text, lid in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keys in query_keys(cased(text), least, common, sizes):
                    keys = keys.view(np.int64)
                    if have is not None:
                        at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
                        keys = keys[have[at] == keys] if len(have) else keys[:0]
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([lid] * len(keys))], names=["key", "l_id"])

    met = queries.mapInArrow(asked, "key long, l_id string").join(index.select("key", "r_id"), "key").select("l_id", "r_id").distinct()
    pairs = met.join(queries.withColumnRenamed("text", "a"), "l_id").join(refs.withColumnRenamed("text", "b"), "r_id").select("l_id", "r_id", "a", "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, tuple[difflib.SequenceMatcher, str]] = {}
        for batch in batches:
            lid, rid, ratios = [], [], []
            for x, y, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if y not in matchers:
                    if len(matchers) > 500:
                        matchers.clear()
                    b = cased(b)
                    matchers[y] = difflib.SequenceMatcher(None, "", b), b
                ratio = ratio_from(matchers[y][0], cased(a), matchers[y][1], least)
                if ratio:
                    lid.append(x)
                    rid.append(y)
                    ratios.append(ratio)
            yield pa.RecordBatch.from_arrays([pa.array(lid, pa.string()), pa.array(rid, pa.string()), pa.array(ratios, pa.float64())], names=["l_id", "r_id", "ratio"])

    return pairs.mapInArrow(compared, "l_id string, r_id string, ratio double")


def text_id(col: str):
    """The id that ratio_pairs gives a text."""
    return F.sha2(F.col(col).cast("binary"), 256)
