"""Fingerprints: content hashes, SimHash, signatures, acoustic and perceptual hashes, code structure."""

from __future__ import annotations

import ast
import difflib
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import joined_windows, let, words


def sha256_prefixed(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash (signed 64 bits). Bit i is set if more word occurrences have it set than not, in the low 64 bits of the word's md5. No words: 0.

    Each row is folded by itself, so nothing moves; a batch's distinct words are hashed once.
    """
    found = df.select(F.col(key), words(F.col(text)).alias("w"))

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1000):
                batch = whole.slice(at, 1000)
                col = batch.column(1)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                coded = col.flatten().dictionary_encode()
                low = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "big") for w in coded.dictionary.to_pylist()], np.uint64)
                bits, of, ends = low.view(np.uint8).reshape(-1, 8), coded.indices.to_numpy(), np.cumsum(sizes)
                out = np.zeros(len(batch), np.int64)
                for i, (a, b) in enumerate(zip(ends - sizes, ends)):
                    if a < b:
                        votes = np.unpackbits(bits[of[a:b]], axis=1, bitorder="little").sum(0, dtype=np.int64)
                        out[i] = np.packbits(2 * votes > b - a, bitorder="little").view(np.int64)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[key, "simhash"])

    return found.mapInArrow(run, df.select(key).withColumn("simhash", F.lit(0).cast("long")).schema)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(64.0)


def privacy_signature(text: Column, salt: str = "cross-org-v1", most: int = 64) -> Column:
    """Sorted distinct salted hashes of the first word 3-shingles; fewer than three words are one shingle."""
    first = lambda w: F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(joined_windows(F.slice(w, 1, most + 2), 3))
    shingles = let(words(text), first)
    return F.array_sort(F.array_distinct(F.transform(shingles, lambda s: F.substring(F.sha2(F.concat(s, F.lit(salt)).cast("binary"), 256), 1, 16))))


def acoustic_fingerprint(content: Column, frame: int = 2048, frames: int = 32, peaks: int = 16) -> Column:
    """md5 of byte frames modulo 100, the first 16 joined; empty content: the start of its sha256."""
    count = F.least(F.lit(frames), F.ceil(F.length(content) / frame).cast("int"), F.lit(peaks))

    def peak(i: Column) -> Column:
        d = F.md5(content.substr(i * frame + 1, F.lit(frame)))
        out = F.lit(0).cast("long")
        for a in (1, 9, 17, 25):  # 2**32 = 96 modulo 100
            out = (out * 96 + F.conv(F.substring(d, a, 8), 16, 10).cast("long")) % 100
        return out.cast("string")

    return F.when(F.length(content) > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), peak), "-")).otherwise(F.substring(F.sha2(content, 256), 1, 32))


@F.pandas_udf(T.DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio; a is the query, b the reference (the order matters)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def difflib_ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The same ratio where it is at least `least`, else 0: what the counts of characters rule out isn't worked out."""

    def one(m: difflib.SequenceMatcher, x: str, least: float) -> float:
        m.set_seq1(x)
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            return 0.0
        r = m.ratio()
        return r if r >= least else 0.0

    known: dict[str, difflib.SequenceMatcher] = {}
    out = []
    for x, y, z in zip(a, b, least):
        if y not in known:
            if len(known) > 500:
                known.clear()
            known[y] = difflib.SequenceMatcher(None, "", y)
        out.append(one(known[y], x, z))
    return pd.Series(out, dtype=float)


def difflib_bound(la: Column, lb: Column) -> Column:
    """No ratio of texts of these lengths is above it."""
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


#: Shorter names of syntax nodes.
_SHORT = {"FunctionDef": "FuncDef", "AsyncFunctionDef": "FuncDef", "Name": "Var", "Constant": "Const"}


def code_structure(source: str) -> str:
    """Names of the syntax nodes, breadth first; what doesn't parse: its identifiers blanked, white space collapsed."""
    try:
        kinds = (type(n).__name__ for n in ast.walk(ast.parse(source)))
        return "-".join(_SHORT.get(k, k) for k in kinds)
    except (SyntaxError, ValueError):
        return " ".join(re.sub(r"\b[a-zA-Z_]\w*\b", "id", source).split())


@F.pandas_udf(T.StringType())
def code_structure_udf(source: pd.Series) -> pd.Series:
    return source.map(code_structure)


def _dct_rows(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n))


def phash(gray: np.ndarray) -> int:
    """64-bit perceptual hash of a 32x32 grey image: the 8x8 lowest frequencies above their median, row by row, as an unsigned number."""
    d = _dct_rows(32)
    low = (d @ gray.astype(np.float64) @ d.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return int("".join("1" if b else "0" for b in bits), 2)


def shrink(image: np.ndarray, size: int = 32) -> np.ndarray:
    """Grey image of size x size by means over equal areas."""
    if image.ndim == 3:
        image = image[..., :3] @ np.array([0.299, 0.587, 0.114])
    cut = lambda n: np.linspace(0, n, size + 1).astype(int)
    rows, cols = cut(image.shape[0]), cut(image.shape[1])
    return np.array([[image[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:])] for a, b in zip(rows, rows[1:])])
