"""Best-fit packing of documents into sequences, with several capacities at once: tokens, documents, and attention cost (the sum of squared piece lengths).

Pieces are dealt at random into groups of about GROUP_PIECES, and each group is packed by itself: largest first, each into the open sequence that fits it under every constraint and scores best, by weighted residual norm (what stays free after the piece, as shares of the capacities; least wins) or by weighted dot product of the piece and the free room (greatest wins). A group leaves about one sequence partly filled, so the loss is a fixed small share at any size.

Nulls: a null text is an empty one, and holds the end id only. Null or repeated doc_ids are packed as separate documents; ties go to the older sequence. A very long text is one step of the encoder. An empty table gives an empty result. Other columns of the input are not read. Documents longer than a sequence are cut into full pieces; the first piece takes the remainder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table
from .tokens import encoder, forget, with_ends

GROUP_PIECES = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: Weights of the three in the score.
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    #: "norm" or "dot".
    score: str = "norm"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((i, most) for i in range(first, n, most))]


def pack(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece. A piece alone over the document or attention capacity gets a sequence of its own."""
    n = len(lengths)
    lengths = np.asarray(lengths, np.int64)
    seq, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    w = np.array(cap.weights) / (full if cap.score == "dot" else full**2)
    free, used, ids = np.zeros((3, max(n, 1))), np.zeros(max(n, 1), np.int64), np.zeros(max(n, 1), np.int64)
    n_open, made = 0, 0
    least = np.minimum.accumulate(np.sort(lengths)[::-1]) if n else lengths
    for at, i in enumerate(np.argsort(-lengths, kind="stable")):
        size = int(lengths[i])
        item = np.array([size, 1, size * size], np.float64)
        if at % 256 == 0 and n_open:  # what no later piece fits into is closed
            keep = np.flatnonzero((free[0, :n_open] >= least[-1]) & (free[1, :n_open] >= 1))
            for a in (*free, used, ids):
                a[: len(keep)] = a[keep]
            n_open = len(keep)
        room = free[:, :n_open]
        fits = np.flatnonzero((room[0] >= item[0]) & (room[1] >= 1) & (room[2] >= item[2]))
        if len(fits):
            r = room[:, fits]
            best = fits[np.argmax((w * item) @ r) if cap.score == "dot" else np.argmin(w @ (r - item[:, None]) ** 2)]
        else:
            best = n_open
            free[:, best], used[best], ids[best] = full, 0, made
            made += 1
            n_open += 1
        seq[i], offset[i] = ids[best], used[best]
        free[:, best] -= item
        used[best] += size
    return seq, offset


def pieces(docs: DataFrame, path: str, most: int, keep: bool = True) -> DataFrame:
    """The pieces of each document, with the crc32 of their ids. keep: workers hold the encoder's tables for their next task (less time, more memory)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if not keep:
            forget()
        for batch in batches:
            for ids, counts, first in enc.encode_column(batch.column(1)):
                ids, sizes, begin = with_ends(ids, counts)
                raw, rows = memoryview(ids.astype("<u4").tobytes()), ([], [], [], [], [])
                for at, n, key in zip(begin.tolist(), sizes.tolist(), batch.column(0).slice(first, len(counts)).to_pylist()):
                    for k, (start, length) in enumerate(cut(n, most)):
                        for col, x in zip(rows, (key, k, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + start + length)]))):
                            col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(encode), PIECES)


def packed(docs: DataFrame, path: str, cap: Capacity = Capacity(), group: int = GROUP_PIECES, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = stage(pieces(docs, path, cap.tokens, keep), "packing")
    groups = max(1, round(cuts.count() / group))
    cuts = cuts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    parts = max(1, min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        seq, offset = pack(pdf["length"].to_numpy(), cap)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]]
        return out.assign(sequence_id=(np.int64(key[0]) << 32) + seq, offset=offset)

    return cuts.repartition(parts, "grp").groupBy("grp").applyInPandas(fill, PACKED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
