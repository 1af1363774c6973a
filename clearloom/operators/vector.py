"""Exact vector top-k by cosine, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .commits import Versions


def normalised(v):
    """Of unit length; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


#: Queries that meet a block in one task, and those whose scores are held at once.
TILE, CHUNK = 16384, 256


def top_k(index: DataFrame, queries: DataFrame, key: str, qkey: str, col: str, k: int = 5, block: int = 8192, tile: int = TILE) -> DataFrame:
    """qkey, key, score, rank. Queries (a stated set) meet all rows, a tile of them and a block of rows in a task: each keeps its own k best for a query, and only these are merged. Scores that are equal to 10 digits are ties, in a block as among the merged ones; these go to the smaller key."""
    rows = index.select(F.col(key), F.col(col))
    blocks, tiles = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // tile))
    part = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    qs = queries.select(F.col(qkey), F.col(col).alias("_q"), part(qkey, tiles, "_a"), every(blocks, "_b"))
    rows = rows.select(key, col, part(key, blocks, "_b"), every(tiles, "_a"))

    def unit(s: pd.Series) -> np.ndarray:
        m = np.stack(s.to_numpy()).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({qkey: [], key: [], "score": [], "_r": []})]
        if len(a) and len(b):
            b = b.sort_values(key)
            keys, other = b[key].to_numpy(), unit(b[col]).T
            for at in range(0, len(a), CHUNK):
                some = a.iloc[at : at + CHUNK]
                s = unit(some["_q"]) @ other
                r = np.round(s, 10)
                top = np.argsort(-r, 1, kind="stable")[:, :k]
                i = np.repeat(np.arange(len(some)), top.shape[1])
                out.append(pd.DataFrame({qkey: some[qkey].to_numpy()[i], key: keys[top.ravel()], "score": s[i, top.ravel()], "_r": r[i, top.ravel()]}))
        return pd.concat(out[1:] or out)

    found = qs.groupBy("_a", "_b").cogroup(rows.groupBy("_a", "_b")).applyInPandas(run, f"{qkey} long, {key} long, score double, _r double")
    w = Window.partitionBy(qkey).orderBy(F.desc("_r"), key)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_r")


def save(index: DataFrame, path: str) -> int:
    """Replaces the stored index as its next version; readers of the one before are not disturbed."""
    return Versions(index.sparkSession, path).commit(index, replace=True)


def load(spark, path: str, version: int | None = None) -> DataFrame:
    rows = Versions(spark, path).read(version)
    if rows is None:
        raise FileNotFoundError(path)
    return rows.drop("_version")
