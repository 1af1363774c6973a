"""Image and video tracks: perceptual hashes first, pixels only for what passes the gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearloom.config import DEFAULT
from clearloom.functions import fingerprint as fp

from .simjoin import hamming_join, small


#: Frames of a video that are compared.
KEY_FRAMES = 5


def image_match(assets: DataFrame, index: DataFrame, cfg=DEFAULT) -> DataFrame:
    """asset_id, is_match, matched, score: closest index image with fewer than phash_distance bits of difference (ties: smaller item_id); score 1 - bits / 64. No source is named below the threshold."""
    met = hamming_join(assets, index, "asset_id", "item_id", "a_hash", "i_hash", cfg.phash_distance - 1)
    best = met.groupBy("asset_id").agg(F.min(F.struct("dist", "item_id")).alias("b"))
    rows = assets.select("asset_id").join(best, "asset_id", "left")
    score = F.coalesce(F.round(1 - F.col("b.dist") / 64.0, 4), F.lit(0.0))
    return rows.select("asset_id", (score >= cfg.image_threshold).alias("is_match"), F.when(score >= cfg.image_threshold, F.col("b.item_id")).alias("matched"), score.alias("score"))


def dictionary_query(assets: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """asset_id, item_id, dist within `most` bits, nearest first."""
    return hamming_join(assets, index, "asset_id", "item_id", "a_hash", "i_hash", most).orderBy("asset_id", "dist", "item_id")


def deep_compare(pairs: DataFrame) -> DataFrame:
    """asset_id, item_id, score: cosine of 32x32 colour pixels, for pairs that passed the hash gate. pairs: a and b as structs of Spark's image fields."""

    def vector(x: dict) -> np.ndarray:
        h, w, c = x["height"], x["width"], x["nChannels"]
        m = np.frombuffer(x["data"], np.uint8).reshape(h, w, c).astype(np.float64)
        m = np.stack([fp.shrink(m[..., i]) for i in range(c)], 2).ravel()
        return m / (np.linalg.norm(m) or 1.0)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"asset_id": pdf["asset_id"], "item_id": pdf["item_id"], "score": [float(vector(a) @ vector(b)) if a["nChannels"] == b["nChannels"] else 0.0 for a, b in zip(pdf["a"], pdf["b"])]})

    return pairs.select("asset_id", "item_id", "a", "b").mapInPandas(run, "asset_id string, item_id string, score double")


def video_match(frames: DataFrame, index: DataFrame, most: int = KEY_FRAMES, cfg=DEFAULT) -> DataFrame:
    """video_id, is_match, matched, score: up to `most` key frames (video_id, frame, a_hash) as images; the first that matches decides, else the best score."""
    kept = frames.filter(F.col("frame") < most).withColumn("asset_id", F.concat_ws("#", "video_id", "frame"))
    got = image_match(kept, small(index), cfg).join(kept.select("asset_id", "video_id", "frame"), "asset_id")
    first = F.min(F.when(F.col("is_match"), F.struct("frame", "matched", "score")))
    rows = got.groupBy("video_id").agg(first.alias("f"), F.max("score").alias("top"))
    return rows.select("video_id", F.col("f").isNotNull().alias("is_match"), F.col("f.matched").alias("matched"), F.coalesce("f.score", "top").alias("score"))
