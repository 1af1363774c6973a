"""Change-aware dedup: exact and near duplicates against earlier rows and against kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearloom.config import DEFAULT

from . import graph
from .simjoin import near_pairs


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Upsert: the last row of each key (by seq)."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def first_seen(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """key, leader, is_duplicate: the first row with the same digest. Leaders come from a partial aggregate, so a digest with many rows is no hot group."""
    lead = rows.groupBy(digest).agg(F.min(key).alias("leader"))
    return rows.join(lead, digest).select(key, "leader", (F.col(key) != F.col("leader")).alias("is_duplicate"))


def elect_leaders(rows: DataFrame, key: str, digest: str, simhash: str, most: int = DEFAULT.simhash_distance, by: tuple[str, ...] = ()) -> DataFrame:
    """key, leader: greedy in order of key. A row is a leader unless an earlier leader has its digest or a SimHash at most `most` bits away; a duplicate leads nobody. Rows that differ in a column of `by` (columns without nulls) don't meet.

    Equal rows follow their first; graph.leaders settles the others, one pass for all chains of near copies that lie in one partition.
    """
    firsts = rows.groupBy(digest, *by).agg(F.min(key).alias("first"), F.coalesce(F.min_by(simhash, key), F.lit(0).cast("long")).alias("first_hash"))
    # Rows of one SimHash have the same neighbours: all but the first follow it, or its leader.
    firsts = firsts.withColumn("kind", F.struct("first_hash", F.when(F.col("first_hash") == 0, F.col(digest)).alias("digest"), *by))
    heads = firsts.groupBy("kind", *by).agg(F.min("first").alias("head"), F.max("first_hash").alias("head_hash"))
    edges = near_pairs(heads, "head", "head_hash", most, by).select(F.col("a").alias("_a"), F.col("b").alias("_b")).checkpoint()
    found = graph.leaders(edges).withColumnRenamed("node", "_n")
    state = heads.select(F.col("head").alias("_n")).join(found, "_n", "left").select("_n", F.coalesce("lead", F.lit(True)).alias("_lead"))  # without a neighbour: leads
    chosen = edges.join(state.filter("_lead").select(F.col("_n").alias("_a")), "_a").groupBy("_b").agg(F.min("_a").alias("_near"))
    led = state.join(chosen, F.col("_n") == F.col("_b"), "left").select("_n", F.when(F.col("_lead"), F.col("_n")).otherwise(F.col("_near")).alias("leader"))
    of = firsts.join(heads, ["kind", *by]).select(digest, *by, F.col("head").alias("_n"))
    return rows.join(of, [digest, *by]).join(led, "_n").select(key, "leader")


def fast_path(assets: DataFrame, state: DataFrame) -> DataFrame:
    """Assets (asset_id, asset_hash) whose hash was decided before: status and source are taken over; score stays null for passed ones."""
    known = state.select("asset_hash", F.col("status").alias("prior_status"), F.col("matched_source").alias("prior_source"))
    rows = assets.join(known, "asset_hash", "left")
    return rows.select("asset_id", "asset_hash", F.col("prior_status").isNotNull().alias("is_duplicate"), F.col("prior_status").alias("status"), F.when(F.col("prior_status") == "BLOCKED", F.col("prior_source")).alias("matched_source"))


def recorded(results: DataFrame) -> DataFrame:
    """What enters the state: passed and blocked text, image and code; reviews, errors, audio and video never."""
    return results.filter(F.col("status").isin("PASSED", "BLOCKED") & F.col("track").isin("TEXT", "IMAGE", "CODE"))
