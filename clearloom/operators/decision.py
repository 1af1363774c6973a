"""Routing: bands, rules by jurisdiction, verdicts, review queue and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearloom.config import DEFAULT, DEFAULT_RULES, RULE_SCHEMA


def low_threshold(track: Column, tier: Column, cfg=DEFAULT) -> Column:
    out = F.when(track == "TEXT", cfg.low_base["TEXT"]).otherwise(cfg.low_base["other"])
    shift = F.lit(0.0)
    for name, by in cfg.tier_shift.items():
        shift = F.when(tier == name, F.lit(by)).otherwise(shift)
    return out + shift


def band(score: Column, track: Column, tier: Column, cfg=DEFAULT) -> Column:
    """BLOCKED, HUMAN_REVIEW or CLEAR; a missing score is 0."""
    s = F.coalesce(score, F.lit(0.0))
    high = F.when(track == "IMAGE", cfg.image_threshold).otherwise(cfg.text_threshold)
    return F.when(s >= high, "BLOCKED").when(s >= low_threshold(track, tier, cfg), "HUMAN_REVIEW").otherwise("CLEAR")


def status_of_band(b: Column) -> Column:
    return F.when(b == "CLEAR", "PASSED").otherwise(b)


def verdict(score: Column, threshold: Column | float = DEFAULT.text_threshold, review: float = DEFAULT.review_threshold) -> Column:
    return F.when(score >= threshold, "BLOCKED").when(score >= review, "REVIEW").otherwise("PASSED")


def clamp(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def rules_table(spark, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([list(r) for r in rules], RULE_SCHEMA)


def apply_rules(rows: DataFrame, rules: DataFrame, key: str, score: str, jurisdiction: str, opted_out: str, tier: str, default: str) -> DataFrame:
    """rows with rule_id and outcome: of the fitting rules the one of least priority, else (null, the column `default`). CLEAR means PASSED.

    Rules are a table of a few rows, folded in order of priority into one expression: no join.
    """
    listed = sorted(rules.collect(), key=lambda r: r.priority)  # configuration, a few rows
    pick, outcome = F.lit(None).cast("string"), F.col(default)
    for r in reversed(listed):
        fits = (F.col(score) >= r.min_confidence) & (F.col(score) <= r.max_confidence)
        if r.jurisdiction != "*":
            fits &= F.upper(jurisdiction) == r.jurisdiction.upper()
        if r.require_tdm_opt_out is not None:
            fits &= F.col(opted_out) == r.require_tdm_opt_out
        if r.target_trust_tiers:
            fits &= F.coalesce(F.col(tier).isin(r.target_trust_tiers), F.lit(False))
        pick = F.when(fits, r.rule_id).otherwise(pick)
        outcome = F.when(fits, "PASSED" if r.outcome == "CLEAR" else r.outcome).otherwise(outcome)
    return rows.withColumns({"rule_id": pick, "outcome": outcome})


def summary(rows: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """Counts by status in one pass, with the share that is blocked."""
    one = lambda s: F.count_if(F.col(status) == s)
    total = F.count("*")
    return rows.groupBy(*(by or [])).agg(
        total.alias("total_assets"), one("PASSED").alias("passed_count"), one("BLOCKED").alias("blocked_count"), F.count_if(F.col(status).isin("HUMAN_REVIEW", "REVIEW")).alias("review_count"), one("ERROR").alias("error_count"),
        F.when(total > 0, 100.0 * one("BLOCKED") / total).otherwise(0.0).alias("block_rate"),
    )


def review_queue(rows: DataFrame) -> DataFrame:
    """Pending reviews, best score first."""
    return rows.filter(F.col("status") == "PENDING").orderBy(F.desc("score"), "asset_id")


def resolve(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue with the reviewers' decisions (asset_id, reviewer_id, approve, notes) applied; attribution names the reviewer."""
    d = decisions.select("asset_id", F.col("reviewer_id").alias("by"), "approve", "notes")
    rows = queue.join(d, "asset_id", "left")
    status = F.when(F.col("approve").isNull(), F.col("status")).when(F.col("approve"), "APPROVED").otherwise("REJECTED")
    return rows.withColumns({"status": status, "reviewer_id": F.coalesce("by", "reviewer_id"), "resolution_notes": F.coalesce("notes", "resolution_notes"), "attribution": F.concat(F.lit("urn:clearloom:reviewer:"), F.col("by"))}).drop("by", "approve", "notes")


def calibration(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, catch_rate, false_positive_rate of score >= threshold against label 0 or 1. One pass: all thresholds are columns of one aggregate."""
    dirty, clean = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    hit = lambda t, x: F.count_if((F.col("label") == x) & (F.col("score") >= t))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    one = scored.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), rate(hit(t, 1), dirty).alias("catch_rate"), rate(hit(t, 0), clean).alias("false_positive_rate")) for t in thresholds)).alias("x"))
    return one.select(F.inline("x"))


def savings(rows: DataFrame, cfg=DEFAULT) -> DataFrame:
    """assets, skipped, skipped_pct, hours_saved of rows with is_duplicate: one row."""
    n = F.count_if("is_duplicate")
    return rows.agg(F.count("*").alias("assets"), n.alias("skipped"), F.round(100.0 * n / F.greatest(F.count("*"), F.lit(1)), 6).alias("skipped_pct"), F.round(cfg.hours_per_skip * n, 6).alias("hours_saved"))


#: MIME types by the pipeline that takes them.
TEXT_TYPES, IMAGE_TYPES = ("text/plain", "application/pdf"), ("image/png", "image/jpeg", "image/webp")


def dispatch(assets: DataFrame, works: DataFrame, images: DataFrame, cfg=DEFAULT) -> DataFrame:
    """asset_id, track, matched, score, verdict by MIME type. assets: asset_id, mime_type, text (decoded bytes), phash; works: item_id, text; images: item_id, phash.

    Texts go through recall and chunks, images through perceptual hashes; other types pass as texts with score 0, as nothing looks at them. An image without hash scores 0.
    """
    from . import simjoin, tracks

    text, image = F.col("mime_type").isin(*TEXT_TYPES), F.col("mime_type").isin(*IMAGE_TYPES)
    a = simjoin.two_stage(assets.filter(text).select(F.col("asset_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), works, cfg).select(F.col("doc_id").alias("asset_id"), F.col("matched").cast("string").alias("matched"), "score")
    near = tracks.image_match(assets.filter(image & F.col("phash").isNotNull()).select("asset_id", F.col("phash").alias("a_hash")), images.select("item_id", F.col("phash").alias("i_hash")), cfg)
    found = a.unionByName(near.select("asset_id", F.col("matched").cast("string").alias("matched"), "score"))
    rows = assets.select("asset_id", "mime_type").join(found, "asset_id", "left").withColumn("score", clamp(F.coalesce("score", F.lit(0.0))))
    threshold = F.when(image, cfg.image_threshold).otherwise(cfg.text_threshold)
    return rows.select("asset_id", F.when(image, "IMAGE").otherwise("TEXT").alias("track"), "matched", "score", F.when(text | image, verdict(F.col("score"), threshold)).otherwise("PASSED").alias("verdict"))
