"""The whole evaluation of assets in one plan: hashes, duplicates, earlier decisions, similarity by track, routing, rules by jurisdiction, certificates and lineage."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearloom.config import DEFAULT
from clearloom.functions import fingerprint as fp

from . import decision, dedup, provenance, simjoin, tracks


@dataclass(frozen=True)
class Scorer:
    """pairs: (assets with doc_id and the columns of CONTENT, index) -> doc_id, item_id, score. comparable: whether there is something of the asset to compare."""

    pairs: Callable[[DataFrame, DataFrame], DataFrame]
    comparable: Callable[[], Column] = lambda: F.lit(True)


def _images(assets: DataFrame, index: DataFrame) -> DataFrame:
    near = simjoin.hamming_join(assets.select("doc_id", F.col("phash").alias("a_hash")), index.select("item_id", F.col("phash").alias("i_hash")), "doc_id", "item_id", "a_hash", "i_hash", DEFAULT.phash_distance - 1)
    return near.select("doc_id", "item_id", (1 - F.col("dist") / 64.0).alias("score"))


def _videos(assets: DataFrame, index: DataFrame) -> DataFrame:
    frames = assets.select("doc_id", F.posexplode(F.slice("frames", 1, tracks.KEY_FRAMES)).alias("frame", "phash")).withColumn("doc_id", F.struct("doc_id", "frame"))
    return _images(frames, index).groupBy("doc_id.doc_id", "item_id").agg(F.max("score").alias("score"))


#: Columns that hold an asset's content: text (text, code), bytes (audio), perceptual hash (image), hashes of key frames (video).
CONTENT = {"text": "string", "content": "binary", "phash": "bigint", "frames": "array<bigint>"}

TOKENS = Scorer(lambda docs, works: simjoin.text_scores(docs, works).select("doc_id", "item_id", "score"))

#: Scorers of tracks; register() adds or replaces one. An asset of a track without scorer or index, or with nothing to compare, never passes.
SCORERS: dict[str, Scorer] = {
    "TEXT": Scorer(lambda docs, works: simjoin.full_text_pairs(docs, works)),
    "CODE": Scorer(lambda docs, works: simjoin.code_match(docs, works, best=1).select("doc_id", "item_id", "score")),
    "IMAGE": Scorer(_images, lambda: F.col("phash").isNotNull()),
    "AUDIO": Scorer(simjoin.audio_match, lambda: F.col("content").isNotNull()),
    "VIDEO": Scorer(_videos, lambda: F.size("frames") > 0),
}


def register(track: str, scorer: Scorer) -> None:
    SCORERS[track] = scorer


def evaluate(assets: DataFrame, indexes: DataFrame | Mapping[str, DataFrame], cfg=DEFAULT, scorers: Mapping[str, Scorer] | None = None, state: DataFrame | None = None) -> DataFrame:
    """Per asset (asset_id, track, tier, jurisdiction, opted_out, and of CONTENT what its track needs; asset_hash where known): asset_hash, is_duplicate, compared, matched, score, status, rule_id, outcome and, where the outcome is PASSED, certificate_id.

    indexes: the indexed works (item_id and content) of each track; one table alone is that of texts. state: earlier decisions (asset_hash, track, status, matched_source), one for each hash and track; an asset that was decided before keeps its status and isn't scored.
    Equal contents of a track are scored once, as the first of them; each asset is routed by its own tier and rules. Ties go to the smaller item_id. What no scorer compared is HUMAN_REVIEW (ERROR on the track UNSUPPORTED), whatever the rules say, and gets no certificate. A null score is 0.
    """
    scorers = SCORERS if scorers is None else scorers
    indexes = {"TEXT": indexes} if isinstance(indexes, DataFrame) else indexes
    rows = assets.withColumns({c: F.lit(None).cast(t) for c, t in CONTENT.items() if c not in assets.columns})
    if "asset_hash" not in rows.columns:
        rows = rows.withColumn("asset_hash", fp.sha256_prefixed(F.coalesce("content", F.coalesce("text", F.col("phash").cast("string"), F.array_join("frames", " "), F.lit("")).cast("binary"))))
    rows = rows.withColumn("__kind", F.concat_ws(" ", "track", "asset_hash"))
    rows = rows.join(dedup.first_seen(rows.select("asset_id", "__kind"), "asset_id", "__kind"), "asset_id")
    if state is not None:
        known = state.filter(F.col("status").isin("PASSED", "BLOCKED")).select(F.concat_ws(" ", "track", "asset_hash").alias("__kind"), F.col("status").alias("__status"), F.when(F.col("status") == "BLOCKED", F.col("matched_source")).cast("string").alias("__source"))
        rows = rows.join(known, "__kind", "left")
    else:
        rows = rows.withColumns({"__status": F.lit(None).cast("string"), "__source": F.lit(None).cast("string")})
    live = {t: s for t, s in scorers.items() if t in indexes}
    compared = F.lit(False)
    for track, scorer in live.items():
        compared = F.when(F.col("track") == track, F.coalesce(scorer.comparable(), F.lit(False))).otherwise(compared)
    rows = rows.withColumn("compared", compared)
    lead = rows.filter(~F.col("is_duplicate") & F.col("compared") & F.col("__status").isNull())
    best = None
    for track, scorer in live.items():
        mine = lead.filter(F.col("track") == track).select(F.col("asset_id").alias("doc_id"), *CONTENT)
        found = simjoin.top_k(scorer.pairs(mine, indexes[track]), "doc_id", "score", "item_id", 1)
        found = found.select(F.col("doc_id").alias("leader"), F.col("item_id").cast("string").alias("matched"), F.col("score").cast("double").alias("score"))
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = rows.sparkSession.createDataFrame([], rows.select("leader").schema).withColumns({"matched": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    rows = rows.join(best, "leader", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 4))
    before = F.col("__status").isNotNull()
    rows = rows.withColumns({"matched": F.when(before, F.col("__source")).otherwise(F.col("matched")), "score": F.when(before, F.when(F.col("__status") == "BLOCKED", 1.0)).otherwise(F.col("score")), "is_duplicate": F.col("is_duplicate") | before})
    banded = decision.status_of_band(decision.band(F.col("score"), F.col("track"), F.col("tier"), cfg))
    never = F.when(F.col("track") == "UNSUPPORTED", "ERROR").otherwise("HUMAN_REVIEW")
    rows = rows.withColumn("status", F.when(before, F.col("__status")).when(F.col("compared"), banded).otherwise(never))
    rows = decision.apply_rules(rows, decision.rules_table(rows.sparkSession), "asset_id", "score", "jurisdiction", "opted_out", "tier", "status")
    ruled = F.col("compared") & ~before
    rows = rows.withColumns({"outcome": F.when(ruled, F.col("outcome")).otherwise(F.col("status")), "rule_id": F.when(ruled, F.col("rule_id")), "compared": F.col("compared") | before})
    issued = F.when(F.col("outcome") == "PASSED", provenance.certificate_id(F.col("asset_id"), F.col("asset_hash")))
    return rows.select("asset_id", "asset_hash", "track", "tier", "jurisdiction", "is_duplicate", "compared", "matched", "score", "status", "rule_id", "outcome", issued.alias("certificate_id"))


def payload(key_id: Column | str) -> Column:
    """What a certificate's signature covers: its fields but the signature, as sorted JSON."""
    return provenance.canonical_json(asset_hash=F.col("asset_hash"), asset_id=F.col("asset_id").cast("string"), certificate_id=F.col("certificate_id"), issued_at=F.col("issued_at"), issuer=F.col("issuer"), key_id=key_id if isinstance(key_id, Column) else F.lit(key_id))


def certificates(rows: DataFrame, signer: provenance.Signer, issued_at: Column) -> DataFrame:
    """Certificate records of evaluated assets that passed: certificate_id, asset_id, asset_hash, issuer, issued_at, key_id, payload, signature_b64."""
    out = rows.filter(F.col("certificate_id").isNotNull()).select("certificate_id", "asset_id", "asset_hash", F.lit(signer.issuer).alias("issuer"), issued_at.cast("string").alias("issued_at"), F.lit(signer.fingerprint()).alias("key_id"))
    return signer.sign(out.withColumn("payload", payload(F.col("key_id"))), "payload")


def verified(records: DataFrame, keys: list[provenance.Signer]) -> DataFrame:
    """records with reason: UNKNOWN_KEY, PAYLOAD_MISMATCH (a field differs from what was signed), SIGNATURE_INVALID or SIGNATURE_VALID. keys: those in use and those retired, a few."""
    rows, valid = records, F.lit(None).cast("boolean")
    for i, key in enumerate(keys):
        rows = key.verify(rows, "payload", "signature_b64", f"__{i}")
        valid = F.when(F.col("key_id") == key.fingerprint(), F.col(f"__{i}")).otherwise(valid)
    same = F.col("payload").eqNullSafe(payload(F.col("key_id")))
    reason = F.when(valid.isNull(), "UNKNOWN_KEY").when(~same, "PAYLOAD_MISMATCH").when(~valid, "SIGNATURE_INVALID").otherwise("SIGNATURE_VALID")
    return rows.withColumn("reason", reason).drop(*(f"__{i}" for i in range(len(keys))))


def lineage(rows: DataFrame, at: Column) -> DataFrame:
    """asset_id, prov of evaluated assets."""
    none = F.lit(None).cast("string")
    return provenance.prov_document(rows.withColumns({"matched_source": F.col("matched").cast("string"), "mime_type": F.lit("text/plain"), "size_bytes": none, "started_at": at.cast("string"), "ended_at": at.cast("string"), "source_url": none, "trust_tier": F.col("tier"), "status": F.col("outcome")}))
