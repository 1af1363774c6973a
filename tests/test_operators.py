"""Operators against golden values and independent Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearloom import config
from clearloom.functions import fingerprint as fp
from clearloom.functions import text as tx
from clearloom.operators import decision, dedup, governance, provenance, sinks, tracks, vector
from clearloom.plans import catalogue
from clearloom.sources import assets, web
from clearloom.streaming import queue


def test_chunks_of_a_long_text(spark):
    rows = spark.createDataFrame([(" ".join(f"tok_{i}" for i in range(10_000)),), ("one two",), ("",)], "text string").select(tx.chunks(F.col("text")).alias("c")).collect()
    assert [len(r.c) for r in rows] == [49, 1, 0]
    assert rows[0].c[1].start_token == 206 and rows[0].c[-1].end_token == 10_000 and rows[1].c[0].chunk_text == "one two"


def test_simhash(spark):
    def want(text):
        import re

        v = [0] * 64
        for w in re.findall(r"\b\w{3,}\b", text.lower()):
            h = int(hashlib.md5(w.encode()).hexdigest()[16:], 16)
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        return sum(1 << i for i in range(64) if v[i] > 0)

    texts = ["The quick brown fox jumps over the lazy dog again", "alpha beta gamma", "", "a an"]
    got = {r.i: r.simhash % (1 << 64) for r in fp.simhash(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "i", "text").collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_sniff(spark):
    cases = [(b"\x89PNG\r\n\x1a\n0000", "a.public_domain", "IMAGE"), (b"RIFF0000WAVEfmt ", "a", "AUDIO"), (b"RIFF0000WEBP", "a", "IMAGE"), (b"0000ftypmp42", "a", "VIDEO"), (b"def f(): pass", "a.txt", "CODE"), (b"x", "m.py", "CODE"), (b"plain words", "a.txt", "TEXT"), (b"\x00\x01", "a.mp3", "AUDIO"), (b"\x00\x01", "a.bin", "UNSUPPORTED"), (b"", "a", "TEXT")]
    rows = spark.createDataFrame([(bytearray(c), n) for c, n, _ in cases], "content binary, name string")
    assert [r.k.track for r in rows.select(assets.sniff(F.col("content"), F.col("name")).alias("k")).collect()] == [k for _, _, k in cases]


def test_code_structure_ignores_names():
    a, b = "def f(x):\n    y = x + 1\n    return y", "def g(count):\n    total = count + 1\n    return total"
    assert fp.code_structure(a) == fp.code_structure(b) and "FuncDef" in fp.code_structure(a)
    assert fp.code_structure("int main( {") == "id id( {"


def test_acoustic_fingerprint(spark):
    data = b"RIFF....WAVEfmt " + b"AUDIOPEAKDATA" * 400
    want = "-".join(str(int(hashlib.md5(data[i : i + 2048]).hexdigest(), 16) % 100) for i in range(0, len(data), 2048))
    got = spark.createDataFrame([(bytearray(data),), (bytearray(),)], "c binary").select(fp.acoustic_fingerprint(F.col("c")).alias("f")).collect()
    assert got[0].f == want and got[1].f == hashlib.sha256(b"").hexdigest()[:32]


def test_phash_is_stable_under_scaling():
    ramp = np.add.outer(np.arange(64.0), 2 * np.arange(64.0))
    a, b = fp.phash(fp.shrink(ramp)), fp.phash(fp.shrink(np.kron(ramp, np.ones((4, 4)))))
    assert bin(a ^ b).count("1") <= 2


def test_band_and_rules(spark):
    rows = spark.createDataFrame([(1, 0.76, "TEXT", None, "GLOBAL", False), (2, 0.82, "TEXT", None, "EU", True), (3, 0.82, "TEXT", None, "US", False), (4, 0.86, "TEXT", "high-risk-domain", "GLOBAL", False), (5, None, "IMAGE", None, "EU", True), (6, 0.56, "TEXT", "high-risk-domain", "EU", False)], "id int, score double, track string, tier string, j string, o boolean")
    rows = rows.withColumn("band", decision.band(F.col("score"), F.col("track"), F.col("tier"))).withColumn("status", decision.status_of_band(F.col("band")))
    got = {r.id: (r.band, r.outcome) for r in decision.apply_rules(rows, decision.rules_table(spark), "id", "score", "j", "o", "tier", "status").collect()}
    assert got == {1: ("HUMAN_REVIEW", "HUMAN_REVIEW"), 2: ("HUMAN_REVIEW", "BLOCKED"), 3: ("HUMAN_REVIEW", "HUMAN_REVIEW"), 4: ("BLOCKED", "BLOCKED"), 5: ("CLEAR", "PASSED"), 6: ("HUMAN_REVIEW", "HUMAN_REVIEW")}


def test_leaders_are_greedy(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([(1, "a", 0b0011), (2, "b", 0b0111), (3, "c", 0b11111111), (4, "a", 0b0011), (5, "d", 0)], "k long, d string, h long")
    got = {r.k: r.leader for r in dedup.elect_leaders(rows, "k", "d", "h", 3).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_takedown_flags_only_later_versions(spark):
    cleared = spark.createDataFrame([("a", "TEXT", "some cleared text of a work", 1), ("b", "TEXT", "some cleared text of a work", 3)], "asset_id string, track string, text_content string, checked_index_version long")
    notices = spark.createDataFrame([("n", "TEXT", "some cleared text of a work", 2)], "notice_id string, track string, sample_content string, index_version long")
    assert [(r.asset_id, r.action) for r in governance.delta_flagged(cleared, notices, 1, 2).collect()] == [("a", "REVOKE_AND_BLOCK")]


def test_leakage_is_found_and_redacted(spark):
    work = spark.createDataFrame([("one two three four five six seven eight",)], "text string")
    out = spark.createDataFrame([(1, "He said ONE two three four five six seven eight."), (2, "nothing here")], "id int, text string")
    got = {r.id: (r.leaked, r.gated_text) for r in governance.leakage_gate(out, work, "id").collect()}
    assert got[2] == (False, "nothing here") and got[1][0] and "[REDACTED]" in got[1][1]


def test_signatures(spark):
    signer = provenance.Signer(spark)
    rows = signer.sign(spark.createDataFrame([("x",), ("y",)], "m string"), "m")
    assert all(r.signature_valid for r in signer.verify(rows, "m", "signature_b64").collect())
    assert not any(r.signature_valid for r in signer.verify(rows.withColumn("m", F.lit("z")), "m", "signature_b64").collect())
    again = provenance.Signer.from_pem(spark, signer.public_pem(), signer.private_pem())
    assert again.fingerprint() == signer.fingerprint() and all(r.signature_valid for r in again.verify(rows, "m", "signature_b64").collect())


def test_audit_and_evidence(spark, tmp_path):
    log = sinks.AuditLog(str(tmp_path / "audit"))
    log.append(spark.sql("SELECT 1L id, 'b' batch_id, 'h' asset_hash, timestamp'2026-01-05' recorded_at"))
    log.append(spark.sql("SELECT 2L id, 'b' batch_id, 'h' asset_hash, timestamp'2026-02-05' recorded_at"))
    assert [r.id for r in log.by_hash(spark, "h").collect()] == [2, 1]
    with pytest.raises(PermissionError):
        log.update()
    locker, row = sinks.EvidenceLocker(str(tmp_path / "worm")), spark.sql("SELECT 'sha256:ab12' asset_hash, 'x' span")
    locker.store(row)
    with pytest.raises(FileExistsError):
        locker.store(row)
    assert locker.retrieve(spark, "sha256:ab12").count() == 1


def test_images_and_videos(spark):
    a = spark.createDataFrame([("x", 0b111), ("y", -1)], "asset_id string, a_hash long")
    i = spark.createDataFrame([("w", 0)], "item_id string, i_hash long")
    assert {r.asset_id: (r.is_match, r.matched) for r in tracks.image_match(a, i).collect()} == {"x": (True, "w"), "y": (False, None)}
    frames = spark.createDataFrame([("v", 0, -1), ("v", 1, 0b1)], "video_id string, frame int, a_hash long")
    assert tracks.video_match(frames, i).first().matched == "w"


def test_vector_top_k(spark):
    x = np.random.default_rng(42).normal(size=(50, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, e array<double>")
    got = vector.top_k(v, v.withColumnRenamed("vec_id", "q"), "vec_id", "q", "e", 1, 16).collect()
    assert all(r.q == r.vec_id and abs(r.score - 1) < 1e-9 for r in got) and len(got) == 50


def test_prefilter(spark):
    rows = spark.createDataFrame([(1, True, "User-agent: *\nDisallow: /x", None, None, None), (2, True, None, "1 ", None, None), (3, True, None, "TRUE", '<META name="tdm-reservation" content="true">', "MIT"), (4, True, None, None, "see creativecommons.org", None), (5, False, None, None, None, None)], "id int, robots_ok boolean, ai_txt string, tdm_header string, html string, license_header string")
    got = {r.id: (r.allowed, r.skip_reason, r.license_hint) for r in web.prefilter(rows).collect()}
    assert got[1][:2] == (False, "ai.txt") and got[2][1] == "tdm-reservation header" and got[3][1:] == ("tdm-reservation meta", "MIT") and got[4] == (True, None, "Creative Commons") and got[5][1] == "robots.txt"


def test_queue_retries(spark):
    rows = spark.createDataFrame([("a", i, f"e{i}") for i in range(4)] + [("b", 0, "x")], "item_id string, seq int, error string")
    got = {r.item_id: (r.dead, r.priority, r.error_log[-1]) for r in queue.retried(rows).collect()}
    assert got == {"a": (True, 25, "Attempt 4: e3"), "b": (False, 15, "Attempt 1: x")}


def test_scan_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for i in range(2):
        spark.range(i * 5, i * 5 + 5).write.mode("append").parquet(src)
        queue.scan_stream(spark, src, "id long", lambda b: b.withColumn("status", F.lit("PASSED")), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_sources_registry(spark):
    s = spark.createDataFrame([("a", True, 5), ("b", True, None), ("c", False, None)], "source_id string, active boolean, last_crawled_at int")
    assert [r.source_id for r in web.due_sources(s).collect()] == ["b", "a"]
    state = spark.createDataFrame([("k", 1, "old"), ("m", 1, "kept")], "key string, seq int, v string")
    new = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, seq int, v string")
    assert {r.key: r.v for r in web.upsert(state, new, "key").collect()} == {"k": "y", "m": "kept"}


def test_leaders_of_a_long_chain(spark, tmp_path):
    """Each row is near the one before it alone, so rows settle one by one."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    hashes = [(2 << k) - 1 for k in range(58)]  # a SimHash of 0 takes no part
    rows = spark.createDataFrame([(k, str(k), h) for k, h in enumerate(hashes)], "k long, d string, h long")
    want, leaders = {}, []
    for k, h in enumerate(hashes):
        want[k] = next((m for m in leaders if bin(hashes[m] ^ h).count("1") <= 1), k)
        leaders += [k] * (want[k] == k)
    assert {r.k: r.leader for r in dedup.elect_leaders(rows, "k", "d", "h", 1).collect()} == want


def test_sniff_reads_the_head_of_every_text(spark, tmp_path):
    word = config.CODE_KEYWORDS[0]
    texts = ["plain", word, "é" * 3000, "x" * 4095 + "é" * 50, "a " * 2040 + word + " b" * 3000, "a" * 5000 + word, "y" * (4096 - len(word)) + word, "z" * (4097 - len(word)) + word + "z" * 5000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    head = lambda t: t.encode()[:4096]
    want = {i: "CODE" if any(k.encode() in head(t) for k in config.CODE_KEYWORDS) else "TEXT" for i, t in enumerate(texts) if t is not None}
    got = {r.doc_id: r.track for r in catalogue.asset_sniff(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and {i: got[i] for i in want} == want and list(want.values()).count("CODE") == 3
