"""Loaders, intake, reports, cards, lineage documents and small functions against expected values."""

import difflib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearloom.functions import fingerprint as fp
from clearloom.functions import image
from clearloom.functions import text as tx
from clearloom.operators import decision, governance, provenance, sinks, tracks
from clearloom.sources import assets, web


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_discover(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "z.txt").write_text("plain words")
    (tmp_path / "a" / "m.py").write_text("x = 1")
    (tmp_path / "a" / "b" / "s.wav").write_bytes(b"RIFF0000WAVEfmt ")
    (tmp_path / "a" / "b" / "no.bin").write_bytes(b"\0\1\2")
    got = assets.discover(spark, str(tmp_path)).collect()
    assert [(r.asset_id.rpartition("/")[2], r.track, r.size_bytes) for r in got] == [("s.wav", "AUDIO", 16), ("m.py", "CODE", 5), ("z.txt", "TEXT", 11)]
    assert [r.track for r in assets.discover(spark, str(tmp_path / "z.txt")).collect()] == ["TEXT"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        assets.discover(spark, str(tmp_path / "missing")).collect()


def test_text_is_decoded_and_has_one_kind_of_newline(spark):
    rows = spark.createDataFrame([(bytearray(b"a\r\nb\rc\nd"),), (bytearray("é".encode() + b"\xff\xfe!"),), (bytearray(b""),), (None,)], "c binary")
    got = [r.t for r in rows.select(assets.text_of(F.col("c")).alias("t")).collect()]
    assert got[0] == "a\nb\nc\nd" and got[1].startswith("é�") and got[1].endswith("!") and got[2:] == ["", None]


def test_text_index_with_and_without_metadata(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for n in ("one", "two"):
        (tmp_path / "t" / f"{n}.txt").write_text(f"text {n}")
    plain = {(r.item_id, r.title, r.text) for r in assets.text_index(spark, str(tmp_path)).collect()}
    assert plain == {("one.txt", "© Work: one", "text one"), ("two.txt", "© Work: two", "text two")}
    (tmp_path / "metadata.json").write_text(json.dumps({"texts": [{"id": "w1", "file": "two.txt", "source": "Second"}]}))
    assert [tuple(r) for r in assets.text_index(spark, str(tmp_path)).collect()] == [("w1", "Second", "text two")]
    (tmp_path / "metadata.json").write_text(json.dumps({"texts": [{"id": "w1", "file": "none.txt", "source": "x"}]}))
    assert {r.item_id for r in assets.text_index(spark, str(tmp_path)).collect()} == {"one.txt", "two.txt"}


def test_code_and_media_index(spark, tmp_path):
    (tmp_path / "gpl.py").write_text("# GNU General Public License\n// RefCorpus: The Work */\nx = 1")
    (tmp_path / "m.js").write_text("// MIT\nfunction f() {}")
    (tmp_path / "song.wav").write_bytes(b"abc")
    got = {r.item_id: (r.title, r.license) for r in assets.code_index(spark, str(tmp_path)).collect()}
    assert got == {"gpl.py": ("RefCorpus: The Work", "GPL-3.0"), "m.js": ("© Codebase: m [Permissive]", "Permissive")}
    assert [(r.title, bytes(r.content)) for r in assets.media_index(spark, str(tmp_path)).collect()] == [("RefCorpus: Audio Master [song]", b"abc")]


def test_intake(spark):
    event = json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": f"k{i}"}}} for i in range(2)]})
    rows = spark.createDataFrame([(event,), ('{"Records": []}',), ("not json",)], "payload string")
    assert sorted(tuple(r) for r in assets.s3_events(rows).collect()) == [("b", "k0", "QUEUED_FOR_SCAN"), ("b", "k1", "QUEUED_FOR_SCAN")]
    asked = spark.createDataFrame([("a1", "file:/x"), ("a2", "http://y")], "asset_id string, source_uri string")
    held = spark.createDataFrame([("file:/x", bytearray(b"bytes"))], "source_uri string, content binary")
    assert {r.asset_id: bytes(r.content) for r in assets.intake(asked, held).collect()} == {"a1": b"bytes", "a2": b"http://y"}


def test_batches_are_quarantined(spark):
    sha = "sha256:" + "0" * 64
    good = lambda a, b="b-1": (a, b, "text/plain", 0.5, sha)
    rows = [good("a"), good("b"), good("", "b-2"), good("x" * 257, "b-2"), ("c", "b", "text/plain", 0.5, sha), ("d", "b-2", "text/html", 0.5, sha), ("e", "b-2", "text/plain", 1.1, sha), ("f", "b-2", "text/plain", None, sha), ("g", "b-2", "text/plain", 1.0, sha + "0"), ("h", None, "text/plain", 0.0, sha)]
    rows += [good(f"m{i}", "big") for i in range(8)]
    accepted, bad = assets.batches(spark.createDataFrame(rows, "asset_id string, batch_id string, mime_type string, score double, asset_hash string"), (1, 7))
    assert {r.asset_id for r in accepted.collect()} == {"a", "b"}
    assert sorted((r.asset_id[:2], r.reason) for r in bad.collect()) == sorted([("", "asset_id"), ("xx", "asset_id"), ("c", "batch_id"), ("d", "mime_type"), ("e", "score"), ("f", "score"), ("g", "asset_hash"), ("h", "batch_id"), *((f"m{i}", "batch_size") for i in range(8))])


def test_staged_assets_know_their_origin(spark):
    rows = [("https://a.org/p/x.py?q", bytearray(b"import os"), "e1", None, 1, "s1", "CC", False), ("https://a.org/p/x.py?q", bytearray(b"import sys"), "e2", "m", 2, "s1", None, True), ("https://b.org/", bytearray(b"hello"), None, None, 1, "s9", None, False)]
    fetched = spark.createDataFrame(rows, "url string, content binary, etag string, last_modified string, fetched_at long, source_id string, license_hint string, tdm_opted_out boolean")
    made, cache = assets.staged(fetched, spark.createDataFrame([("s1", "licensed-partner")], "source_id string, trust_tier string"))
    got = {(r.source_url, r.etag): r for r in made.collect()}
    x, y = got["https://a.org/p/x.py?q", "e2"], got["https://b.org/", None]
    assert (x.track, x.domain, x.source_trust_tier, x.tdm_opted_out, x.size_bytes) == ("CODE", "a.org", "licensed-partner", True, 10) and x.asset_id.endswith("_x.py") and x.asset_id[:12] == x.asset_hash[7:19]
    assert (y.track, y.source_trust_tier) == ("TEXT", None) and y.asset_id.endswith("_asset") and len(got) == 3
    assert {r.url: (r.etag, r.last_modified, r.fetched_at) for r in cache.collect()} == {"https://a.org/p/x.py?q": ("e2", "m", 2), "https://b.org/": (None, None, 1)}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "PASSED", "TEXT", None, 0.1, "h", "c", "more")], "asset_id string, status string, track string, matched_source string, similarity_score double, asset_hash string, certificate_id string, extra string")
    sinks.report_json(rows, str(tmp_path / "full"))
    sinks.report_json(rows, str(tmp_path / "small"), minimal=True)
    assert spark.read.json(str(tmp_path / "full")).first().extra == "more"
    assert set(spark.read.json(str(tmp_path / "small")).columns) == set(sinks.MINIMAL) - {"matched_source"}  # nulls aren't written


def test_cards(spark):
    rows = spark.createDataFrame([(i, "PASSED" if i % 3 else "BLOCKED", f"c{i}" if i % 3 else None, "MIT" if i % 2 else None) for i in range(20)], "asset_id long, status string, certificate_id string, license_hint string")
    stats = governance.card_stats(rows).orderBy("status", "license").collect()
    assert sum(r.n for r in stats) == 20 and {r.license for r in stats} == {"MIT", "Proprietary/Unspecified"}
    card = governance.card_markdown("set", "run", stats, ["c1", "c2", "c4", "c5", "c7", "c8"])
    assert "- assets: 20" in card and "- passed: 65.0 %" in card and card.endswith("Certificates: c1, c2, c4, c5, c7\n")
    got = governance.card_summary(rows).first()
    assert (got.total, got.passed, got.passed_pct, got.certificates, got.first_certificates) == (20, 13, 65.0, 13, "c1, c2, c4, c5, c7")
    none = governance.card_summary(rows.limit(0)).first()
    assert (none.total, none.certificates, none.first_certificates) == (0, 0, "")


def test_lineage_document(spark):
    row = {"asset_id": "a.txt", "asset_hash": "sha256:ab", "track": "TEXT", "status": "PASSED", "score": 0.5, "matched_source": None, "certificate_id": "c1", "mime_type": "text/plain", "size_bytes": 7, "started_at": "t0", "ended_at": "t1", "source_url": None, "trust_tier": "licensed-partner", "jurisdiction": "EU"}
    schema = "asset_id string, asset_hash string, track string, status string, score double, matched_source string, certificate_id string, mime_type string, size_bytes long, started_at string, ended_at string, source_url string, trust_tier string, jurisdiction string"
    doc = json.loads(provenance.prov_document(spark.createDataFrame([tuple(row.values())], schema)).first().prov)
    act = doc["prov:wasGeneratedBy"]
    assert doc["@id"] == "urn:clearloom:asset:sha256:ab" and act["@id"].endswith("scan:sha256_ab") and act["cl:certificateId"] == "c1" and "cl:matchedSource" not in act
    assert doc["prov:wasDerivedFrom"]["cl:byteSize"] == 7 and act["prov:startedAtTime"] == "t0" and "prov:atLocation" not in doc["prov:wasDerivedFrom"]


def test_reviews_are_resolved(spark):
    queue = spark.createDataFrame([("a", 0.7, "PENDING", None, None), ("b", 0.8, "PENDING", None, None), ("c", 0.6, "PENDING", None, None)], "asset_id string, score double, status string, reviewer_id string, resolution_notes string")
    done = decision.resolve(queue, spark.createDataFrame([("a", "r1", True, "fine"), ("b", "r2", False, None)], "asset_id string, reviewer_id string, approve boolean, notes string"))
    assert {r.asset_id: (r.status, r.reviewer_id, r.resolution_notes, r.attribution) for r in done.collect()} == {"a": ("APPROVED", "r1", "fine", "urn:clearloom:reviewer:r1"), "b": ("REJECTED", "r2", None, "urn:clearloom:reviewer:r2"), "c": ("PENDING", None, None, None)}


def test_small_functions(spark):
    assert one(spark, fp.simhash_similarity(F.col("a"), F.col("b")), a=0b1011, b=0b0010) == 1 - 2 / 64
    assert one(spark, fp.simhash_similarity(F.col("a"), F.col("b")), a=-1, b=0) == 0.0
    assert one(spark, provenance.canonical_json(b=F.col("b"), a=F.col("a")), a="1", b="x") == '{"a":"1","b":"x"}'
    assert one(spark, tx.code_title(F.col("t"), F.lit("stem")), t="x\n/* RefCorpus: Deep Thought */\ny") == "RefCorpus: Deep Thought"
    assert one(spark, tx.code_title(F.col("t"), F.lit("stem")), t="Apache") == "© Codebase: stem [Permissive]"
    assert provenance.fresh_id() != provenance.fresh_id() and len(provenance.fresh_id()) == 36
    pairs = [("tide", "diet"), ("diet", "tide"), ("x" + "ab" * 200, "ab" * 200), ("", ""), ("a", "")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", fp.difflib_ratio("a", "b").alias("r"))
    assert [r.r for r in sorted(rows.collect())] == [0.25, 0.5, 0.0, 1.0, 0.0] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_image_dictionary_and_pixels(spark):
    a, i = spark.createDataFrame([("q", 0b1111)], "asset_id string, a_hash long"), spark.createDataFrame([("far", -1), ("near", 0b0111), ("same", 0b1111), ("also", 0b1110)], "item_id string, i_hash long")
    assert [(r.item_id, r.dist) for r in tracks.dictionary_query(a, i).collect()] == [("same", 0), ("also", 1), ("near", 1)]
    p = np.random.default_rng(1).integers(0, 255, (40, 40, 3), np.uint8)
    field = lambda x: {"height": x.shape[0], "width": x.shape[1], "nChannels": x.shape[2], "data": bytearray(x.tobytes())}
    kind = "struct<height:int,width:int,nChannels:int,data:binary>"
    rows = spark.createDataFrame([("same", "i", field(p), field(p)), ("grey", "i", field(p), field(p[..., :1]))], f"asset_id string, item_id string, a {kind}, b {kind}")
    got = {r.asset_id: r.score for r in tracks.deep_compare(rows).collect()}
    assert got["same"] == pytest.approx(1.0) and got["grey"] == 0.0
    assert image.rgb(p[..., 0]).shape == (40, 40, 3)


def test_sources_and_lanes(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 3, False), ("c", 2, True), ("d", 3, True)], "source_id string, created_at long, active boolean")
    assert [r.source_id for r in web.list_sources(rows).collect()] == ["b", "d", "c", "a"] and [r.source_id for r in web.list_sources(rows, True).collect()] == ["d", "c", "a"]
    urls = spark.createDataFrame([(f"https://{'hot' if i % 5 else 'cold'}.org/{i}",) for i in range(200)], "url string")
    dealt = web.spread_by_domain(urls, 16).withColumn("part", F.spark_partition_id()).withColumn("host", tx.source_domain(F.col("url")))
    assert dealt.count() == 200 and dealt.groupBy("host").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0] <= 3
