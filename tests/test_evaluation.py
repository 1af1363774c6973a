"""The whole evaluation, certificate records with several keys, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from clearloom import cli
from clearloom.operators import evaluation, provenance

WORK = "the ancient mariner stopped one of three by thy long grey beard and glittering eye now wherefore stoppest thou me"
ROWS = [(1, WORK), (2, "an entirely different text about cooking rice and beans"), (3, "an entirely different text about cooking rice and beans"), (4, None)]


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = spark.createDataFrame(ROWS, "asset_id long, text string").withColumns({"track": F.lit("TEXT"), "tier": F.lit("public-web-unknown"), "jurisdiction": F.lit("GLOBAL"), "opted_out": F.lit(False)})
    return evaluation.evaluate(rows, spark.createDataFrame([(7, WORK)], "item_id long, text string"))


def test_evaluate(evaluated):
    got = {r.asset_id: r for r in evaluated.collect()}
    assert (got[1].outcome, got[1].matched, got[1].certificate_id) == ("BLOCKED", "7", None)
    assert [got[i].outcome for i in (2, 3, 4)] == ["PASSED"] * 3 and got[3].is_duplicate and not got[2].is_duplicate and got[2].asset_hash == got[3].asset_hash


def test_certificates_with_rotated_keys(spark, evaluated):
    old, new = provenance.Signer(spark, bits=1024), provenance.Signer(spark, bits=1024)
    at = F.lit("2026-01-01T00:00:00Z")
    one, two = evaluation.certificates(evaluated.filter("asset_id = 2"), old, at), evaluation.certificates(evaluated.filter("asset_id = 3"), new, at)
    forged = one.withColumn("asset_hash", F.lit("sha256:0"))
    swapped = two.withColumn("signature_b64", F.lit("AAAA"))
    reasons = lambda rows, keys: [r.reason for r in evaluation.verified(rows, keys).collect()]
    assert reasons(one.unionByName(two), [new, old]) == ["SIGNATURE_VALID"] * 2
    assert reasons(one, [new]) == ["UNKNOWN_KEY"] and reasons(forged, [old]) == ["PAYLOAD_MISMATCH"] and reasons(swapped, [new]) == ["SIGNATURE_INVALID"]


def test_lineage_of_evaluated_assets(evaluated):
    got = {r.asset_id: json.loads(r.prov) for r in evaluation.lineage(evaluated, F.lit("2026-01-01T00:00:00Z")).collect()}
    assert len(got) == len(ROWS) and got[2]["@id"].startswith("urn:clearloom:asset:sha256:")


def test_command_line(spark, tmp_path):
    data, index, out = tmp_path / "data", tmp_path / "index", tmp_path / "out"
    (index / "texts").mkdir(parents=True)
    data.mkdir()
    (index / "texts" / "w.txt").write_text(WORK)
    (data / "clean.txt").write_text(ROWS[1][1])
    assert cli.main(["generate-keys", str(tmp_path / "keys")], spark) == 0
    key = str(tmp_path / "keys" / "signer.pem")
    assert cli.main(["scan", str(data), "--index", str(index), "--out", str(out), "--key", key], spark) == 0
    assert cli.main(["verify-cert", f"{out}.certificates", "--public", f"{key}.pub"], spark) == 0
    (data / "copy.txt").write_text(WORK)
    assert cli.main(["scan", str(data), "--index", str(index)], spark) == 2
    assert cli.main(["scan", str(tmp_path / "missing"), "--index", str(index)], spark) == 1


CODE = """
def tally(rows, key):
    total = {}
    for row in rows:
        if row[key] not in total:
            total[row[key]] = 0
        total[row[key]] += 1
    return sorted(total.items(), key=lambda x: -x[1])


class Ledger:
    def __init__(self, path):
        self.path, self.rows = path, []

    def add(self, row):
        self.rows.append(row)
        return len(self.rows)
"""
RENAMED = CODE.replace("tally", "f").replace("rows", "aa").replace("key", "bb").replace("total", "cc").replace("Ledger", "Gg").replace("path", "dd").replace("add", "ee").replace("row", "hh")


def attributes(df):
    return df.withColumns({"tier": F.lit("public-web-unknown"), "jurisdiction": F.lit("GLOBAL"), "opted_out": F.lit(False)})


def test_no_scorer_means_no_certificate(spark):
    rows = attributes(spark.createDataFrame([(1, "AUDIO", "x"), (2, "UNSUPPORTED", "x"), (3, "IMAGE", None), (4, "TEXT", "some words here"), (5, "VIDEO", None)], "asset_id long, track string, text string"))
    works = spark.createDataFrame([(7, WORK)], "item_id long, text string")
    got = {r.asset_id: r for r in evaluation.evaluate(rows, {"TEXT": works, "IMAGE": spark.createDataFrame([], "item_id long, phash long")}).collect()}
    assert {i: got[i].outcome for i in got} == {1: "HUMAN_REVIEW", 2: "ERROR", 3: "HUMAN_REVIEW", 4: "PASSED", 5: "HUMAN_REVIEW"}
    assert all((got[i].certificate_id is None) == (i != 4) and got[i].compared == (i == 4) for i in got)


def test_tracks_have_their_own_index(spark):
    rows = attributes(spark.createDataFrame([(1, "CODE", RENAMED, None, None, None), (2, "IMAGE", None, None, 0b1011, None), (3, "IMAGE", None, None, -1, None), (4, "AUDIO", None, b"RIFF" + bytes(range(256)) * 40, None, None), (5, "VIDEO", None, None, None, [-1, 0b1010]), (6, "TEXT", CODE, None, None, None)], "asset_id long, track string, text string, content binary, phash long, frames array<long>"))
    index = {
        "CODE": spark.createDataFrame([("gpl.py", CODE)], "item_id string, text string"), "TEXT": spark.createDataFrame([(7, WORK)], "item_id long, text string"),
        "IMAGE": spark.createDataFrame([("pic", 0b1010)], "item_id string, phash long"), "VIDEO": spark.createDataFrame([("pic", 0b1010)], "item_id string, phash long"),
        "AUDIO": spark.createDataFrame([("song", b"RIFF" + bytes(range(256)) * 40)], "item_id string, content binary"),
    }
    got = {r.asset_id: (r.matched, r.outcome) for r in evaluation.evaluate(rows, index).collect()}
    assert got == {1: ("gpl.py", "BLOCKED"), 2: ("pic", "BLOCKED"), 3: (None, "PASSED"), 4: ("song", "BLOCKED"), 5: ("pic", "BLOCKED"), 6: (None, "PASSED")}


def test_earlier_decisions_are_kept(spark):
    rows = attributes(spark.createDataFrame(ROWS, "asset_id long, text string").withColumn("track", F.lit("TEXT")))
    works = spark.createDataFrame([(7, WORK)], "item_id long, text string")
    first = evaluation.evaluate(rows, works)
    state = first.filter("asset_id in (1, 2)").select("asset_hash", "track", F.when(F.col("asset_id") == 1, "PASSED").otherwise("BLOCKED").alias("status"), F.lit("old").alias("matched_source"))
    got = {r.asset_id: r for r in evaluation.evaluate(rows, works, state=state).collect()}
    assert [(got[i].outcome, got[i].matched, got[i].is_duplicate) for i in (1, 2, 3)] == [("PASSED", None, True), ("BLOCKED", "old", True), ("BLOCKED", "old", True)]
    assert got[1].certificate_id and got[4].outcome == "PASSED" and not got[4].is_duplicate


def test_sequence_ratio_counts(spark):
    """Words of one or two letters: no token score, but the text is the work."""
    work = "so we go on as if it is up to us to do it or to be in it " * 6 + "ancient"
    rows = attributes(spark.createDataFrame([(1, work.replace("ancient", "new")[10:])], "asset_id long, text string").withColumn("track", F.lit("TEXT")))
    got = evaluation.evaluate(rows, spark.createDataFrame([(7, work)], "item_id long, text string")).first()
    assert (got.outcome, got.matched) == ("BLOCKED", "7") and got.score > 0.9


def png(pixels):
    import struct
    import zlib

    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("blocked", [True, False])
def test_command_line_by_track(spark, tmp_path, blocked):
    import numpy as np

    r = np.random.default_rng(3)
    smooth = lambda seed: np.kron(np.random.default_rng(seed).integers(0, 255, (8, 8, 3), np.uint8), np.ones((8, 8, 1), np.uint8))
    wav = b"RIFF" + r.bytes(4) + b"WAVE" + r.bytes(9000)
    index, data = tmp_path / "index", tmp_path / "data"
    index.mkdir()
    data.mkdir()
    (index / "w.txt").write_text(WORK)
    (index / "gpl.py").write_text("# GNU General Public License" + CODE)
    (index / "pic.png").write_bytes(png(smooth(1)))
    (index / "song.wav").write_bytes(wav)
    (data / "fine.txt").write_text(ROWS[1][1])
    (data / "other.png").write_bytes(png(smooth(9)))
    (data / "v.mp4").write_bytes(b"\0\0\0\x18ftypmp42" + r.bytes(100))
    copies = {"x.py": ("# mine" + RENAMED).encode(), "p.png": png(np.clip(smooth(1).astype(int) + 3, 0, 255).astype(np.uint8)), "s.wav": wav}
    for name, content in copies.items() if blocked else ():
        (data / name).write_bytes(content)
    assert cli.main(["scan", str(data), "--index", str(index), "--out", str(tmp_path / "out")], spark) == (2 if blocked else 0)
    got = {row.asset_id.rpartition("/")[2]: row.outcome for row in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"fine.txt": "PASSED", "other.png": "PASSED", "v.mp4": "HUMAN_REVIEW"} | (dict.fromkeys(copies, "BLOCKED") if blocked else {})
