"""The verdict source against the token query, spans, batches, staged assets and MIME dispatch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from clearloom.operators import decision
from clearloom.plans import catalogue
from clearloom.sources.verdicts import Verdicts
from clearloom.streaming.telemetry import Spans

DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def load(reader, path, **more):
    for k, v in {"path": path, "index": f"{DIR}/benchmark.parquet", **more}.items():
        reader = reader.option(k, v)
    return reader.load()


@tables
def test_verdicts_of_the_token_query(spark):
    spark.dataSource.register(Verdicts)
    got = load(spark.read.format("clearloom_verdicts"), f"{DIR}/documents.parquet")
    tier = catalogue.pick("doc_id", 3, ["licensed-partner", "public-web-unknown", "high-risk-domain"])
    status = decision.status_of_band(decision.band(F.col("score"), F.lit("TEXT"), tier))
    mine = {r.doc_id: (r.matched, r.score, r.status) for r in got.withColumn("status", status).collect()}
    want = {r.doc_id: (r.matched, r.score, r.status) for r in catalogue.text_clearance_token(spark, DIR).collect()}
    assert mine.keys() == want.keys() and all(mine[k][0::2] == want[k][0::2] and abs(mine[k][1] - want[k][1]) < 2e-4 for k in want)
    assert {v for *_, v in want.values()} > {"PASSED"}
    with pytest.raises(Exception, match="no scorer"):
        load(spark.read.format("clearloom_verdicts"), f"{DIR}/documents.parquet", scorer="none").count()


@tables
def test_verdict_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(Verdicts)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def put(part, name):
        docs.filter(F.col("doc_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / name))
        f = next(p for p in (tmp_path / name).iterdir() if p.suffix == ".parquet")
        f.rename(source / f"{name}.parquet")

    def run(want):
        rows = load(spark.readStream.format("clearloom_verdicts"), str(source), files=1)
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).start()
        for _ in range(120):
            q.processAllAvailable()
            if os.path.isdir(out) and spark.read.schema("doc_id long").parquet(out).count() >= want:
                break
            time.sleep(0.2)
        q.stop()

    put(0, "a")
    put(1, "b")
    run(docs.filter("doc_id % 3 < 2").count())
    put(2, "c")
    run(docs.count())
    got = spark.read.parquet(out)
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()


def test_spans_and_p95(spark, tmp_path):
    spans = Spans(spark, str(tmp_path / "spans"))
    for i in range(20):
        with spans.span("count", tier="x", i=i) as s:
            s.observe(spark.range(i)).count()
            time.sleep(0.05 if i == 19 else 0)
    with pytest.raises(ValueError), spans.span("broken"):
        raise ValueError
    spans.flush()
    listener = spans.listener()
    spark.streams.addListener(listener)
    spark.range(7).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("copied").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(50):
        if spans._rows:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    spans.flush()
    rows = spans.table().collect()
    mine = sorted((r for r in rows if r.name == "count"), key=lambda r: r.start_time)
    assert [r.rows for r in mine] == list(range(20)) and mine[3].attributes == {"tier": "x", "i": "3"} and not any(r.failed for r in mine)
    assert [(r.rows, r.failed) for r in rows if r.name == "broken"] == [(None, True)] and [(r.plane, r.rows) for r in rows if r.name == "copied"] == [("stream", 7)]
    got = {r.name: r for r in spans.p95().collect()}
    times = sorted(r.ms for r in mine)
    assert got["count"].n == 20 and got["count"].rows == 190 and times[17] <= got["count"].p95_ms <= times[19]
