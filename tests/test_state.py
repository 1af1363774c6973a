"""Streams with kept state against plain loops, in one run and over restarts."""

import random

import pytest
from pyspark.sql import functions as F

from clearloom.streaming import state

ASSETS = "asset_id string, seq long, track string, asset_hash string, simhash long, status string, matched_source string"


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))


def assets(seed, n):
    r, out, hashes = random.Random(seed), [], []
    for i in range(n):
        x = r.choice(hashes) if hashes and r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.randrange(4)):
            x ^= 1 << r.randrange(64)
        hashes.append(x)
        track = r.choice(["TEXT", "TEXT", "CODE", "IMAGE", "AUDIO", "VIDEO"])
        digest = r.choice(out)[3] if out and r.random() < 0.2 else f"h{i}"
        known = next((o for o in out if o[3] == digest and o[2] == track), None)
        x = known[4] if known else 0 if r.random() < 0.05 else x - (1 << 64) if x >> 63 else x
        out.append((f"a{i}", i, track, digest, x, r.choice(["PASSED", "PASSED", "BLOCKED", "HUMAN_REVIEW", "ERROR"]), r.choice([None, "src"])))
    return out


def gate(rows, most=3):
    leaders, out = [], {}
    for a in sorted(rows, key=lambda a: a[1]):
        same = [k for k in leaders if k[2] == a[2] and k[3] == a[3]]
        near = [k for k in leaders if k[2] == a[2] in ("TEXT", "CODE", "IMAGE") and a[4] and k[4] and bin((k[4] ^ a[4]) % (1 << 64)).count("1") <= most]
        if hit := (same or near):
            out[a[0]] = (hit[0][0], True, hit[0][5], hit[0][6])
            continue
        out[a[0]] = (a[0], False, a[5], a[6])
        if a[5] in ("PASSED", "BLOCKED") and a[2] in ("TEXT", "IMAGE", "CODE"):
            leaders.append(a)
    return out, {k[0] for k in leaders}


def test_dedup_gate_over_restarts(spark, tmp_path):
    rows, source = assets(7, 90), str(tmp_path / "in")
    read = lambda: spark.readStream.schema(ASSETS).option("maxFilesPerTrigger", 1).parquet(source)
    decided = lambda f: {r.asset_id: (r.leader, r.is_duplicate, r.status, r.matched_source) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{f}/decisions").collect()}
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, ASSETS).coalesce(1).write.mode("append").parquet(source)
        state.dedup_gate(read(), str(tmp_path / "restarted")).awaitTermination()
    want, leaders = gate(rows)
    assert decided(tmp_path / "restarted") == want
    recorded = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "restarted" / "leaders")).collect()
    assert {r.asset_id for r in recorded} == leaders and len(recorded) == len(leaders)
    assert all(r.track in ("TEXT", "IMAGE", "CODE") and r.status in ("PASSED", "BLOCKED") for r in recorded)
    state.dedup_gate(read(), str(tmp_path / "once")).awaitTermination()
    assert decided(tmp_path / "once") == want


def test_batches_answer_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "batch_key string, submission string, asset_id string, verdict string").coalesce(1).write.mode("append").parquet(source)

    def run():
        rows = spark.readStream.schema("batch_key string, submission string, asset_id string, verdict string").parquet(source)
        state.idempotent_batches(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    put([("b1", "s1", "x", "PASSED"), ("b1", "s1", "y", "BLOCKED"), ("b1", "s2", "x", "REVIEW"), ("b2", "s1", "z", "REVIEW")])
    run()
    put([("b1", "s3", "other", "PASSED"), ("b3", "s1", "q", "PASSED")])
    run()
    got = {(r.batch_key, r.submission): (r.total_assets, r.passed_count, r.blocked_count, r.review_count, r.idempotent_cached, r.results) for r in spark.read.parquet(out).collect()}
    assert got == {("b1", "s1"): (2, 1, 1, 0, False, "x=PASSED,y=BLOCKED"), ("b1", "s2"): (2, 1, 1, 0, True, "x=PASSED,y=BLOCKED"), ("b1", "s3"): (2, 1, 1, 0, True, "x=PASSED,y=BLOCKED"), ("b2", "s1"): (1, 0, 0, 1, False, "z=REVIEW"), ("b3", "s1"): (1, 1, 0, 0, False, "q=PASSED")}


EVENTS = "queue string, seq long, kind string, item_id string, priority long"


def queue_by_hand(batches, most, retries, step):
    waiting, out, place, log = [], {}, 0, []
    for events in batches:
        now = []
        for _, kind, item, priority in sorted(events):
            if kind == "enqueue":
                place += 1
                waiting.append((priority, place, item, 0))
            elif item in out and kind != "tick":
                p, failures = out.pop(item)
                if kind == "failed" and failures + 1 > retries:
                    now.append((item, "dead", p, failures + 1))
                elif kind == "failed":
                    place += 1
                    waiting.append((p + step, place, item, failures + 1))
        waiting.sort()
        for p, _, item, failures in waiting[:most]:
            out[item] = p, failures
            now.append((item, "released", p, failures))
        del waiting[:most]
        log.append(now)
    return log


def test_priority_queue_over_restarts(spark, tmp_path):
    r, seq, batches = random.Random(3), 0, []
    waiting = [f"i{k}" for k in range(24)]
    log = []
    for k in range(9):
        events = []
        for item in waiting[3 * k : 3 * k + 3] if k < 8 else []:
            seq += 1
            events.append((seq, "enqueue", item, r.choice([1, 5, 5, 10])))
        for item, event, *_ in log[-1] if log else []:
            if event == "released":
                seq += 1
                events.append((seq, r.choice(["failed", "failed", "failed", "done"]), item, 0))
        seq += 1
        events.append((seq, "tick", "", 0))
        batches.append(events)
        log = queue_by_hand(batches, 4, 1, 5)
    source, got = str(tmp_path / "in"), []
    for k, events in enumerate(batches):
        spark.createDataFrame([("q", *e) for e in events], EVENTS).coalesce(1).write.mode("append").parquet(source)
        if k in (3, 8):  # two runs
            rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
            q = state.priority_queue(rows, 4, 1, 5).writeStream.foreachBatch(lambda b, n: got.append((n, [tuple(x)[1:] for x in b.collect()]))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
            q.start().awaitTermination()
    assert [rows for _, rows in sorted(got) if rows] == [x for x in log if x] and any(e == "dead" for x in log for _, e, *_ in x)


def test_rate_limit_by_domain(spark, tmp_path):
    r = random.Random(5)
    rows = [("hot.org" if r.random() < 0.7 else f"d{r.randrange(4)}.org", f"u{i}", r.randrange(4000)) for i in range(200)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, "domain string, url string, due_ms long").write.mode("append").parquet(source)
        due = spark.readStream.schema("domain string, url string, due_ms long").parquet(source)
        state.rate_limited(due, 3, 1000).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.select("url").distinct().count() == 200
    assert got.groupBy("domain", F.floor(F.col("fetch_ms") / 1000)).count().agg(F.max("count")).first()[0] == 3
    assert got.filter(F.floor(F.col("due_ms") / 1000) * 1000 > F.col("fetch_ms")).count() == 0
    hot = sum(d == "hot.org" for d, *_ in rows)
    assert got.filter("domain = 'hot.org'").select(F.max("fetch_ms")).first()[0] >= (hot / 3 - 1) * 1000
