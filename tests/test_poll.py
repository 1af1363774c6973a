"""The poll loop against its definition: few of a domain in a trigger, all in time, across a restart."""

import datetime
import time

from pyspark.sql import functions as F

from clearloom.operators import commits
from clearloom.streaming import poll


def registry(spark, path):
    rows = [(f"h{i:02}", f"https://hot.org/{i}", True, None) for i in range(8)] + [("a", "https://a.org/x", True, None), ("b", "https://b.org/x", False, None), ("c", "https://c.org/x", True, None)]
    r = commits.Versions(spark, path)
    r.commit(spark.createDataFrame(rows, poll.SOURCE))
    return r


def test_triggers(spark, tmp_path):
    r, out, fetched = registry(spark, str(tmp_path / "r")), str(tmp_path / "out"), []
    fetch = lambda rows: rows.filter("source_id <> 'c'").select("source_id", F.upper("url").alias("content"))
    for n in range(4):
        assert poll.poll_once(r, fetch, out, n, datetime.datetime(2026, 1, 1, n)) == 4
        fetched.append(sorted(x.source_id for x in spark.read.parquet(f"{out}/batch={n}").collect()))
    assert fetched == [["a", "h00", "h01", "h02"], ["a", "h03", "h04", "h05"], ["a", "h00", "h06", "h07"], ["a", "h01", "h02", "h03"]]
    at = {x.source_id: x.last_crawled_at and x.last_crawled_at.hour for x in commits.current(r, "source_id").collect()}
    assert at == {"a": 3, "b": None, "c": None, "h00": 2, "h01": 3, "h02": 3, "h03": 3, "h04": 1, "h05": 1, "h06": 2, "h07": 2}
    assert poll.poll_once(commits.Versions(spark, str(tmp_path / "none")), fetch, out, 9, None) == 0


def test_loop_goes_on_after_a_restart(spark, tmp_path):
    registry(spark, str(tmp_path / "r"))
    fetch = lambda rows: rows.select("source_id")
    done = lambda: {x.source_id for x in spark.read.schema("source_id string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
    for want in (4, 10):
        q = poll.poll(spark, str(tmp_path / "r"), fetch, str(tmp_path / "out"), str(tmp_path / "ck"), "1 second")
        for _ in range(90):
            if len(done()) >= want:
                break
            time.sleep(1)
        q.stop()
        assert q.exception() is None and len(done()) >= want
    assert done() == {"a", "c", *(f"h{i:02}" for i in range(8))}
