"""Versions with several writers: one of two stores of a hash fails, and readers see whole versions."""

import threading

import pytest

from clearloom.operators import commits, sinks, vector

RECORD = "asset_hash string, note string"


def together(*works):
    """Runs them at once; what each returned or raised."""
    gate, out = threading.Barrier(len(works)), [None] * len(works)

    def run(i, work):
        gate.wait()
        try:
            out[i] = work()
        except Exception as e:
            out[i] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(works)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_two_stores_of_one_hash(spark, tmp_path):
    locker = sinks.EvidenceLocker(str(tmp_path / "locker"))
    for k in range(3):
        one = spark.createDataFrame([(f"sha256:aa{k}", "one"), (f"sha256:bb{k}", "one")], RECORD)
        two = spark.createDataFrame([(f"sha256:aa{k}", "two"), (f"sha256:cc{k}", "two")], RECORD)
        got = together(lambda one=one: locker.store(one), lambda two=two: locker.store(two))
        assert sorted(type(x) for x in got if isinstance(x, Exception)) == [FileExistsError] and sum(isinstance(x, int) for x in got) == 1
        won = "one" if isinstance(got[0], int) else "two"
        assert [r.note for r in locker.retrieve(spark, f"sha256:aa{k}").collect()] == [won]
    assert locker.read(spark).count() == 6
    with pytest.raises(FileExistsError):
        locker.store(spark.createDataFrame([("x", "1"), ("x", "2")], RECORD))
    assert len(list((tmp_path / "locker" / "data").iterdir())) == 3  # the losers' data are gone


def test_writers_of_different_hashes_all_pass(spark, tmp_path):
    locker = sinks.EvidenceLocker(str(tmp_path / "locker"))
    got = together(*(lambda i=i: locker.store(spark.createDataFrame([(f"h{i}", "n")], RECORD)) for i in range(5)))
    assert sorted(got) == [1, 2, 3, 4, 5] and {r.asset_hash for r in locker.read(spark).collect()} == {f"h{i}" for i in range(5)}


def test_readers_see_whole_versions(spark, tmp_path):
    path, stop, seen = str(tmp_path / "index"), threading.Event(), []
    make = lambda k: spark.range(200).selectExpr("id AS vec_id", f"{k} AS k")
    vector.save(make(0), path)

    def reader():
        while not stop.is_set():
            seen.append([tuple(r) for r in vector.load(spark, path).groupBy("k").count().collect()])

    t = threading.Thread(target=reader)
    t.start()
    for k in range(1, 6):
        assert vector.save(make(k), path) == k + 1
    stop.set()
    t.join()
    assert seen and all(len(x) == 1 and x[0][1] == 200 for x in seen)
    assert vector.load(spark, path, 2).first().k == 1 and vector.load(spark, path).first().k == 5


def test_upserts_of_several_writers(spark, tmp_path):
    table = commits.Versions(spark, str(tmp_path / "t"))
    assert table.read() is None and commits.current(table, "url") is None and table.number() == 0
    rows = lambda *x: spark.createDataFrame(x, "url string, etag string")
    assert commits.upsert(table, rows(("a", "1"), ("b", "1"))) == 1
    got = together(lambda: commits.upsert(table, rows(("b", "2"), ("c", "2"))), lambda: commits.upsert(table, rows(("b", "3"), ("d", "3"))))
    assert sorted(got) == [2, 3]
    last = "2" if got[0] == 3 else "3"
    want = {"a": "1", "b": last, "c": "2", "d": "3"}
    assert {r.url: r.etag for r in commits.current(table, "url").collect()} == want
    assert {r.url for r in commits.current(table, "url", 1).collect()} == {"a", "b"}
    assert table.compact("url") == 4
    assert sorted((r.url, r.etag) for r in commits.current(table, "url").collect()) == sorted(want.items()) and table.read().count() == 4


def test_replacement_of_a_stale_version(spark, tmp_path):
    table = commits.Versions(spark, str(tmp_path / "t"))
    one = spark.range(3)
    table.commit(one)
    base = table.number()
    table.commit(one)
    with pytest.raises(commits.Conflict):
        table.commit(one, replace=True, based_on=base)
    assert table.vacuum(0) == 0 and table.read().count() == 6


def test_leftovers_are_not_read(spark, tmp_path):
    table = commits.Versions(spark, str(tmp_path / "t"))
    table.commit(spark.range(3))
    spark.range(50).write.parquet(str(tmp_path / "t" / "data" / "dead"))
    assert table.read().count() == 3 and table.vacuum(-1000) == 1 and table.read().count() == 3
