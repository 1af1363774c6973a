"""Components and leaders against plain loops; leaders of long chains in few passes."""

import random

import pytest

from clearloom.operators import dedup, graph


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def by_hand(edges):
    nodes = sorted({x for e in edges for x in e})
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    earlier, lead = {}, {}
    for a, b in edges:
        earlier.setdefault(max(a, b), []).append(min(a, b))
    for n in nodes:
        lead[n] = not any(lead[m] for m in earlier.get(n, []))
    return {n: find(n) for n in nodes}, lead


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice([8, 60, 300])
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(int(n * r.choice([0.4, 1, 3])))}
    df = spark.createDataFrame(sorted(edges), "_a long, _b long")
    want_components, want_leaders = by_hand(edges)
    assert {x.node: x.component for x in graph.components(df).collect()} == want_components
    got = [tuple(x) for x in graph.leaders(df).collect()]
    assert dict(got) == want_leaders and len(got) == len(want_leaders)


def test_no_edges(spark):
    df = spark.createDataFrame([], "_a string, _b string")
    assert graph.components(df).count() == 0 and graph.leaders(df).count() == 0


def test_leaders_of_a_chain_of_ten_thousand(spark, monkeypatch):
    """Each hash is three bits from the next: every second row leads. Far fewer passes than rows."""
    r, h, rows = random.Random(1), 0, []
    for i in range(10_000):
        rows.append((i, str(i), h - (1 << 64) if h >> 63 else h))
        while True:
            bits = sum(1 << x for x in r.sample(range(64), 3))
            if all(bin((h ^ bits) ^ (o % (1 << 64))).count("1") > 3 for _, _, o in rows[-6:-1]) and h ^ bits:
                break
        h ^= bits
    rows[0] = (0, "0", rows[0][2] or 0)
    plain = [x for _, _, x in rows]
    lead = {}
    buckets = {}
    for i, x in enumerate(plain):
        near = [j for k in range(4) for j in buckets.get((k, x >> 16 * k & 0xFFFF), []) if bin((plain[j] ^ x) % (1 << 64)).count("1") <= 3 and plain[j] and x]
        found = sorted(j for j in near if lead[j] == j)
        lead[i] = found[0] if found else i
        for k in range(4):
            buckets.setdefault((k, x >> 16 * k & 0xFFFF), []).append(i)
    passes = []
    inner = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: passes.append(1) or inner(self, *a))
    got = {x.id: x.leader for x in dedup.elect_leaders(spark.createDataFrame(rows, "id long, h string, s long"), "id", "h", "s").collect()}
    assert got == lead and len(passes) < 60


def test_numbers_over_partitions(spark):
    from pyspark.sql import functions as F

    from clearloom.operators import governance
    from clearloom.operators.numbering import numbered

    rows = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, (F.col("id") * 37) % 101)).repartition(9)
    got = numbered(rows, "place", F.asc_nulls_first("x"), F.desc("id")).collect()
    want = sorted(((r.x is not None, r.x or 0, -r.id), r.id) for r in rows.collect())
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [i for _, i in want] and sorted(r.place for r in got) == list(range(1, 1001))
    assert numbered(rows.limit(0), "place", "id").count() == 0
    old, new = spark.createDataFrame([("n1", 4)], "notice_id string, index_version long"), spark.createDataFrame([("n9",), ("n3",)], "notice_id string")
    assert {r.notice_id: r.index_version for r in governance.submit_takedowns(old, new).collect()} == {"n1": 4, "n3": 5, "n9": 6}
