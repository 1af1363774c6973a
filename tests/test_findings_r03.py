"""Cases of the findings of round 3."""

import base64
import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearloom.operators import governance, provenance, simjoin, vector


def test_top_k_in_tiles(spark):
    """Scores equal to 10 digits are ties in a block too; tiles of queries change nothing."""
    close = spark.createDataFrame([(1, [1.0, 6e-6]), (2, [1.0, 0.0])], "vec_id long, e array<double>")
    got = vector.top_k(close, close.filter("vec_id = 2").withColumnRenamed("vec_id", "q"), "vec_id", "q", "e", 1)
    assert [(r.q, r.vec_id) for r in got.collect()] == [(2, 1)]
    m = np.random.default_rng(5).normal(size=(60, 4))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, e array<double>")
    got = {(r.q, r["rank"]): r.vec_id for r in vector.top_k(v, v.withColumnRenamed("vec_id", "q"), "vec_id", "q", "e", 3, block=16, tile=7).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit.T), 1)[:, :3]
    assert got == {(i, k + 1): want[i, k] for i in range(60) for k in range(3)}


def test_signals_of_copies_meet_once(spark):
    """Copies are one class: what is joined doesn't grow with the square of their number. Ties go to the smaller work_id."""
    sets = {i: ["a", "b", "c"] for i in range(200)} | {500: ["a", "b", "c", "d"], 501: ["a", "x", "y"], 502: ["c", "d", "b", "a", "e"], 503: None}
    signals = spark.createDataFrame([(k, v) for k, v in sets.items() if k not in (501, 502)], "work_id long, lsh_fingerprints array<string>")
    queries = spark.createDataFrame(list(sets.items()), "query_id long, sig array<string>")
    found = governance.match_signals(queries, signals)
    got = {r.query_id: (r.work_id, round(r.jaccard, 6)) for r in found.collect()}
    assert got == {i: (0, 1.0) for i in range(200)} | {500: (500, 1.0), 502: (500, 0.8)}
    found = governance.match_signals(queries.filter("query_id < 501"), signals)
    assert found.count() == 201 and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_set_jaccard_is_whole(spark):
    rng = np.random.default_rng(1)
    sets = [sorted({str(x) for x in rng.zipf(1.4, 12) if x < 40}) for _ in range(80)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets) if s], "i long, s array<string>")
    got = {(r.i, r.j): round(r.jaccard, 9) for r in simjoin.set_jaccard(df, df.select(F.col("i").alias("j"), F.col("s").alias("z")), "i", "j", "s", "z", 0.6).collect()}
    j = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    assert got == {(a, b): round(j(sets[a], sets[b]), 9) for a in range(80) for b in range(80) if sets[a] and sets[b] and j(sets[a], sets[b]) >= 0.6}


def test_signing_by_primes(spark, monkeypatch):
    """Two powers of half the size give the same signature as the whole one, which isn't worked out."""
    signer = provenance.Signer(spark, bits=1024)
    n, e, d = signer.numbers()
    whole = provenance.pss_sign(b"x", n, d)
    asked = []
    monkeypatch.setattr(provenance, "pow", lambda *a: asked.append(a[2]) or pow(*a), raising=False)
    assert provenance.pss_sign(b"x", n, d, provenance._integers(signer.private)[3:8]) == whole and n not in asked
    assert provenance.pss_verify(b"x", base64.b64encode(whole).decode(), n, e)


def test_hashes_alike_in_one_band(spark, monkeypatch):
    """Hashes that share 16 bits, and are far apart, don't all meet; pairs near each other do."""
    rng = np.random.default_rng(2)
    h = [int(x) << 16 | 0xBEEF for x in rng.integers(0, 1 << 47, 300)]
    h += [h[0] ^ 7 << 20, h[1] ^ (1 << 3 | 1 << 30 | 1 << 61), h[2] ^ 15 << 20]
    df = spark.createDataFrame(list(enumerate(h)), "i long, h long")
    got = {(r.i, r.j): r.dist for r in simjoin.hamming_join(df, df.select(F.col("i").alias("j"), F.col("h").alias("g")), "i", "j", "h", "g", 3).collect()}
    near = lambda a, b: bin((h[a] ^ h[b]) & (1 << 64) - 1).count("1")
    assert got == {(a, b): near(a, b) for a in range(len(h)) for b in range(len(h)) if near(a, b) <= 3} and (0, 300) in got and (1, 301) in got and (2, 302) not in got
    monkeypatch.setattr(simjoin.fp, "hamming", lambda a, b: F.lit(0))  # so all that meet are counted
    assert simjoin.hamming_join(df, df.select(F.col("i").alias("j"), F.col("h").alias("g")), "i", "j", "h", "g", 3).count() < 1000


def test_code_of_a_kind_is_compared_once(spark, monkeypatch):
    """Texts that differ in names that no indexed code has are one kind; the best of each is chosen before they are told apart."""
    form = "def {0}_f({0}_a):\n    return {0}_a + {1}\n"
    code = spark.createDataFrame([(i, form.format(f"v{i}", "total" if i % 2 else "1")) for i in range(40)] + [(90, "???"), (91, "def shared_name(x):\n    pass")], "doc_id long, text string")
    index = spark.createDataFrame([(7, form.format("w", "total")), (3, form.format("u", "total")), (8, "def shared_name(y):\n    pass")], "item_id long, text string")
    every = simjoin.code_match(code, index)
    seen = []
    real = simjoin.seqjoin.ratio_pairs
    monkeypatch.setattr(simjoin.seqjoin, "ratio_pairs", lambda a, *rest, **k: seen.append(a.count()) or real(a, *rest, **k))
    best = {r.doc_id: (r.item_id, r.score, r.stage) for r in simjoin.code_match(code, index, best=1).collect()}
    want = {r.doc_id: (r.item_id, r.score, r.stage) for r in simjoin.top_k(every, "doc_id", "score", "item_id", 1).collect()}
    assert best == want and best[1][0] == best[5][0] == 3 and best[91][0] == 8 and seen == [4]


def test_words_are_counted_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Texts against a small index: no join makes a row for each shared word, and the scores are those of the join; repeated ids count together as there."""
    words = ["common", "often", *(f"word{i}" for i in range(40))]
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(words, k=30))) for i in range(60)] + [(60, None), (61, ""), (62, "nothing known"), (5, " ".join(words[:20])), (None, "common often word1 word2")]
    works = spark.createDataFrame([(i, " ".join(r.sample(words, 8))) for i in range(20)] + [(90, None), (91, ""), (3, "common word7 word9")], "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = lambda rows: sorted((r.doc_id or -1, r.item_id, r.containment, r.jaccard, r.score) for r in rows.collect())
    single = docs.filter("doc_id is null or doc_id <> 5")
    plan = simjoin.text_scores(single, works)._jdf.queryExecution().executedPlan().toString()
    mine, few = got(simjoin.text_scores(docs, works)), got(simjoin.text_scores(docs, works, 0.8))
    monkeypatch.setattr(simjoin, "TOGETHER", 50)
    assert got(simjoin.text_scores(docs, works)) == mine
    none = simjoin.text_scores(docs, works.limit(0)).count()
    monkeypatch.setattr(simjoin, "is_small", lambda *a: False)
    assert mine == got(simjoin.text_scores(docs, works)) and len(mine) > 100 and few == [x for x in mine if x[4] > 0.8] and none == 0
    assert "Join" not in plan


@pytest.mark.parametrize("n", [190, 260])
def test_bounds_come_before_the_ratio(n, monkeypatch):
    """Texts that share a window but little else are told apart without difflib's blocks; those near or above the least ratio get difflib's own."""
    r = random.Random(n)
    prose = lambda k: "".join(r.choice("eeeetttaaooiinnsshhrrdlu  ") for _ in range(k))
    refs = [prose(n) + "qz" + prose(5) for _ in range(30)]
    asked = [y[: n // 8] + prose(n) for y in refs] + [y[:k] + prose(n - k) for y in refs[:6] for k in (n // 4, n // 3, n // 2, n)]
    real, calls = difflib.SequenceMatcher.ratio, []
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or real(self))
    for least in (0.2, 0.55):
        calls.clear()
        for y in refs:
            m = difflib.SequenceMatcher(None, "", y)
            for q in asked:
                m.set_seq1(q)
                want = real(m)
                assert simjoin.seqjoin.ratio_from(m, q, y, least) == (want if want >= least else 0.0)
    assert 5 < len(calls) < len(refs) * len(asked) / 20
