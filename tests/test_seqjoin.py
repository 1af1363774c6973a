"""The ratio join and what stands on it against difflib over all pairs."""

import difflib
import hashlib
import random
import re

import pytest

from clearloom.functions import fingerprint as fp
from clearloom.operators import seqjoin, simjoin

ALPHABETS = ["ab", "etaoin shr", "etaoinshrdlucmfwypvbgkqjxz .,TEé"]


def text(r, n, abc):
    return "".join(r.choice(abc) for _ in range(n))


def edited(r, t, share, abc):
    out = []
    for c in t:
        x = r.random()
        if x < share / 3:
            continue
        out.append(r.choice(abc) if x < 2 * share / 3 else c)
        if x > 1 - share / 3:
            out.append(r.choice(abc))
    return "".join(out)


def corpus(seed):
    r = random.Random(seed)
    refs = {text(r, n, a) for a in ALPHABETS for n in (1, 5, 30, 80, 190, 200, 230, 400, 900)} | {"the same start of it " * 12, "aaaaabbbbb" * 25}
    refs = sorted(refs)
    asked = {edited(r, y, p, r.choice(ALPHABETS)) for y in refs for p in (0, 0.05, 0.2, 0.4, 0.6)} | {text(r, n, a) for a in ALPHABETS for n in (1, 3, 40, 150, 300, 500)}
    asked |= {y[: len(y) // 2] for y in refs} | {y + text(r, len(y) // 2, ALPHABETS[2]) for y in refs} | {y[len(y) // 3 :] + y[: len(y) // 3] for y in refs}
    return sorted(asked - {""}), refs


@pytest.mark.parametrize("least,seed,most_keys", [(0.4, 1, 2_000_000), (0.55, 2, 0), (0.75, 3, 2_000_000), (0.9, 4, 2_000_000), (1.0, 5, 2_000_000)])
def test_all_pairs(spark, least, seed, most_keys, monkeypatch):
    monkeypatch.setattr(seqjoin, "MOST_KEYS", most_keys)
    asked, refs = corpus(seed)
    left = spark.createDataFrame([(q,) for q in [*asked, *asked[:5], None, ""]], "l_text string").repartition(3)
    right = spark.createDataFrame([(y,) for y in [*refs, refs[0], None, ""]], "r_text string")
    want, sha = {}, lambda s: hashlib.sha256(s.encode()).hexdigest()
    for y in refs:
        m = difflib.SequenceMatcher(None, "", y.lower())
        for q in asked:
            m.set_seq1(q.lower())
            if (v := m.ratio()) >= least:
                want[sha(q), sha(y)] = v
    rows = seqjoin.ratio_pairs(left, right, least).collect()
    assert {(x.l_id, x.r_id): x.ratio for x in rows} == want and len(rows) == len(want) > 20


def test_nothing_to_join(spark):
    none = spark.createDataFrame([], "l_text string, r_text string")
    some = spark.createDataFrame([("abc", "abc")], "l_text string, r_text string")
    assert seqjoin.ratio_pairs(none, some, 0.5).count() == seqjoin.ratio_pairs(some, none, 0.5).count() == 0


def test_pairs_need_more_than_lengths(spark):
    """Long texts of one length and one language share no key."""
    r = random.Random(8)
    words = [text(r, r.randrange(2, 9), "etaoinshrdlu") for _ in range(4000)]
    prose = lambda: ". ".join(" ".join(r.choice(words) for _ in range(12)).capitalize() for _ in range(8))
    texts = [prose() for _ in range(60)]
    keys = [{int(k) for _, _, ks in seqjoin.index_keys(t.lower(), 0.75, {}) for k in ks} for t in texts[:30]]
    sizes = {b: [16, 8, 4] for b in range(60)}
    asked = [{int(k) for ks in seqjoin.query_keys(t.lower(), 0.75, {}, sizes) for k in ks} for t in texts[30:]]
    assert sum(bool(a & b) for a in asked for b in keys) < 0.5 * 900


CODE = [
    "def add(a, b):\n    return a + b\n", "def plus(x, y):\n    return x + y\n", "class A:\n    def f(self):\n        for i in range(3):\n            print(i)\n",
    "int main() { return 0; }", "int other(void) { return 1; }", "import os\nimport sys\n\ndef walk(top):\n    for root, dirs, files in os.walk(top):\n        for name in files:\n            yield os.path.join(root, name)\n",
    "def walk(top):\n    for root, dirs, files in os.walk(top):\n        pass\n", "x = 1", "  ", "", None, "def broken(:\n  token alpha beta gamma", "broken token alpha beta gamma delta",
]


@pytest.mark.parametrize("least", [0.4, 0.6])
def test_code_against_all_pairs(spark, least):
    got = {(r.doc_id, r.item_id): (r.score, r.stage) for r in simjoin.code_match(spark.createDataFrame(list(enumerate(CODE)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(CODE)), "item_id int, text string"), least).collect()}
    want, words = {}, lambda c: set(re.findall(r"\w{2,}", c.lower()))
    for i, q in enumerate(CODE):
        for j, y in enumerate(CODE):
            if not (q and q.strip() and y):
                continue
            if not (a := fp.code_structure(q)) or not (b := fp.code_structure(y)):
                continue
            r, s, t = difflib.SequenceMatcher(None, a, b).ratio(), words(q), words(y)
            score = max(r, 0.7 * r + 0.3 * len(s & t) / max(len(s | t), 1))
            if len(s & t) / max(len(s), 1) >= 0.8:
                score = max(score, 0.75 + 0.12 * r)
            if score > least:
                want[i, j] = (pytest.approx(score, abs=6e-5), "ast_structure" if r > 0.85 else "token_overlap")
    assert got == want


def test_renamed_and_excerpted_code(spark):
    whole = CODE[5]
    renamed = re.sub(r"\b(walk|top|root|dirs|files|name)\b", lambda m: {"walk": "zz", "top": "t1", "root": "r1", "dirs": "d1", "files": "f1", "name": "n1"}[m.group()], whole.replace("os", "qq").replace("sys", "ww"))
    part = "for root, dirs, files in os.walk(top):\n    pass"
    got = {r.doc_id: r for r in simjoin.code_match(spark.createDataFrame([(1, renamed), (2, part)], "doc_id int, text string"), spark.createDataFrame([(9, whole)], "item_id int, text string")).collect()}
    assert got[1].score == 1.0 and got[1].stage == "ast_structure" and got[2].score >= 0.75


def test_audio_against_all_pairs(spark):
    r = random.Random(2)
    songs = [r.randbytes(n) for n in (500, 5000, 5000, 40_000, 70_000)]
    asked = [songs[1], songs[3][:30_000], songs[4] + b"x", r.randbytes(9000), b"z"]
    prints = {}
    for name, rows in (("l", asked), ("r", songs)):
        df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(rows)], "i int, c binary")
        prints[name] = {x.i: x.f for x in df.select("i", fp.acoustic_fingerprint(df.c).alias("f")).collect()}
    want = {}
    for i, q in enumerate(asked):
        for j, y in enumerate(songs):
            a, b = prints["l"][i], prints["r"][j]
            s = 1.0 if a == b else 0.7 * difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * min(len(q), len(y)) / max(len(q), len(y))
            if s > 0.5:
                want[i, j] = pytest.approx(s, abs=6e-5)
    got = simjoin.audio_match(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(asked)], "doc_id int, content binary"), spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(songs)], "item_id int, content binary"))
    assert {(x.doc_id, x.item_id): x.score for x in got.collect()} == want
