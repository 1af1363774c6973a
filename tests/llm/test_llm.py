"""The operators against brute force on small fixtures: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clearloom.llm import byte_bpe, fingerprints, language_id, language_model, neighbours, ngram_join, packing, sharding, suffix_dedup, token_files
from clearloom.llm import tokens as tokens_module
from clearloom.llm.elias_fano import EliasFano

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus():
    base = words(120, 1)
    rows = [
        (0, None), (1, ""), (2, "one"), (3, "one two"), (4, base), (5, base), (6, base + " extra"), (7, words(90, 2) + " " + base[:450]), (8, base[:450] + " " + words(80, 3)),
        (9, "ab" * 900), (10, "a  b\n\n c. D!\té ü <|endoftext|>  "), (11, words(4000, 4)), (12, "!!! 123"), (13, words(60, 5) + ".\n" + words(50, 6) + "!"), (14, "x" * 399), (15, "y" * 401), (16, base.upper()),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of():
    return {i: t or "" for i, t, *_ in corpus()}


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))


def shingles(text, n):
    w = tokens(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_of(texts, n, percent):
    sets, parent = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (1000, 50), (1000, 10**6), (300, 10**12)):
        v = np.sort(r.integers(0, top, n))
        e, q = EliasFano.build(v), np.concatenate([r.integers(0, top + 5, 500), v])
        assert (e.all() == v).all() and (e.successor(q) == np.searchsorted(v, q)).all() and ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_language_model(spark, docs, empty):
    rows = docs.withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = language_model.scored(rows, language_model.learned(rows.filter(~F.col("held_out")))).collect()
    stream = {i: [*tokens(t), None] for i, t in text_of().items()}
    counts = Counter(w for i in stream if i % 7 != 2 for w in stream[i])
    total, size = sum(counts.values()), len(counts)
    for r in got:
        w = stream[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w), abs_tol=1e-6) and r.score <= 0
    none = language_model.learned(empty)
    assert all(math.isclose(r.score, language_model.UNTRAINED * r.n_tokens) for r in language_model.scored(rows, none).collect())
    assert language_model.scored(empty.withColumn("held_out", F.lit(True)), none).count() == 0


@pytest.mark.parametrize("n,percent,frequent", [(3, 90, 1000), (5, 80, 1)])
def test_ngram_join(docs, n, percent, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "TOP_COUNT", 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs, n, percent).collect()}
    assert got == components_of(text_of(), n, percent)


def test_ngram_join_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    base = words(100, 9, 5000).split()
    texts = {i: " ".join(base[:i] + [f"v{i}"] + base[i + 1 :]) for i in range(25)} | {100: words(100, 10, 5000)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90).collect()}
    assert got == components_of(texts, 3, 90)


@pytest.mark.parametrize("few,frequent,long", [(8, 1000, 200), (0.2, 3, 200), (0.2, 3, 20)])
def test_ngram_join_goes_on_with_differences(spark, monkeypatch, few, frequent, long):
    """Copies with few and many edits, that share edits or don't: links that only members have among each other."""
    for name, value in (("FEW", few), ("MORE", 2), ("FREQUENT", frequent), ("LONG", long), ("TOP_COUNT", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    r, texts, rebased = random.Random(12), {}, []
    real = ngram_join.rebased
    monkeypatch.setattr(ngram_join, "rebased", lambda *a: rebased.append(1) or real(*a))
    for g in range(2):
        base = words(120, 50 + g, 3000).split()
        for i in range(60):
            w = list(base if i < 40 or not i % 2 else texts[1000 * g + i - 1].split())
            for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["the"], [f"v{r.randrange(50)}"], [w[k], "of"]])
            texts[1000 * g + i] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.linked(rows, 3, 90).collect()} == components_of(texts, 3, 90)
    assert few == 8 or rebased


def test_one_of_each(spark, docs, empty):
    rows = docs.unionByName(spark.createDataFrame([(5, corpus()[5][1], "en", "s", 1), (None, "one two", "en", "s", 7)], SCHEMA))
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(rows, 5, 80).collect())
    assert kept == sorted({c for _, c in components_of(text_of(), 5, 80).values()})
    assert ngram_join.one_of_each(empty, 5, 80).count() == 0


def test_fingerprints(docs, empty, spark):
    texts = sorted(text_of().items())
    units = lambda t: {p for p in re.split(r"[\n\r]+|(?<=[.!?])\s+", t) if p}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert math.isclose(r.near_edited, like(units(t), units(new))) and math.isclose(r.near_next, like(units(t), units(after)))
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert fingerprints.fingerprints(empty).count() == 0


def brute_repeats(texts, length=suffix_dedup.LENGTH):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(r[k : k + length] for r in raw.values() for k in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("group", [1500, 1])
def test_suffix_dedup(docs, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = suffix_dedup.cut(docs.withColumn("kept", F.lit("clash")).withColumn("size", F.lit(1)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows.collect()}
    assert got == brute_repeats(text_of())


def test_suffix_array():
    r = random.Random(3)
    for _ in range(40):
        letters, depth = r.choice([b"ab", b"abcdef", b"a"]), r.choice([3, 6])
        parts = [bytes(r.choice(letters) for _ in range(r.randint(1, 25) + depth - 1)) for _ in range(r.randint(1, 6))]
        counts = np.array([len(p) - depth + 1 for p in parts])
        raw, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        order = suffix_dedup.suffix_array(raw, ends - [len(p) for p in parts], counts, ends, depth)
        keys = [raw[i : i + depth] for i in order]
        assert keys == sorted(keys) and len(set(order.tolist())) == counts.sum()
        want = [0] + [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(keys, keys[1:])]
        got = suffix_dedup.common_prefixes(raw, order, depth) if depth >= 8 else None
        assert got is None or got.tolist() == want


def test_sorted_strings(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3)
    r = random.Random(5)
    for letters in (b"ab", b"\x00a", b"\x00", b"abc\xff"):
        raw = bytes(r.choice(letters) for _ in range(150))
        begins = np.array([r.randrange(150) for _ in range(80)])
        ends = np.minimum(begins + 20, [r.choice([150, 60 if b < 60 else 150]) for b in begins])
        order = suffix_dedup.sorted_strings(raw, begins, ends, 20)
        keys = [raw[begins[i] : ends[i]] for i in order]
        assert sorted(order.tolist()) == list(range(80)) and keys == sorted(keys)


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.cut(empty).count() == 0


def test_byte_bpe(docs, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, RANKS).collect():
        ids = enc.encode_ordinary(text_of()[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text_of()[r.doc_id].encode()).hexdigest()
    bpe, rng = byte_bpe.ByteBpe(ranks), random.Random(4)
    for _ in range(2000):
        raw = bytes(rng.choice(b"abcdeinorst \xc3\xa9'") for _ in range(rng.randint(1, 30)))
        assert bpe.encode_piece(raw) == ([ranks[raw]] if raw in ranks else bpe.merged(raw))
    assert byte_bpe.round_trip(empty, RANKS).count() == 0


def test_packing(docs, empty):
    t = tokenizer()
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4") for i, x in text_of().items()}
    rows = packing.packed(docs, JSON).toPandas().sort_values(["sequence_id", "offset"])
    for r in rows.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    total = rows.groupby("sequence_id")["length"].sum()
    assert rows["length"].sum() == sum(map(len, ids.values())) and total.max() <= 1024 and (rows["offset"] == rows.groupby("sequence_id")["length"].cumsum() - rows["length"]).all()
    assert packing.packed(empty, JSON).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_keeps_every_capacity(score):
    cap = packing.Capacity(100, 4, 4000, (1.0, 0.5, 0.5), score)
    lengths = np.random.default_rng(2).integers(1, 60, 500)
    seq, _ = packing.pack(lengths, cap)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 4000


def test_sharding(spark, docs, empty):
    out, slots = sharding.shard(docs, 4)
    rows = out.toPandas()
    assert len(rows) == len(corpus()) and all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))
    assert all(r.size == len(text_of()[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text_of()[r.doc_id].encode()) for r in rows.itertuples(index=False) if not callable(r.size))
    version, held = sharding.newest(slots)
    assert version == 1 and all(held[r.vslot] == r.shard for r in rows.itertuples(index=False))
    weights = {r["vslot"]: (r["n"], r["b"]) for r in out.groupBy("vslot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    both = sharding.rebalance(slots, weights, 5)
    assert sharding.newest(both)[0] == 2 and both.filter("version = 1").count() == len(held) and sharding.newest(both)[1] == sharding.rebalanced(held, weights, 5)
    weights = {i: (1, 10) for i in range(64)}
    one = sharding.first_map(weights, 4)
    two = sharding.rebalanced(one, weights, 5)
    assert all(two[s] in (one[s], 4) for s in one) and 8 <= sum(v == 4 for v in two.values()) <= 13
    assert sharding.shard(empty, 4)[0].count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(60)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(v, "vec_id", "embedding", 20, lambda c: c % 20 == 0).toPandas()
    live = [(i, np.array(e)) for i, e in rows if i < 2000]
    hit = total = 0
    for i, q in live:
        if i % 20:
            continue
        best = sorted(((-float(np.dot(q, e)), j) for j, e in live if j != i))[:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert len(mine) == 20 and (np.diff(mine.score) <= 1e-12).all() and i not in set(mine.vec_id)
        hit, total = hit + len({j for _, j in best} & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9
    few = neighbours.nearest(v.limit(0), "vec_id", "embedding", 20, lambda c: c % 20 == 0)
    assert few.count() == 0


def test_token_files(docs, empty):
    t, start = tokenizer(), 0
    got = {r.doc_id: r for r in token_files.read(token_files.write(docs, JSON, block_tokens=500)).collect()}
    for i, x in sorted(text_of().items()):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(token_files.write(empty, JSON)).count() == 0


def test_pieces_give_what_the_library_gives():
    r, parts = random.Random(9), ["a", "Bc", "don't", "'", "'s", " ", "  ", "\n", "\n\n", "\t", "1", "23", ".", ",", "!?", "é", "中文", " ", "\u0301", "<|endoftext|>", "<|end", "\x00", "x" * 20, "_", "’s", " '", "I'll", "😀", "\r\n", "\u00a0", "0a", "'1", "\u2028"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(5000)] + [None, "", "a <|endoftext|> b", "word " * 60_000]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokens_module.PieceEncoder(JSON).encode(texts) == want
    small = tokens_module.PieceEncoder(JSON, pieces=64)
    assert [x for i in range(0, len(texts), 40) for x in small.encode(texts[i : i + 40])] == want


def test_grammar_goes_on_until_no_pair_pays():
    r = np.random.default_rng(7)
    ids = np.concatenate([np.tile(r.integers(0, 9, 37), 30), r.integers(0, 9, 400), np.zeros(100)]).astype(np.uint32)
    terminals, rules, seq = token_files.grammar(ids)
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert max(pairs.values()) < token_files.LEAST and (rules < terminals + np.arange(len(rules))[:, None]).all() and len(seq) < 400


def test_grammar_round_trip():
    r = np.random.default_rng(6)
    lengths = [50, 0, 700, 1, 3000]
    ids = np.concatenate([r.integers(0, 6, n) for n in lengths]).astype(np.uint32)
    b = token_files.Block(token_files.block(ids, lengths, [1, None, 3, 4, 5]))
    assert (b.all_ids() == ids).all() and len(b.symbols) < len(ids)
    cut = np.concatenate([[0], np.cumsum(lengths)])
    assert all((b.ids(i) == ids[cut[i] : cut[i + 1]]).all() for i in range(5) if lengths[i])


def test_language_id(spark, empty):
    r = random.Random(7)
    langs = {"aa": "bcdfgaei", "bb": "klmnouy", "cc": "éèçàrst"}
    rows = [(i, " ".join("".join(r.choice(langs[x]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 60))), x) for i in range(300) for x in [list(langs)[i % 3]]]
    train = spark.createDataFrame(rows[:200], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    test = spark.createDataFrame([*rows[200:], (900, None, None), (901, "123 !!", None), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(test, model, ["doc_id"]).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows[200:]) >= 95 and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.fit(empty) is None and language_id.predict(train, None, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, words(30, 200 + i), "en" if i % 2 else "de", "s", 1) for i in range(12)], SCHEMA)
    clash = rows.withColumns({"score": F.col("doc_id") * 10, "lang_pred": F.lit("x"), "margin": F.lit("m")})
    kept = corpus_pipeline.language(spark, clash, "")
    assert kept.columns == clash.columns and {(r.doc_id, r.score, r.lang_pred, r.margin) for r in kept.collect()} == {(i, 10 * i, "x", "m") for i in range(12)}
    found = language_id.predict(clash, language_id.fit(rows), ["doc_id", "score"])
    assert found.columns == ["doc_id", "lang_pred", "score", "margin"] and found.count() == 12


def test_pipeline(spark, docs):
    rows = spark.createDataFrame(corpus() + [(50, words(70, 11), None, "s", 1)], SCHEMA)
    kept = corpus_pipeline.language(spark, rows, "")
    assert kept.columns == rows.columns and not {0, 1, 12} & {r.doc_id for r in kept.collect()}
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in components_of(texts, 5, 80).values()})
    cut = corpus_pipeline.passages(spark, single, "")
    left = {r.doc_id: r.text for r in single.collect()}
    gone = brute_repeats(left)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {i: g[3] for i, g in gone.items() if g[1] < g[0]}
    assert cut.columns == rows.columns
    packed = corpus_pipeline.packing(spark, cut, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}


def brute_passages(texts, n):
    """Bytes left of each text where those of words in repeated n-word passages, and between them, are gone, as are repeated strings of LENGTH bytes."""
    raw = {i: t.encode() for i, t in texts.items()}
    at = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", r)] for i, r in raw.items()}
    keys = {i: [tuple(raw[i][a:b] for a, b in w[k : k + n]) for k in range(len(w) - n + 1)] for i, w in at.items()}
    seen = Counter(k for ks in keys.values() for k in ks)
    strings = Counter(r[k : k + suffix_dedup.LENGTH] for r in raw.values() for k in range(len(r) - suffix_dedup.LENGTH + 1))
    out = {}
    for i, r in raw.items():
        gone = np.zeros(len(r), bool)
        for k, key in enumerate(keys[i]):
            if seen[key] > 1:
                gone[at[i][k][0] : at[i][k + n - 1][1]] = True
        for k in range(len(r) - suffix_dedup.LENGTH + 1):
            if strings[r[k : k + suffix_dedup.LENGTH]] > 1:
                gone[k : k + suffix_dedup.LENGTH] = True
        out[i] = bytes(np.frombuffer(r, np.uint8)[~gone])
    return out


@pytest.mark.parametrize("group", [1500, 1])
def test_repeated_passages_by_words(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    n, few, many, tiny = corpus_pipeline.PASSAGE, words(50, 21), words(51, 22), "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    tiny = tiny[:101]  # 51 words of one letter
    texts = dict(corpus_texts := text_of()) | {
        100: words(30, 23) + " " + few + " " + words(30, 24), 101: words(20, 25) + "\n" + few, 102: words(20, 26) + " " + many + "\n" + words(5, 27), 103: many.replace(" ", "\n\t"), 104: "é ü " + many + " end",
        105: tiny, 106: "one " + tiny + " two", 107: "w " * 51, 108: "v " * 52 + "\n", 109: many.upper(), 110: " ".join(words(60, 28).split()[:50]) + " x", 111: words(60, 28) + " ", 112: words(60, 28) + "\n",
    }
    assert len(many) < suffix_dedup.LENGTH and n == 51 and len(corpus_texts) < len(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept for r in suffix_dedup.cut(rows, words=n).collect()}
    want = brute_passages(texts, n)
    assert {i: bytes(x) for i, x in got.items()} == want
    assert want[100] == texts[100].encode() and many.encode() not in want[102] and want[103] == b"" and want[104] == "é ü  end".encode() and want[105] == b""
    assert suffix_dedup.cut(rows.limit(0), words=n).count() == 0


def test_pipeline_cuts_passages_of_51_words(spark):
    passage = words(51, 31)
    rows = spark.createDataFrame([(i, words(40, 40 + i) + " " + passage + " " + words(40, 60 + i), "en", "s", 1) for i in range(3)], SCHEMA)
    assert [passage in r.text for r in corpus_pipeline.passages(spark, rows, "").collect()] == [False] * 3


def test_pipeline_rejects_what_no_language_claims(spark):
    r = random.Random(8)
    vocabularies = {x: ["".join(r.choice(c) for _ in range(r.randint(2, 7))) for _ in range(150)] for x, c in {"aa": "bcdfgaei", "bb": "klmnouy", "cc": "éèçàrst", "dd": "hjvwöäüi"}.items()}
    clean = lambda x, n: " ".join(r.choice(vocabularies[x]) for _ in range(n))
    known = [(i, clean(x, r.randint(20, 60)), x) for i in range(200) for x in [list(vocabularies)[i % 4]]]
    unlabelled = [(300 + i, clean(x, 25), None) for i in range(40) for x in [list(vocabularies)[i % 4]]]
    consonants = [(400 + i, " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(25)), None) for i in range(40)]
    scripts = [(500, "Все люди рождаются свободными и равными в своем достоинстве и правах", None), (501, "人人生而自由在尊严和权利上一律平等", None), (502, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι", None)]
    rows = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in known + unlabelled + consonants + scripts], SCHEMA)
    kept = {k.doc_id: k.lang for k in corpus_pipeline.language(spark, rows, "").collect()}
    assert kept == {i: x for i, _, x in known} | {i: list(vocabularies)[i % 4] for i, _, _ in unlabelled}


def test_language_model_keeps_every_ngram(spark):
    texts = {i: words(40, 70 + i, 60) for i in range(12)}
    texts |= {20: texts[0][:90], 21: words(30, 99, 80), 22: texts[3] + " unseen " + texts[4]}  # near copies of what training holds once
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 20)
    stream = {i: [*tokens(t), None] for i, t in texts.items()}
    counts = [Counter(tuple(w[k : k + n]) for i, w in stream.items() if i < 20 for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())
    d = [language_model.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())) for c in counts]
    children = [Counter(), *({} for _ in counts[1:])]
    for k in (1, 2):
        for gram, n in counts[k].items():
            children[k][gram[:-1]] = children[k].get(gram[:-1], 0) + n - d[k]

    def prob(gram):
        k = len(gram) - 1
        if not k:
            return (counts[0][gram] - d[0]) / total if gram in counts[0] else d[0] * len(counts[0]) / total
        times, low = counts[k - 1][gram[:-1]], prob(gram[1:])
        if gram[:-1] not in children[k]:
            return low
        return (counts[k][gram] - d[k] if gram in counts[k] else 0) / times + (1 - children[k][gram[:-1]] / times) * low

    assert sum(n == 1 for n in counts[2].values()) > 0.5 * len(counts[2])
    for r in language_model.scored(rows, language_model.learned(rows.filter(~F.col("held_out")))).collect():
        w = stream[r.doc_id]
        want = sum(math.log10(prob(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert abs(r.score - want) < 0.02 * len(w), (r.doc_id, r.score, want)
