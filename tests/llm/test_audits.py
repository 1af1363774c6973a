"""Conversation repair, source divergence and toxicity against brute force: nulls, empty texts, ties, repeats, long groups, empty tables, clashing columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clearloom.llm import conversation_repair, queries, source_divergence, toxicity

TURNS = "conv_id long, turn long, role string, text string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cheapest(turns):
    """(cost, audit, repaired lines) by a shortest path over whole audits; turns: (initial, role, text, fault)."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    write, names = {0: 2, 1: 2, 3: 2, 2: 3}, {2: "user", 3: "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        to = write[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, f"{names[to]}:")))
        if i < len(turns):
            initial, role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*lines, f"{names[to]}:{text}")))
                if (state, initial) in keep:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, keep[state, initial], (*lines, f"{role}:{text}")))


def repaired_by_hand(rows):
    """conv_id: the result for rows (conv_id, turn, role, text) as they stand."""
    by_conv, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role or (" " if role is None else ""), " " if text is None else text))
    for conv, turns in by_conv.items():
        order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:32].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        turns.sort(key=order)
        seen, marked = set(), []
        for _, role, text in turns:
            solid = re.search(r"[^\x20\x09-\x0d]", text)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if text.strip(" \t\n\v\f\r")[-1] not in ".!?" else 0
            seen.add((role, text))
            marked.append((role[:1], role, text, fault))
        cost, audit, lines = cheapest(marked)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = Counter(m[3] for m in marked)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        out[conv] = (gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    r = random.Random(seed)
    texts = ["Hello there.", "Why?", "cut off", "", "  \n", "Yes! ", None, "x" * 5000 + ".", "é ü."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "s", "upper"]
    return [(None if c == 0 else c, r.choice([None, *range(6)]), r.choice(roles), r.choice(texts)) for c in range(n) for _ in range(r.randrange(1, 9))]


@pytest.mark.parametrize("block", [4096, 2])
def test_conversation_repair(spark, block, monkeypatch):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = conversations(1) + [(99, i, "user" if i % 3 else "assistant", f"turn {i // 2}.") for i in range(300)]
    got_summary, edits, repaired = conversation_repair.repair(spark.createDataFrame(rows, TURNS).withColumn("pos", F.lit(7)).repartition(5))
    shas = {r.conv_id: r.repaired_sha256 for r in conversation_repair.repaired_sha256(repaired).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in got_summary.collect()}
    assert got == repaired_by_hand(rows)
    assert edits.count() == sum(len(x[6]) for x in got.values())


def test_cost_layers_against_shortest_paths():
    r, steps = random.Random(5), conversation_repair.StackSteps()
    for _ in range(400):
        codes = bytes(r.randrange(4) + 4 * r.choice([0, 0, 0, 1, 2, 3, 3]) for _ in range(r.randrange(0, 14)))
        turns = [("suax"[c & 3], "suax"[c & 3], "t", c >> 2) for c in codes]
        assert conversation_repair.least_edits(codes, steps) == cheapest(turns)[:2]
    long = bytes(r.randrange(16) for _ in range(200_000))
    cost, audit = conversation_repair.least_edits(long, steps)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] + (3 if e in "KR" and long[i] >> 2 == 3 else 0) for i, e, _ in conversation_repair.role_after(audit, long))
    assert len(steps.stacks) < 200


def test_op11_damage(spark, tmp_path):
    rows = conversations(2) + [(500, t, "user", "gone.") for t in range(2000) if zlib.crc32(f"500:{t}".encode()) % 20 == 0][:3]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            hurt += [(conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (2 if fault == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows} | repaired_by_hand(hurt)
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == want and 500 in got


def test_op11_empty_table(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).count() == 0


def texts_of_sources(sources=7, docs=90):
    r, rows = random.Random(3), []
    for i in range(docs):
        k = r.randrange(sources)
        words = ["The", "of", "Éa", *(f"w{'abcdefg'[k]}{'xyz'[r.randrange(3)]}" for _ in range(3)), *(r.choice(["alpha", "BETA", "gamma", "ü", "once" + "abcdefghij"[i % 10]]) for _ in range(r.randrange(9)))]
        rows.append((i, r.choice([" ", ", ", "1"]).join(words * r.randrange(1, 4)), r.choice(["en", "en", "de", None]), r.choice([f"s{k}", f"s{k}", None]), 0))
    rows += [(900, None, "en", "silent", 0), (901, "", "xx", "a", 0), (902, "solo word", "xx", "b", 0), (903, "123 456", None, None, 0), (904, "Alpha " * 30_000, "en", "s1", 0)]
    return rows + rows[:4]


def divergence_by_hand(rows, top=200):
    docs = [((lang or ""), (source or ""), Counter(re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))) for _, text, lang, source, _ in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = sorted(t for t, n in held.items() if n >= 3)
        groups = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, c in docs:
            if x == lang:
                groups[s].update({t: n for t, n in c.items() if t in held and held[t] >= 3})
        every = sum(groups.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in groups.items()}, p(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            term = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and ps[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("heavy,strip,cells", [(0.25, 64, 1 << 18), (0.0, 2, 16), (1.0, 2, 16), (0.4, 3, 64)])
def test_source_divergence(spark, heavy, strip, cells, monkeypatch, tmp_path):
    for name, value in (("HEAVY", heavy), ("STRIP", strip), ("TILE_CELLS", cells), ("TILE_POSTINGS", cells), ("HELD", 20), ("PIECE", 1000)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = texts_of_sources()
    spark.createDataFrame(rows, SCHEMA).withColumns({"term": F.lit("x"), "tid": F.lit(1), "p": F.lit(2)}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op12_source_divergence"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == divergence_by_hand(rows)


def test_source_divergence_empty(spark):
    assert all(df.count() == 0 for df in source_divergence.divergence(spark.createDataFrame([], SCHEMA)))


def test_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(3 * 10**17, 10**18), (0, 3), (7, 10**15)], "c long, n long")
    assert [r[0] for r in rows.select(source_divergence.scaled(F.col("c"), F.col("n"))).collect()] == [1 + 10**9 * (c + 1) // n for c, n in ((3 * 10**17, 10**18), (0, 3), (7, 10**15))]


def test_grammar():
    symbol = {"idiot": "i", "kill": "h", "you": "t", "not": "n", "said": "r", ",": ","}
    weigh = lambda text: toxicity.clause_weight(x := [symbol.get(w, "o") for w in text.split()], [1.0] * len(x))[0]
    assert weigh("a b c") == 0 and weigh("an idiot") == 1 and weigh("you are an idiot") == 1.5
    assert weigh("not an idiot") == 0.2 and weigh("not here , an idiot") == 1 and weigh("not a b c idiot") == 1
    assert weigh("he said an idiot") == pytest.approx(0.4) and weigh("he said you idiot") == pytest.approx(0.6)
    assert weigh("idiot that you are") == 1.5 and weigh("i will kill you") == 1.5 and weigh("he said not an idiot") == pytest.approx(0.08)
    whole = toxicity.negation().then(toxicity.reported()).then(toxicity.targeted())
    assert whole.step == toxicity.GRAMMAR.step and len({s for s, _ in whole.step}) <= 4 * 2 * 25


def tables(spark, path, n=600):
    r = random.Random(11)
    bad, plain = ["zorgfel", "zorgnub", "mirk", "zorgal"], [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [r.choice(plain) for _ in range(r.randrange(20, 200))]
        for _ in range(max(1, len(words) // 25) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad)
        docs.append((i, " ".join(w + (". " if k % 9 == 8 else "") for k, w in enumerate(words)), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "mirk", "en", "s", 0), (None, "balm " * 9, "en", "s", 0), (10_003, "dam. " * 400_000 + "mirk " * 9, "en", "s", 0), docs[0]]
    labels += [(1, None, None), (None, 1, 1), (2, 1, 7), (3, 1, 0)]
    spark.createDataFrame(docs, SCHEMA).withColumn("score", F.lit(3)).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_toxicity(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    got = queries.QUERIES["op13_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    of = {r.doc_id: r.score for r in got}
    assert of[10_000] == of[10_001] < 0.5 < of[10_002] and of[None] < 0.5
    again = {r.doc_id: r.score for r in queries.QUERIES["op13_toxicity"](spark, str(tmp_path)).collect()}
    assert again == of


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "You are an idiot. Fine day, isn't it?", "en", "s", 0), (2, "A fine day.", "en", "s", 0), (3, None, "en", "s", 0)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id", "source"]).collect()}
    assert got[1].score > got[2].score and [(c.start, c.length, c.matched) for c in got[1].clauses] == [(0, 16, "i@")] and not got[2].clauses
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_pieces_are_whole():
    text = ("abc. " * 50 + "x" * 90 + " ") * 3
    old, toxicity.PIECE = toxicity.PIECE, 40
    try:
        got = list(toxicity.pieces(text))
    finally:
        toxicity.PIECE = old
    assert "".join(p for _, p in got) == text and all(text.startswith(p, at) for at, p in got)


def test_long_words_that_differ_are_not_one():
    """Words that a rolling hash modulo a power of two can't tell apart."""
    import numpy as np

    from clearloom.llm import common

    a = b = "a"
    for _ in range(10):
        a, b = a + a.translate(str.maketrans("ab", "ba")), b.translate(str.maketrans("ab", "ba")) + b
    one = a.encode()
    other = one.translate(bytes.maketrans(b"ab", b"ba"))
    raw = np.frombuffer(one + b" " + other, np.uint8)
    w, d = common.word_hashes(np.array([0, len(raw)]), raw)
    assert len(w) == 2 and w[0] != w[1] and d.tolist() == [0, 0]


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    import numpy as np

    from clearloom.llm import common

    texts = ["Aa bb  ccc\tD", "", " ", "x" * 300 + " y", "one two three four five six seven", "z"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = common.word_hashes(offsets, raw)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        got = common.word_hashes(offsets, raw)
        assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_counts_of_ids_beyond_63_bits():
    import numpy as np

    from clearloom.llm import language_model

    r = np.random.default_rng(1)
    parent, suffix = r.integers(0, 5, 200) << 40, r.integers(0, 5, 200) << 40
    n = r.integers(1, 9, 200)
    want, sums = Counter(zip(parent.tolist(), suffix.tolist())), Counter()
    for p, s, k in zip(parent.tolist(), suffix.tolist(), n.tolist()):
        sums[p, s] += k
    for weights, expected in ((None, want), (n, sums)):
        p, s, c = language_model.counted(parent, suffix, weights)
        assert list(zip(p.tolist(), s.tolist())) == sorted(want) and dict(zip(zip(p.tolist(), s.tolist()), c.tolist())) == dict(expected)


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    r = random.Random(4)
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi", "psi", "mu"]) + str(r.randrange(50)) for _ in range(n))
    base = words(80)
    rows = [(1, base), (2, base), (3, words(70)), (None, words(60)), (None, words(61)), (3, words(50)), (4, base + " " + words(2))]
    names = ["gone_id", "gone_by", "gone_t", "t", "label", "n_bytes", "n_removed", "n_spans", "removed", "kept", "__t", "__text", "__size", "__spans", "__words", "h", "node", "n", "s1", "lang_pred", "score", "margin", "first_id", "first_t", "n_chars"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").withColumns({c: F.concat(F.lit(c), F.substring("text", 1, 9)) for c in names if c != "n_chars"}).withColumn("n_chars", F.lit(5).cast("long"))
    for step, f in corpus_pipeline.STAGES[:-1]:
        docs_after = f(spark, docs, "")
        assert docs_after.columns == docs.columns and dict(docs_after.dtypes) == dict(docs.dtypes), step
        got = docs_after.collect()
        assert all(x[c] == c + x["gone_id"][7:] for x in got for c in names if c != "n_chars")
        docs = docs_after
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 3, 3] and all(x.n_chars == len(x.text) for x in got)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_whole_pipeline(spark, tmp_path, kind):
    import corpus_pipeline

    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    one, passage = words(90), words(60)
    rows = [] if kind == "empty" else [(1, one), (1, one), (None, one), (2, None), (None, None), (3, ""), (4, words(30) + " " + passage), (5, passage + " " + words(30)), (6, words(40)), (6, words(41)), (None, words(42))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert got == []
    else:
        ids = [x.doc_id for x in got if x.piece == 0]
        assert sorted(x or 0 for x in ids) == [0, 1, 4, 5, 6, 6] and all(x.length <= 1024 for x in got)


def paragraphs(text):
    return {p for p in re.split(r"[\n\r]+|(?<=[.!?])\s+", text or "") if p}


def versions(seed=9):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(5))
    old = {i: [line() for _ in range(r.choice([1, 5, 40, 300]))] for i in range(30)} | {90: None, 91: [], 92: ["same"]}
    new = {i: x and ([y for y in x if r.random() > 0.1] + [line() for _ in range(len(x) // 10)]) for i, x in old.items()} | {90: None, 91: ["new"], 92: ["same"]}
    text = lambda x: None if x is None else "\n".join(x)
    return {i: text(x) for i, x in old.items()}, {i: text(x) for i, x in new.items()}


def test_stored_sketches_subtract(spark, tmp_path):
    from clearloom.llm import fingerprints

    old, new = versions()
    for name, rows in (("old", old), ("new", new)):
        fingerprints.sketches(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 128).write.parquet(f"{tmp_path}/{name}")
    got = {r.doc_id: r for r in fingerprints.subtracted(*(spark.read.parquet(f"{tmp_path}/{n}") for n in ("old", "new"))).collect()}
    assert got.keys() == old.keys()
    for i, r in got.items():
        a, b = paragraphs(old[i]), paragraphs(new[i])
        assert (r.only_a, r.only_b, r.left) == (len(a - b), len(b - a), 0)
    small = fingerprints.sketches(spark.createDataFrame([(1, "\n".join(map(str, range(400))))], "doc_id long, text string"), 8)
    none = fingerprints.sketches(spark.createDataFrame([(1, "")], "doc_id long, text string"), 8)
    assert fingerprints.subtracted(small, none).first().left > 0


def test_sketches_are_tried_again_until_they_empty(spark, monkeypatch):
    from clearloom.llm import fingerprints

    old, _ = versions(3)
    docs = spark.createDataFrame([(i, t) for i, t in old.items() if i < 12 or i > 88], "doc_id long, text string")
    want = sorted(tuple(r) for r in fingerprints.fingerprints(docs).select("doc_id", "near_edited", "near_next", "n_diff_next").collect())
    tries, pairs = [], fingerprints.pairs
    monkeypatch.setattr(fingerprints, "third", lambda n, scale=1: (n / 8 + 2 * scale).cast("int") + scale)
    monkeypatch.setattr(fingerprints, "pairs", lambda *a: tries.append(a[-1]) or pairs(*a))
    got = sorted(tuple(r) for r in fingerprints.fingerprints(docs).select("doc_id", "near_edited", "near_next", "n_diff_next").collect())
    assert got == want and len(tries) > 2 and tries == [1 << i for i in range(len(tries))]


def test_vectors_of_several_lengths(spark):
    """Each length by itself; all candidates where they are fewer than asked for."""
    import numpy as np

    from clearloom.llm import neighbours

    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3 if i % 3 else 5).tolist()) for i in range(100)] + [(200, [1.0])] + [(300 + i, [1.0, float(i)]) for i in range(6)] + [(1020, [2.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 4, lambda c: c % 20 == 0).collect()
    vectors, found = dict(rows), {}
    for x in got:
        assert len(vectors[x.vec_id]) == len(vectors[x.query_id]) and x.vec_id != x.query_id and abs(x.score - np.dot(vectors[x.vec_id], vectors[x.query_id])) < 1e-12
        found.setdefault(x.query_id, {})[x.rank] = x.vec_id
    assert found.keys() == {0, 20, 40, 60, 80, 300, 1020} and all(sorted(f) == [1, 2, 3, 4] for f in found.values())
    assert found[1020] == {1: 305, 2: 304, 3: 303, 4: 302}
