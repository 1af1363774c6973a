"""Cases of the findings of round 3."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from clearloom.llm import common, ngram_join, suffix_dedup, tokens


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_texts_move_once(spark, monkeypatch):
    """Copies of every run need no bytes; where many texts have repeats, they meet their spans in one join."""
    monkeypatch.setattr(common, "FEW_ROWS", 1)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    same, part, own = text(900), text(450), text(700)
    docs = spark.createDataFrame([(1, same), (2, same), (3, own + part), (4, part + text(500)), (5, "short")], "doc_id long, text string")
    out = suffix_dedup.cut(docs)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in out.collect()}
    assert got[1] == got[2] == (900, 1, "") and got[3] == (450, 1, own) and got[4][:2] == (450, 1) and got[5] == (0, 0, "short")
    assert out._jdf.queryExecution().analyzed().toString().count("Join ") == 1


def test_words_that_begin_above_ascii_are_pieces():
    """A space before a letter above ASCII begins a piece, so phrases aren't kept whole; ids stay the library's, whatever else stands there."""
    enc = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(3)
    some = ["é", "les", " ", "  ", " ", "\u0085", " ", "　", "́", "×", "÷", "ß", "Ж", "λό", "'s", "'", "9", "²", ".", "\n", "\t", "؜", "ޱ", "日本", "😀", "ꟊ", "ǅ"]
    texts = ["".join(r.choice([*some, " "]) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    enc, new = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json")), []
    learn = enc.learn
    enc.learn = lambda pieces: new.extend(pieces) or learn(pieces)
    enc.encode([" ".join(r.choice(["école", "été", "à", "les"]) for _ in range(50)) for _ in range(200)])
    assert len(new) < 12 and os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_members_of_later_rounds_carry_size_and_copies(spark):
    """What a round needs of a member comes along with it, so no join makes a row for each member of each round."""
    texts = ["a b c d e f g h", "a b c d e f g x", "a b c d e f g x", "q r s t u"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    _, classes, top = ngram_join.classed(docs, 2, 80)
    lead = classes.filter("n = 7 and copies = 1").first().node
    groups = classes.filter(F.col("node") != lead).select(F.lit(lead).alias("lead"), "node", "n", "copies")
    found = ngram_join.rebased(groups, docs, top, 2, 80)
    want = {(r.node, r.n, r.copies) for r in groups.collect()}
    assert {(r.node, r.n, r.copies) for r in found.collect()} == want and {(n, c) for _, n, c in want} == {(7, 2), (4, 1)}


def test_near_copies_are_not_combined_in_all_pairs(spark, monkeypatch):
    """Shared n-grams of a group of near copies give a few buckets a class, not one for each pair of them; linked classes still meet."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    r, percent = random.Random(5), 80
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    texts = [" ".join(base[:i] + [f"v{i}"] + base[i + 1 :]) for i in range(2, 118, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("t", F.xxhash64("text"))
    _, classes, top = ngram_join.classed(docs, 3, percent)
    lists = classes.select("node", "n", "copies", F.array_sort("prefix").alias("gs"))
    frequent = lists.select("node", F.explode("gs").alias("g")).groupBy("g").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 4)
    shared = {(a, b) for row in frequent.collect() for a in row.nodes for b in row.nodes if a < b}
    rows = ngram_join.index(classes, docs, top, 3, percent).select("key", "node").collect()
    met, members = set(), {}
    for key, node in rows:
        members.setdefault(key, set()).add(node)
    for nodes in members.values():
        met |= {(a, b) for a in nodes for b in nodes if a < b}
    assert len(texts) == 29 and len(shared) == 29 * 28 // 2 and shared <= met
    assert len(rows) <= 2 * ngram_join.prefix_size(118, percent) * len(texts)
