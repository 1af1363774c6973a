"""Toxicity by a weighted finite-state pattern grammar. Words become symbols (insult, threat, target, negation, reported speech, comma, other); transducers for negation, reported speech and targets are composed into one machine, which runs over clauses and weighs each insult or threat by how it is said: to somebody, negated, or as what somebody else said. A text's score comes from its matched clauses, not from words alone.

Insults are learned: onsets of words (whole words too, marked by a final $) that labelled toxic texts hold at least LIFT times as often as the others, and beyond chance. A word weighs as its longest onset: the logarithm of both shares. Threats, targets, negations and reporting verbs are word lists; a listed insult or threat that many clean texts hold is dropped. A logistic regression over sums of clauses (sum, greatest, number, number of words, sum for each word) gives the score. For it, each labelled text is read with weights worked out without that text.

The model is fitted on at most PER_CLASS labelled texts of each class, the first by a hash of id and text; only counts of onsets and numbers reach the driver. All texts are scored whole, long ones in pieces of PIECE characters cut between clauses (a clause longer than a piece is cut between words).

Nulls: a null text is empty; an empty text has the score of a text without words. Rows with a null label, or one besides 0 and 1, aren't learned from; of several labels of an id the greatest counts. Without labelled rows of both classes only the word lists count, with fixed coefficients. Repeated rows and null doc_ids are scored row by row. An empty table gives an empty result. score() keeps the columns that it is asked for; columns with names of its own (OWN) can't be among them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, table

PER_CLASS = 4000
#: Onsets of so many characters; those kept at most; toxic texts that must hold one; how much commoner it must be there.
ONSETS, MOST_ONSETS, LEAST_TEXTS, LIFT = range(3, 9), 5000, 3, 4.0
#: Weights of onsets lie below this; listed words without evidence weigh LISTED.
MOST_WEIGHT, LISTED = 6.0, 3.0
PIECE = 1 << 20
BATCH_DOCS = 512
THRESHOLD = 0.7

#: Word lists by kind, in English, German, French and Spanish.
WORDS = {
    "i": "idiot moron stupid fool jerk scum dumm trottel versager abschaum imbécile crétin stupide ordure idiota imbécil estúpido basura",
    "h": "kill hurt destroy strangle töten umbringen verprügeln tuer frapper étrangler matar golpear destruir",
    "t": "you your yours yourself du dich dir dein deine euch tu toi ton vous votre tú ti tuyo usted ustedes vosotros",
    "n": "not never no isn't aren't don't nicht nie kein keine ne pas jamais nunca jamás",
    "r": "said says wrote claimed called quoted sagte schrieb behauptete nannte dit écrit prétend dijo escribió llamó",
}
#: How much an insult or threat counts by what is said of it: - negated, " reported, @ with a target before it; b is a target after it, which adds to it.
FACTORS = {"-": 0.2, '"': 0.4, "@": 1.5, "b": 0.5}

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
CLAUSE = re.compile(r"[^.!?;\n]+")
OWN = ("score", "predicted", "clauses")


@dataclass
class Transducer:
    """Letter by letter: (state, symbol) gives (symbol, state). State 0 begins; all states end."""

    step: dict[tuple[int, str], tuple[str, int]] = field(default_factory=dict)

    def symbols(self) -> set[str]:
        return {x for _, x in self.step}

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other one reads."""
        out, ids, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        for a, b in todo:
            for x in self.symbols():
                y, a2 = self.step[a, x]
                z, b2 = other.step[b, y]
                if (a2, b2) not in ids:
                    ids[a2, b2] = len(ids)
                    todo.append((a2, b2))
                out.step[ids[a, b], x] = z, ids[a2, b2]
        return out


def negation(reach: int = 3) -> Transducer:
    """Marks insults and threats up to `reach` words after a negation; a comma ends it."""
    t = Transducer()
    for k in range(reach + 1):
        less = max(k - 1, 0)
        t.step |= {(k, "n"): ("o", reach), (k, ","): ("o", 0)} | {(k, x): (x, less) for x in "otr"} | {(k, x): (x + "-" * (k > 0), less) for x in "ih"}
    return t


def reported() -> Transducer:
    """Marks insults and threats after a reporting verb, to the clause's end."""
    t = Transducer()
    for said in (0, 1):
        t.step |= {(said, "r"): ("o", 1), (said, "o"): ("o", said), (said, "t"): ("t", said)} | {(said, x): (x + '"' * said, said) for x in ("i", "h", "i-", "h-")}
    return t


def targeted(reach: int = 4) -> Transducer:
    """Marks insults and threats up to `reach` words after a target; writes b for a target up to `reach` words after one that had none."""
    t, ids = Transducer(), {}
    for before in range(reach + 1):
        for after in range(reach + 1):
            ids[before, after] = len(ids)
    hits = [x + n + r for x in "ih" for n in ("", "-") for r in ("", '"')]
    for (before, after), s in ids.items():
        less = max(before - 1, 0), max(after - 1, 0)
        t.step[s, "o"] = "o", ids[less]
        t.step[s, "t"] = "b" if after else "o", ids[reach, 0]
        for x in hits:
            t.step[s, x] = x + "@" * (before > 0), ids[less[0], 0 if before else reach]
    return t


GRAMMAR = negation().then(reported()).then(targeted())
_FACTOR = {y: math.prod(FACTORS[c] for c in y[1:]) for y, _ in GRAMMAR.step.values() if y[0] in "ih"}


def clause_weight(symbols: list[str], weights: list[float]) -> tuple[float, str]:
    """What the grammar makes of a clause: its weight, and what it matched."""
    state, total, last, seen = 0, 0.0, 0.0, ""
    step = GRAMMAR.step
    for x, w in zip(symbols, weights):
        y, state = step[state, x]
        if y == "b":
            total += FACTORS["b"] * last
            seen += y
        elif y != "o":
            last = w * _FACTOR[y]
            total += last
            seen += y
    return total, seen


def onsets(word: str) -> Iterator[str]:
    for k in ONSETS:
        if len(word) < k:
            break
        yield word[:k]
    yield word + "$"


def weight(t: float, c: float, toxic: int, clean: int) -> float:
    """Of an onset in t of the toxic texts and c of the clean ones."""
    return min(MOST_WEIGHT, math.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))))


class Lexicon:
    """Onsets by how many toxic and clean texts hold them. without: weights as if a text of this class (1, 0) that holds the onset hadn't been seen."""

    def __init__(self, counts: dict[str, tuple[int, int]], toxic: int, clean: int, common: set[str] = frozenset()):
        self.tables: dict[int | None, dict[str, float]] = {None: {}, 1: {}, 0: {}}
        for x, (t, c) in counts.items():
            for without, a, b in ((None, t, c), (1, t - 1, c), (0, t, c - 1)):
                if a >= (LEAST_TEXTS if without is None else LEAST_TEXTS - 1) and (w := weight(a, max(b, 0), toxic, clean)) > 0:
                    self.tables[without][x] = w
        self.listed = {w: (kind, LISTED) for kind, words in WORDS.items() for w in words.split() if kind not in "ih" or w not in common}
        self.known: dict[tuple, tuple[str, float]] = {}

    def symbol(self, word: str, without: int | None = None) -> tuple[str, float]:
        found = self.known.get((word, without))
        if found is None:
            learned, found = self.tables[without], None
            for x in (word + "$", *(word[:k] for k in reversed(ONSETS) if k <= len(word))):
                if x in learned:
                    kind = self.listed.get(word, "i")[0]
                    found = ("h" if kind == "h" else "i"), learned[x]
                    break
            found = found or self.listed.get(word) or ((",", 0.0) if word == "," else ("o", 0.0))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word, without] = found
        return found


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(start, piece): cut after a clause's end, else between words."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in ".!?;\n") + 1
        if cut <= at:
            m = re.compile(r"\s").search(text, at + PIECE)
            cut = m.end() if m else len(text)
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray

    def read(self, text: str, without: int | None = None, spans: list | None = None) -> np.ndarray:
        """Features of a text. spans gets (start, length, matched, weight) of matched clauses."""
        words, total, most, matched = 0, 0.0, 0.0, 0
        for at, piece in pieces(text):
            low = piece.lower()
            tokens = WORD.findall(low)
            words += len(tokens) - tokens.count(",")
            hits = {w for w in set(tokens) if self.lexicon.symbol(w, without)[0] in "ih"}
            if not hits:
                continue
            same = len(low) == len(piece)  # else places are those in the lower-cased text
            for m in CLAUSE.finditer(low):
                if hits.isdisjoint(clause := WORD.findall(m.group())):
                    continue
                symbols, weights = zip(*(self.lexicon.symbol(w, without) for w in clause))
                w, seen = clause_weight(symbols, weights)
                total, most, matched = total + w, max(most, w), matched + 1
                if spans is not None:
                    spans.append((at + m.start() if same else -1, m.end() - m.start(), seen, w))
        return np.array([1.0, math.log1p(total), math.log1p(most), math.log1p(matched), math.log1p(words), 10 * total / (words + 10), float(matched > 0)])

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features @ self.coefficients))))))


#: Without labels: clauses that weigh about 0.1 for each word, or more, are toxic.
UNLABELLED = np.array([-4.0, 1.0, 0.5, 0.0, -0.5, 3.0, 1.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Coefficients by Newton's method; the first column is the constant, which isn't shrunk."""
    shrink = ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """text, toxic of at most per_class texts of each class, the first by hashes. Ids are chosen first, then rows, both without moving texts."""
    ids = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    first = lambda df: df.filter("toxic = 1").orderBy("h", "doc_id").limit(per_class).unionByName(df.filter("toxic = 0").orderBy("h", "doc_id").limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(first(ids).drop("h")), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = first(rows.select("doc_id", "h", "toxic").distinct())
    return rows.select("doc_id", "h", "text").join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def onset_counts(sample: DataFrame) -> DataFrame:
    """onset, t, c: how many toxic and clean texts hold it; tt, tc: in how many different words of them, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: tuple[Counter, Counter] = Counter(), Counter()
        types: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words: set[str] = set()
                for _, piece in pieces(text.as_py()):
                    words.update(WORD.findall(piece.lower()))
                held = Counter(x for w in words for x in onsets(w))
                texts[toxic].update(held.keys())
                types[toxic].update(held)
        for toxic in (0, 1):
            for a in range(0, len(keys := list(texts[toxic])), 100_000):
                part = keys[a : a + 100_000]
                n, k = pa.array([texts[toxic][x] for x in part], pa.int64()), pa.array([types[toxic][x] for x in part], pa.int64())
                none = pa.array(np.zeros(len(part), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *((n, none, k, none) if toxic else (none, n, none, k))], names=["onset", "t", "c", "tt", "tc"])

    parts = sample.mapInArrow(lean(run), "onset string, t long, c long, tt long, tc long")
    return parts.groupBy("onset").agg(*(F.sum(c).alias(c) for c in ("t", "c", "tt", "tc")))


def learn(sample: DataFrame) -> Lexicon:
    """Onsets beyond chance, by a likelihood ratio over different words; at most MOST_ONSETS reach the driver."""
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, 1, 1)
    counts = onset_counts(sample)
    counts = counts.persist()  # read twice; worked out again where executors are lost
    whole = counts.agg(F.sum("tt").alias("a"), F.sum("tc").alias("b"), F.count_if(F.col("t") >= LEAST_TEXTS).alias("m")).first()
    a, b = float(whole.a or 1), float(whole.b or 1)
    k, n = F.col("tt"), F.col("tt") + F.col("tc")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (n * F.lit(share)))).otherwise(0.0)
    g = 2 * (part(k, a / (a + b)) + part(F.col("tc"), b / (a + b)))
    lift: Column = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    found = counts.withColumns({"g": g, "lift": lift}).filter((F.col("t") >= LEAST_TEXTS) & (F.col("lift") >= LIFT) & (F.col("g") >= 2 * math.log(max(2, whole.m)) + 4))
    kept = found.orderBy(F.desc("g"), "onset").limit(MOST_ONSETS).collect()
    listed = [w for kind in "ih" for w in WORDS[kind].split()]
    common = {r.onset[:-1] for r in counts.filter(F.col("onset").isin([w + "$" for w in listed]) & (lift < 1) & (F.col("c") > 0.01 * clean)).collect()}
    counts.unpersist()
    return Lexicon({r.onset: (r.t, r.c) for r in kept}, toxic, clean, common)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled(docs, labels, per_class).persist()
    lexicon = learn(sample)
    model = Model(lexicon, UNLABELLED)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            y = batch.column(1).to_pylist()
            x = [m.read(t.as_py(), label).tolist() for t, label in zip(batch.column(0), y)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["x", "y"])

    got = sample.mapInArrow(lean(run), "x array<double>, y int").collect()  # a few numbers for each of at most 2 * PER_CLASS texts
    sample.unpersist()
    got.sort()
    y = np.array([r.y for r in got], float)
    if len(set(y)) == 2:
        model = Model(lexicon, logistic(np.array([r.x for r in got]), y))
    lexicon.known = {}
    return model


def score(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    """The columns of `keep`, score, predicted (1 from THRESHOLD on) and clauses (start, length, matched, weight of matched clauses) of each row."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    names = rows.columns[:-1]
    kind = "array<struct<start:bigint,length:bigint,matched:string,weight:double>>"
    schema = rows.drop("__text").withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int"), "clauses": F.lit(None).cast(kind)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ONSETS onsets
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("matched", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(a, BATCH_DOCS)
                scores, clauses = [], []
                for text in part.column(len(names)):
                    spans: list = []
                    scores.append(m.score(m.read(text.as_py(), None, spans)))
                    clauses.append([dict(zip(("start", "length", "matched", "weight"), s)) for s in spans])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(clauses, span)], names=[*names, *OWN])

    return rows.mapInArrow(lean(run), schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(3) == 1, F.lit(False)))
    labels = table(spark, sf_dir, "labels").filter(crc_mod(3) != 1)
    return score(docs, fit(docs, labels), ["doc_id", "held_out"]).drop("clauses")
