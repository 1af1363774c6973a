"""Language ID by string kernels: blended-spectrum presence kernels (byte n-grams of lengths 1 to 3), Nyström landmarks and one-versus-rest kernel ridge regression; texts are scored by batched matrix products.

The kernel of two texts is the number of n-grams both hold, over the root of the product of both numbers, in the space of the n-grams of the landmarks. The model is fitted on a bounded sample: at most PER_LANG labelled rows of each language, the first by a hash of id and text; LANDMARKS of them are landmarks. Every text is scored whole.

Margins tell languages apart but sum to about 2 less their number, so they can't tell a text of none of them. What does is coverage: the share of a text's trigrams that the sample holds. On request, texts with less than FAMILIAR times what nearly all labelled texts reach without their own trigrams are `und` too.

Nulls: a text that is null or has no letter is `und` with score 0. Rows with a null lang are not learned from. Without any labelled row all are `und`. Repeated rows and null doc_ids pass through row by row. Of tied languages the first by name is chosen. An empty table gives an empty result. predict() keeps the columns that it is asked for, but for those with names of its own (lang_pred, score, margin).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, lean, table

PER_LANG = 400
LANDMARKS = 128
RIDGE = 1e-3
#: Margins times this go into the softmax.
SHARPNESS = 4.0
BATCH_DOCS = 128
#: Least coverage of a text, as a part of the coverage that all but this share of the labelled texts reach.
FAMILIAR, OUTLIERS = 0.6, 0.01
LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.arange(256, dtype=np.uint32)
_KEEP[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams, n from 1 to 3, of the lower-cased bytes; ASCII that is no letter counts as a space. Repeats stay."""
    b = _KEEP[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    return np.concatenate([b, two, three])  # bytes 0 don't begin an n-gram, so lengths don't clash


def trigrams(text: str) -> np.ndarray:
    """The trigrams among grams(text) that aren't spaces alone."""
    g = grams(text)
    g = g[len(g) * 2 // 3 + 1 :]  # n bytes: n, n - 1 and n - 2 codes
    return g[g != 0x202020]


class Model:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        by_lang = {k: [i for i, x in enumerate(langs) if x == k] for k in self.langs}
        turn = sorted((n, k, i) for k, rows in by_lang.items() for n, i in enumerate(rows))
        chosen = [i for _, _, i in turn[:landmarks]]
        sets = [np.unique(grams(texts[i])) for i in chosen]
        self.codes = np.unique(np.concatenate(sets))
        self.marks = np.zeros((len(sets), len(self.codes)), np.float32)
        for row, s in zip(self.marks, sets):
            row[np.searchsorted(self.codes, s)] = 1 / np.sqrt(len(s))
        k_mm = (self.marks @ self.marks.T).astype(np.float64)
        value, vector = np.linalg.eigh(k_mm)
        keep = value > 1e-6 * value.max()
        self.root = vector[:, keep] / np.sqrt(value[keep])  # kernel rows times this are the features
        phi = np.concatenate([self.kernel(texts[i : i + BATCH_DOCS]) for i in range(0, len(texts), BATCH_DOCS)]) @ self.root
        phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
        target = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        weight = np.array([len(langs) / (len(self.langs) * len(by_lang[x])) for x in langs])[:, None]
        gram = phi.T @ (weight * phi) + ridge * len(phi) * np.eye(phi.shape[1]) / 10
        self.solved = np.linalg.solve(gram, phi.T @ (weight * target))
        own = [trigrams(t) for t in texts]
        self.known, holders = np.unique(np.concatenate([np.unique(x) for x in own]), return_counts=True)
        shared = self.known[holders > 1]
        self.floor = FAMILIAR * float(np.quantile([np.isin(x, shared).mean() if len(x) else 1.0 for x in own], OUTLIERS))

    def index(self) -> np.ndarray:
        """Place of each code in the landmarks' space, plus 1; 0 if it has none."""
        if not hasattr(self, "_index"):
            kind = np.uint16 if len(self.codes) < 65_535 else np.uint32
            self._index = np.zeros(1 << 24, kind)
            self._index[self.codes] = np.arange(1, len(self.codes) + 1)
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_index", "_is_known")}

    def coverage(self, text: str) -> float:
        """Share of the text's trigrams that the labelled sample holds; 1 if it has none."""
        if not hasattr(self, "_is_known"):
            self._is_known = np.zeros(1 << 24, bool)
            self._is_known[self.known] = True
        x = trigrams(text)
        return float(self._is_known[x].mean()) if len(x) else 1.0

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel of each text with each landmark."""
        index, x = self.index(), np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in zip(x, texts):
            row[index[grams(text)]] = 1
        x = x[:, 1:]
        size = x.sum(1)
        return (x @ self.marks.T).astype(np.float64) / np.sqrt(np.maximum(size, 1))[:, None]

    def margins(self, texts: list[str]) -> np.ndarray:
        return (self.kernel(texts) @ self.root) @ self.solved[:-1] + self.solved[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (softmax of the margins) and best margin of each text."""
        lang, score, margin = ["und"] * len(texts), [0.0] * len(texts), [-1.0] * len(texts)
        live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        for at in range(0, len(live), BATCH_DOCS):
            part = live[at : at + BATCH_DOCS]
            m = self.margins([texts[i] for i in part])
            best = m.argmax(1)
            p = np.exp(SHARPNESS * (m - m.max(1, keepdims=True)))
            p = p.max(1) / p.sum(1)
            for i, b, s, row in zip(part, best.tolist(), p.tolist(), m):
                lang[i], score[i], margin[i] = self.langs[b], s, float(row[b])
        return lang, score, margin


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """From doc_id, text, lang: a model, or None without rows. The sample is found on hashes; only its texts reach the driver."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    first = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h"))
    then = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    small = rows.select("lang", "h").withColumn("r", first).filter(F.col("r") <= per_lang).withColumn("r", then).filter(F.col("r") <= per_lang).select("lang", "h")
    got = rows.join(F.broadcast(small.distinct()), ["lang", "h"], "left_semi").select("h", "lang", "text").dropDuplicates(["h", "lang"]).collect()  # at most per_lang rows of each language
    got.sort(key=lambda r: (r.h, r.lang))
    return Model([r.text for r in got], [r.lang for r in got]) if got else None


#: Columns that predict() adds.
OWN = ("lang_pred", "score", "margin")


def predict(docs: DataFrame, model: Model | None, keep: list[Column | str], reject: bool = False) -> DataFrame:
    """The columns of `keep`, lang_pred, score and margin of each row. With reject, texts of less coverage than the model's floor are `und`, with score 0."""
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col("text").alias("__text")).drop(*OWN)
    names = rows.columns[:-1]
    schema = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}).schema
    shared = spark.sparkContext.broadcast(model)  # landmarks x n-grams: bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        try:
            yield from predicted(m, batches)
        finally:
            if m:  # tables that are quickly made again, but that the worker would keep
                m.__dict__.pop("_index", None)
                m.__dict__.pop("_is_known", None)

    def predicted(m: Model | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            out = m.predict(texts) if m else (["und"] * len(texts), [0.0] * len(texts), [-1.0] * len(texts))
            for i in [i for i, t in enumerate(texts) if reject and out[0][i] != "und" and m.coverage(t) < m.floor]:
                out[0][i], out[1][i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64())], names=[*names, "lang_pred", "score", "margin"])

    return rows.mapInArrow(lean(run), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(5) == 0, F.lit(False)))
    model = fit(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])
