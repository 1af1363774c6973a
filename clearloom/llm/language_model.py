"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds the words (their 64-bit hashes, sorted; a word's id is its place). Level k > 1 holds the k-grams as children of their first k-1 words: a monotone pointer per parent, and within the parent's range the last word, written relative to its context: as its place among the children of the words between, so numbers are small. Both sequences are Elias-Fano coded; a child is found by a successor search for its number, moved to its parent's range. Probabilities (interpolated absolute discounting) and back-off weights are quantised to 8 bits. A level is split into shards by ranges of parents, a few files each in the shared folder, written by the tasks that build them and memory-mapped by those that score, so a model may exceed a worker's memory.

Counts are gathered from every training text, level by level; none is left out, however rare.

Tokens: A-Z lower-cased, split at ASCII white space, then one end per text. Nulls: a null text is an empty one (the end alone); null doc_ids are as any other value. Without training rows every token has the log10 probability UNTRAINED. An empty table gives an empty result. Repeated rows count and are scored each. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import array_files
from .common import clean_up, crc_mod, discard, lean, remove, shared_dir, slices, stage, table, text_buffers, word_hashes
from .elias_fano import EliasFano

ORDER = 3
#: Bytes of text whose n-grams are counted together before they are handed on.
GATHER = 8 << 20
#: Occurrences of the parents of a shard, about; words of a shard of the first level. Shards of one level at most: beyond that they grow with the input.
SHARD, WORDS, MOST_SHARDS = 1_500_000, 1_000_000, 200_000
#: The log10 probability of any token without a training text.
UNTRAINED = -6.0
#: The end of a text, as a word.
END = np.uint64(0x9D39247E33776D41)
_open: dict[str, "Model"] = {}


def token_stream(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each followed by END, and the text each belongs to."""
    words, docs = [], []
    for i, j in slices(offsets):
        w, d = word_hashes(offsets[i : j + 1], raw[offsets[i] : offsets[j]])
        words.append(w)
        docs.append(d + i)
    n = len(offsets) - 1
    w, d = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*docs, np.zeros(0, np.int64)])
    out, of = np.empty(len(w) + n, np.uint64), np.empty(len(w) + n, np.int64)
    ends = np.cumsum(np.bincount(d, minlength=n)) + np.arange(n)
    place = np.arange(len(w)) + d  # one END for each text before
    out[place], of[place] = w, d
    out[ends], of[ends] = END, np.arange(n)
    return out, of


def gathered(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to at most GATHER bytes of text, with their tokens."""
    for batch in batches:
        offsets, raw = text_buffers(batch.column(column))
        for i, j in slices(offsets, GATHER):
            part = offsets[i : j + 1] - offsets[i]
            yield batch.slice(i, j - i), *token_stream(part, raw[offsets[i] : offsets[j]])


class Shard:
    def __init__(self, uri: str, level: int):
        self.uri, self.level, self.arrays = uri, level, array_files.read(uri)
        arrays = self.arrays
        if level > 1:
            arrays |= array_files.read(f"{uri}.prob")
            self.pointers, self.nodes, self.lam, self.low = EliasFano.of(arrays, "pointers"), EliasFano.of(arrays, "nodes"), arrays["lam"], int(arrays["low"][0])
        self.prob = arrays["prob"]
        self.scale = arrays["scale"]

    def counts(self) -> np.ndarray:
        if "count" not in self.arrays:
            self.arrays |= array_files.read(f"{self.uri}.counts")
        return self.arrays["count"]

    def log_prob(self, i: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.prob[i]


class Model:
    """levels[k - 1]: shards, first parent (or hash) and first index of each."""

    def __init__(self, levels: list[list[tuple[str, int, int]]], total: int, vocabulary: int, log_unknown: float):
        self.levels, self.total, self.vocabulary, self.log_unknown = levels, total, vocabulary, log_unknown
        self._open: dict[tuple[int, int], Shard] = {}
        self.first = [np.array([low for _, low, _ in level], np.uint64 if k == 1 else np.int64) for k, level in enumerate(levels, 1)]
        self.base = [np.array([b for _, _, b in level], np.int64) for level in levels]

    def shard(self, level: int, s: int) -> Shard:
        """Opened when it is first wanted."""
        if (level, s) not in self._open:
            self._open[level, s] = Shard(self.levels[level - 1][s][0], level)
        return self._open[level, s]

    def _spread(self, level: int, keys: np.ndarray):
        """Shards of sorted keys: (shard, from, to)."""
        cuts = np.searchsorted(keys, self.first[level - 1])
        ends = [*cuts[1:], len(keys)]
        for s, (a, b) in enumerate(zip(cuts, ends)):
            if a < b:
                yield s, int(a), int(b)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        for s, a, b in self._spread(1, hashes):
            have = self.shard(1, s).arrays["words"]
            i = np.searchsorted(have, hashes[a:b])
            ok = have[np.minimum(i, len(have) - 1)] == hashes[a:b]
            out[a:b][ok] = i[ok] + self.base[0][s]
        return out

    def counts(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Training counts of ascending ids. Above level 1 they lie in files of their own, which scoring doesn't read."""
        return self._by_index(level, ids, lambda shard, i: shard.counts()[i])

    def log_prob(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Of ascending ids."""
        return self._by_index(level, ids, lambda shard, i: shard.log_prob(i))

    def _by_index(self, level: int, ids: np.ndarray, f) -> np.ndarray:
        out = np.zeros(len(ids), np.float64)
        cuts = np.searchsorted(ids, self.base[level - 1])
        for s, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            if a < b:
                out[a:b] = f(self.shard(level, s), ids[a:b] - self.base[level - 1][s])
        return out

    def begin(self, level: int, parents: np.ndarray) -> np.ndarray:
        """First index of the children, at `level`, of ascending parents (of those without any, where they would be)."""
        out = np.zeros(len(parents), np.int64)
        for s, a, b in self._spread(level, parents):
            shard = self.shard(level, s)
            out[a:b] = shard.pointers.access(np.minimum(parents[a:b] - shard.low, shard.pointers.n - 1)) + self.base[level - 1][s]
        return out

    def siblings(self, level: int, ids: np.ndarray) -> np.ndarray:
        """First index, at `level`, of the children of the parent of each of ascending ids."""

        def first(shard: Shard, i: np.ndarray) -> np.ndarray:
            return shard.pointers.access(shard.pointers.successor(i + 1) - 1) - i

        return self._by_index(level, ids, first).astype(np.int64) + ids

    def find(self, level: int, parents: np.ndarray, rel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted parents: index of the child with that number (or -1), and the log of the parent's back-off weight."""
        out, lam = np.full(len(parents), -1, np.int64), np.zeros(len(parents))
        for s, a, b in self._spread(level, parents):
            shard = self.shard(level, s)
            p = parents[a:b] - shard.low
            new = np.ones(len(p), bool)
            new[1:] = p[1:] != p[:-1]
            first = np.flatnonzero(new)
            of = np.cumsum(new) - 1
            own = p[first]  # each parent once
            inside = own < shard.pointers.n - 1
            own = np.where(inside, own, 0)
            begin = shard.pointers.access(own)
            end = shard.pointers.access(own + 1)
            some = inside & (begin < end)
            base = np.zeros(len(own), np.int64)
            late = np.flatnonzero(some & (begin > 0))
            base[late] = shard.nodes.access(begin[late] - 1) + 1
            weight = np.where(inside, shard.arrays["lam_scale"][0] + shard.arrays["lam_scale"][1] * shard.lam[own], 0.0)
            lam[a:b] = weight[of]
            at = np.flatnonzero(some[of] & (rel[a:b] >= 0))
            # A number beyond the parent's last one would meet the next parent's.
            i = shard.nodes.find(base[of[at]] + rel[a:b][at])
            ok = (i >= 0) & (i < end[of[at]])
            out[a + at[ok]] = i[ok] + self.base[level - 1][s]
        return out, lam

    def indices(self, words: np.ndarray, docs: np.ndarray, upto: int, probs: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(For each level, the index of the n-gram that ends at each token, -1: none; with probs, the training count of each token and the log10 of its probability.) Distinct n-grams are looked up once, in their order."""
        uniq, inverse = np.unique(words, return_inverse=True)
        ids = self.words(uniq)
        index, known = [ids[inverse]], ids >= 0
        counts, p = np.zeros(0, np.int64), np.zeros(0)
        if probs:
            n, low = np.zeros(len(uniq), np.int64), np.full(len(uniq), self.log_unknown)
            n[known], low[known] = self.counts(1, ids[known]), self.log_prob(1, ids[known])
            counts, p = n[inverse], low[inverse]
        if upto > 2 and self.levels[1]:
            own = np.zeros(len(uniq), np.int64)
            own[known] = self.begin(2, ids[known])
            begins = own[inverse]
        for level in range(2, upto + 1):
            out = np.full(len(words), -1, np.int64)
            before = here = index[-1]
            at = np.flatnonzero((docs[1:] == docs[:-1]) & (before[:-1] >= 0)) + 1  # a context exists
            if self.levels[level - 1] and len(at):
                parent = before[at - 1]
                rel = here[at].copy()
                known = rel >= 0
                if level == 3:  # relative to the children of the word between
                    rel -= begins[at - 1]
                elif level > 3 and known.any():  # of the words between
                    between = index[level - 3][at[known] - 1]
                    ctx, inv = np.unique(between, return_inverse=True)
                    rel[known] -= self.begin(level - 1, ctx)[inv]
                rel[~known] = -1
                span = int(rel.max(initial=0)) + 2
                if int(parent.max()) < (1 << 62) // span:
                    key, inv = np.unique(parent * span + (rel + 1), return_inverse=True)
                    par, r = key // span, key % span - 1
                else:
                    order = np.lexsort((rel, parent))
                    par, r, inv = parent[order], rel[order], np.argsort(order)
                i, lam = self.find(level, par, r)
                out[at] = i[inv]
                if probs:
                    found = np.flatnonzero(i >= 0)
                    value = lam.copy()
                    value[found] = self.log_prob(level, i[found])
                    hit = (i >= 0)[inv]
                    p[at] = np.where(hit, 0.0, p[at]) + value[inv]
            index.append(out)
        return index, counts, p

    def score(self, words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token: training count, and log10 probability."""
        return self.indices(words, docs, len(self.levels), True)[1:]


def opened(spec: tuple) -> Model:
    """One per process; another model takes the place of the last one."""
    key = repr(spec)
    if key not in _open:
        _open.clear()
        _open[key] = Model(*spec)
    return _open[key]


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 255 or 1.0
    return np.rint((x - lo) / step).astype(np.uint8), np.array([lo, step])


def discount(once: int, twice: int) -> float:
    """Of absolute discounting, from the numbers of n-grams that occur once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


META = "shard int, low long, size long, total long, once long, twice long, cuts array<long>"


def meta(shard: int, low: int, counts: np.ndarray, size: int) -> pa.RecordBatch:
    """What the driver needs to know of a shard: a row. cuts: places from which its n-grams, as parents, occur about `size` times before the next."""
    upto = np.cumsum(counts)
    cuts = np.unique(np.searchsorted(upto, np.arange(0, int(upto[-1]), size), side="right"))
    row = ([shard], [int(low)], [len(counts)], [int(upto[-1])], [int((counts == 1).sum())], [int((counts == 2).sum())], [cuts.tolist()])
    kinds = (pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], names=["shard", "low", "size", "total", "once", "twice", "cuts"])


def packed_run(parent: np.ndarray, suffix: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted n-grams with their counts, as differences in as few bytes as hold them, by byte planes, compressed."""
    cols = (np.diff(parent, prepend=parent[:1]), suffix - suffix.min(), n)
    kinds = [np.min_scalar_type(int(c.max())) for c in cols]
    planes = b"".join(np.ascontiguousarray(c.astype(k).view(np.uint8).reshape(len(c), -1).T).tobytes() for c, k in zip(cols, kinds))
    head = np.array([len(n), parent[0], suffix.min(), *(k.itemsize for k in kinds)], "<i8").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked_run(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, parent, suffix, *widths = np.frombuffer(run, "<i8", 6).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(run[48:], m * sum(widths)), np.uint8)
    out, at = [], 0
    for w in widths:
        out.append(np.ascontiguousarray(planes[at : at + m * w].reshape(w, m).T).view(f"<u{w}").ravel().astype(np.int64))
        at += m * w
    return np.cumsum(out[0]) + parent, out[1] + suffix, out[2]


def counted(parent: np.ndarray, suffix: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, suffix), sorted, with the sums of n (or how often each occurs)."""
    if not len(parent):
        return parent, suffix, np.zeros(0, np.int64)
    rows, low, least = len(parent), parent.min(), suffix.min()
    wide = int(suffix.max() - least).bit_length()
    if int(parent.max() - low).bit_length() + wide <= 63:
        key = (parent - low) << wide | (suffix - least)
        if n is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        head = key[first]
        parent, suffix = (head >> wide) + low, (head & ((1 << wide) - 1)) + least
    else:
        order = np.lexsort((suffix, parent))
        p, s = parent[order], suffix[order]
        first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])]))
        parent, suffix, n = p[first], s[first], None if n is None else n[order]
    return parent, suffix, np.diff(first, append=rows) if n is None else np.add.reduceat(n, first)


def learned(train: DataFrame, order: int = ORDER) -> tuple:
    """Counts, builds and writes the model of the texts in `train` (column text). Returns what opened() takes.

    A level's n-grams are counted within about GATHER bytes of text, and go as packed runs to the shard of their parent; shards are cut so that their parents occur about SHARD times together. A task merges the runs of one shard and writes its structure. When all are there, their numbers of n-grams that occur once and twice give the discount, and another pass over the shards writes the probabilities.
    """
    spark = train.sparkSession
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    texts = train.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, _docs in gathered(batches):
            w, n = np.unique(words, return_counts=True)
            # range partitions follow signed order: shift the hash so that it is the unsigned one
            yield pa.RecordBatch.from_arrays([pa.array((w ^ np.uint64(1 << 63)).view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

    counts = stage(texts.mapInArrow(lean(count_words), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-words")
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    total, size = sums.total or 0, sums["size"]
    size_of_shard = max(SHARD, total // MOST_SHARDS)
    d = discount(sums.once, sums.twice)

    def make_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
        if got:
            w, n = (np.concatenate(c) for c in zip(*got))
            prob, scale = quantised(np.log10((n - d) / total))
            shard = TaskContext.get().partitionId()
            array_files.write(f"{folder}/1-{shard}", {"words": w.view(np.uint64) ^ np.uint64(1 << 63), "count": n.astype(np.int64), "prob": prob, "scale": scale})
            yield meta(shard, w[0], n, size_of_shard)

    parts = max(1, -(-size // max(WORDS, size // MOST_SHARDS)))
    made = counts.repartitionByRange(parts, "w").sortWithinPartitions("w").mapInArrow(lean(make_words), META).collect()  # one row for each shard
    discard(counts)

    def level_of(made: list, level: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
        """(shards: uri, first parent or hash, first index), and the cuts for the shards of the next level, as indices."""
        base, out, cuts = 0, [], []
        for r in sorted(made, key=lambda r: r.shard):
            out.append((f"{folder}/{level}-{r.shard}", r.low + (1 << 63) if level == 1 else r.low, base))
            cuts += [base + c for c in r.cuts]
            base += r["size"]
        return out, np.array(cuts, np.int64)

    first, cuts = level_of(made, 1)
    levels = [first]
    log_unknown = float(np.log10(d * size / total)) if total else UNTRAINED
    for level in range(2, order + 1):
        if not len(cuts):
            break
        below = (list(levels), total, size, log_unknown)
        shared_cuts = spark.sparkContext.broadcast(cuts)  # one number for each shard, MOST_SHARDS at most and a few

        def count_grams(batches: Iterator[pa.RecordBatch], level=level, below=below, shared_cuts=shared_cuts) -> Iterator[pa.RecordBatch]:
            model = opened(below)
            for _, words, docs in gathered(batches):
                here = model.indices(words, docs, level - 1)[0][-1]
                at = np.flatnonzero((docs[1:] == docs[:-1]) & (here[1:] >= 0) & (here[:-1] >= 0)) + 1
                parent, suffix, n = counted(here[at - 1], here[at])
                if len(parent):
                    ends = np.append(np.searchsorted(parent, shared_cuts.value[1:]), len(parent))
                    begins = np.append(0, ends[:-1])
                    some = np.flatnonzero(begins < ends)
                    runs = [packed_run(parent[a:b], suffix[a:b], n[a:b]) for a, b in zip(begins[some], ends[some])]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(runs, pa.binary())], names=["shard", "run"])

        def merge(batches: Iterator[pa.RecordBatch], level=level, below=below) -> Iterator[pa.RecordBatch]:
            runs: dict[int, list] = {}
            for b in batches:
                for shard, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    runs.setdefault(shard, []).append(run)
            model = opened(below)
            for shard in sorted(runs):
                yield meta(shard, *merged(model, level, runs.pop(shard), f"{folder}/{level}-{shard}", f"{folder}/{level}-tmp/{shard}"), size_of_shard)

        rows = texts.mapInArrow(lean(count_grams), "shard int, run binary")
        made = rows.repartitionById(len(cuts), F.col("shard")).mapInArrow(lean(merge), META).collect()  # one row for each shard
        del rows
        clean_up(spark)
        d = discount(sum(r.once for r in made), sum(r.twice for r in made))

        def finish(batches: Iterator[pa.RecordBatch], level=level, d=d) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column(0).to_pylist():
                    weighed(f"{folder}/{level}-{shard}", f"{folder}/{level}-tmp/{shard}", d)
                yield b

        shards = spark.createDataFrame([(r.shard,) for r in made], "shard int")
        if made:
            shards.repartition(len(made)).mapInArrow(lean(finish), "shard int").count()
            remove(spark, f"{folder}/{level}-tmp")
        shards, cuts = level_of(made, level)
        if not shards:
            break
        levels.append(shards)
    return (levels, total, size, log_unknown)


def merged(model: Model, level: int, runs: list[bytes], uri: str, temp: str) -> tuple[int, np.ndarray]:
    """Writes a shard's structure and counts, and to temp what its probabilities are made of. Returns its first parent and the counts."""
    parent, suffix, n = counted(*(np.concatenate(c) for c in zip(*map(unpacked_run, runs))))
    low = int(parent[0])
    local = parent - low
    begin = np.searchsorted(local, np.arange(local[-1] + 2))
    heads = np.flatnonzero(np.diff(begin))
    rel = suffix.copy()
    if level > 2:  # the children of a parent have one context in common, and so one range at the level below
        some = suffix[begin[heads]]
        order = np.argsort(some)
        start = np.empty(len(some), np.int64)
        start[order] = model.siblings(level - 1, some[order])
        rel -= np.repeat(start, np.diff(begin)[heads])
    last = rel[begin[heads + 1] - 1] + 1
    shift = np.zeros(len(begin) - 1, np.int64)
    shift[heads] = np.concatenate([[0], np.cumsum(last)[:-1]])
    array_files.write(uri, EliasFano.build(begin).arrays("pointers") | EliasFano.build(rel + shift[local]).arrays("nodes") | {"low": np.array([low])})
    array_files.write(f"{uri}.counts", {"count": n.astype(np.min_scalar_type(int(n.max())))})
    order = np.argsort(suffix)
    lower = np.empty(len(suffix), np.float16)  # finer than the codes it is read from
    lower[order] = model.log_prob(level - 1, suffix[order])
    array_files.write(temp, {"times": model.counts(level - 1, heads + low), "lower": lower})
    return low, n


def weighed(uri: str, temp: str, d: float) -> None:
    """Writes a shard's probabilities and back-off weights."""
    arrays, n, of = array_files.read(uri), array_files.read(f"{uri}.counts")["count"].astype(np.int64), array_files.read(temp)
    begin = EliasFano.of(arrays, "pointers").all()
    width = np.diff(begin)
    heads = np.flatnonzero(width)
    share = (n - d) / np.repeat(of["times"], width[heads])
    lam = np.ones(len(width))
    lam[heads] = np.maximum(1 - np.add.reduceat(share, begin[heads]), 1e-9)
    prob, scale = quantised(np.log10(np.minimum(share + np.repeat(lam, width) * 10.0 ** of["lower"].astype(np.float64), 1.0)))
    code, lam_scale = quantised(np.log10(lam))
    array_files.write(f"{uri}.prob", {"prob": prob, "scale": scale, "lam": code, "lam_scale": lam_scale})


def scored(docs: DataFrame, spec: tuple) -> DataFrame:
    """From doc_id, held_out, text: token numbers, base score and score of each text."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(spec)
        for part, words, of in gathered(batches, 2):
            n = len(part)
            c, p = model.score(words, of)
            base = np.log10((c + 1) / (model.total + model.vocabulary + 1))
            sums = lambda x: np.bincount(of, x, n)
            cols = [np.bincount(of, minlength=n).astype(np.int64), sums(c > 0).astype(np.int64), np.full(n, model.total, np.int64), sums(base), sums(p)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(lean(run), schema)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_mod(7) == 2, F.lit(False)))
    return scored(docs, learned(docs.filter(~F.col("held_out"))))
