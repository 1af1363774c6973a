"""Removal of repeated byte strings by suffix sorting in two stages.

Every start of a LENGTH-byte string has a key that depends on that string alone: the least hash of the GRAM-byte strings in it. Equal strings have equal keys, so starts are grouped by key, and a suffix array of each group's bytes finds the repeats. Neighbouring starts with one key form a run; equal runs are one (with a number of occurrences), and runs whose key occurs in one run of the corpus, and there at one place, are dropped before their bytes are fetched; runs of a key whose runs all occur more than once are repeated throughout, so theirs aren't fetched either. All three are exact.

In a group, only the suffixes that are smaller than their successors are sorted directly; the others are induced by one scan over the buckets of first bytes, each placing its predecessors. Then the common prefixes of neighbours in the suffix array are compared: a start is repeated if it shares LENGTH bytes with a neighbour, or if its run occurs more than once.

Passages are found alike: each word (between ASCII white space, as it is written) becomes CODE bytes of its hash, and repeated strings of CODE bytes for each of the passage's words are looked for in those. Of what they cover, the whole words and what lies between them go.

A key with more than GROUP distinct runs is not sorted in one task: its starts are dealt by two 64-bit hashes of their LENGTH bytes and counted, which decides the same.

Texts are UTF-8 bytes; matches don't cross documents. Nulls: a null text is an empty one; null and repeated doc_ids are as any other rows. Equal texts of LENGTH bytes or more remove each other wholly. An empty table gives an empty result. Columns of the input are kept; those that the operator adds replace columns with their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, is_few, lean, mix, powers, prefix_hash, signed, slices, span_hash, stage, table, text_buffers, where

LENGTH = 400
GRAM = 160
#: Bytes that stand for a word where passages are counted in words.
CODE = 6
#: Most starts of a run; distinct runs of a key that one task sorts; bytes sorted at once.
RUN, GROUP, BATCH = 256, 1500, 1 << 19
#: Strings whose bytes are copied to be compared, at a time.
CHUNK = 8192
RUNS = "t long, size int, h long, r long, p int, len int, own boolean"


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has a whole window."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(offsets: np.ndarray, raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(doc, h, r, p, len, own) of all runs of the documents given by offsets into raw; own: the run may repeat itself, as its least hash lies in it twice."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    has = np.flatnonzero(sizes >= length)
    if not len(has) or len(raw) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    prefix = prefix_hash(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    key = least_in_windows(grams, length - gram + 1)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[offsets[has]] += 1
    edge[offsets[has + 1] - length + 1] -= 1
    live = np.cumsum(edge[: len(key)], dtype=np.int8) > 0
    begin = live.copy()
    begin[1:] &= ~live[:-1] | (key[1:] != key[:-1])
    begin[offsets[has]] = True
    start = np.flatnonzero(begin)
    stop = np.append(start[1:], len(key))
    doc = np.searchsorted(offsets, start, side="right") - 1
    stop = np.minimum(stop, offsets[doc + 1] - length + 1)
    pieces = -(-(stop - start) // RUN)
    of = np.repeat(np.arange(len(start)), pieces)
    step = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = start[of] + step * RUN
    hi = np.minimum(lo + RUN, stop[of])
    doc = doc[of]
    h = key[start[of]]
    windows, own = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1), np.zeros(len(lo), bool)
    for i in range(0, len(lo), 1024):
        part = slice(i, i + 1024)
        left = (windows[lo[part]] == h[part, None]).argmax(1) + lo[part]
        right = length - gram - (windows[hi[part] - 1] == h[part, None])[:, ::-1].argmax(1) + hi[part] - 1
        own[part] = left != right
    return doc, h, span_hash(prefix, lo, hi + length - 1), lo - offsets[doc], hi - lo, own


def found_runs(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """t, size, text -> RUNS."""
    for batch in batches:
        offsets, raw = text_buffers(batch.column(2))
        for i, j in slices(offsets):
            part = offsets[i : j + 1] - offsets[i]
            doc, h, r, p, n, own = runs_of(part, raw[offsets[i] : offsets[j]], length, length * GRAM // LENGTH)
            at = pa.array(doc + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(signed(h)), pa.array(signed(r)), pa.array(p.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)], names=["t", "size", "h", "r", "p", "len", "own"])


def sorted_strings(raw: bytes, begins: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Order of the strings raw[begin:end], none longer than depth: by 8 bytes at a time, until at most CHUNK are alike, whose bytes are then copied and compared."""
    words = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.lib.stride_tricks.as_strided(words[:8].view(">u8"), (len(raw) + 1,), (1,))
    out: list[np.ndarray] = []
    todo = [(np.arange(len(begins)), 0)]
    while todo:
        own, at = todo.pop()
        if len(own) <= CHUNK:
            keys = [raw[a:b] for a, b in zip(begins[own].tolist(), ends[own].tolist())]
            out.append(own[sorted(range(len(keys)), key=keys.__getitem__)])
            continue
        left = ends[own] - begins[own] - at
        if at >= depth:  # equal but for ends: shorter ones first
            out.append(own[np.argsort(left, kind="stable")])
            continue
        key = words[np.minimum(begins[own] + at, len(raw))].astype(np.uint64)
        spare = np.uint64(8) * np.clip(8 - left, 0, 8).astype(np.uint64)
        key = np.where(left <= 0, np.uint64(0), key >> np.minimum(spare, np.uint64(63)) << np.minimum(spare, np.uint64(63)))
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(own))
        parts, i = [], 0
        while i < len(edges) - 1:  # stretches of whole groups, of at most CHUNK strings or one group
            j = max(int(np.searchsorted(edges, edges[i] + CHUNK, side="right")) - 1, i + 1)
            parts.append((own[edges[i] : edges[j]], at if j > i + 1 else at + 8))
            i = j
        todo += parts[::-1]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def suffix_array(raw: bytes, begins: np.ndarray, counts: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Order of the suffixes at begins[i] ... begins[i] + counts[i] - 1, each string i reaching to ends[i], up to `depth` bytes.

    Two stages: suffixes smaller than their successors are sorted directly, the others are induced. Where the bytes of a string end in equal ones, those count as smaller, so every chain of induced suffixes ends in a sorted one.
    """
    text = np.frombuffer(raw, np.uint8)
    n = len(text)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    same = np.zeros(n, bool)
    same[:-1] = text[:-1] == text[1:]
    same |= last
    less = np.zeros(n, bool)
    less[:-1] = text[:-1] < text[1:]
    less |= last
    # Equal bytes take the type of the next unequal pair of the string.
    turn = np.flatnonzero(~same | last)
    small = less[turn[np.searchsorted(turn, np.arange(n))]]
    # Positions: the starts, and what follows them up to the next sorted suffix.
    next_small = np.flatnonzero(small)
    stop = begins + counts
    reach = next_small[np.minimum(np.searchsorted(next_small, stop - 1), len(next_small) - 1)] + 1
    reach = np.minimum(np.maximum(reach, stop), ends)
    width = reach - begins
    of = np.repeat(np.arange(len(begins)), width)
    pos = begins[of] + np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
    head = np.zeros(len(pos), bool)
    head[np.cumsum(width) - width] = True
    big = ~small[pos]
    direct = np.flatnonzero(~big)
    ordered = direct[sorted_strings(raw, pos[direct], np.minimum(pos[direct] + depth, ends[of[direct]]), depth)]
    first = text[pos]
    cuts = np.searchsorted(first[ordered], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(part: np.ndarray) -> None:
        before = part[~head[part]] - 1
        before = before[big[before]]
        if len(before):
            chars = first[before]
            turn = np.argsort(chars, kind="stable")
            before, chars = before[turn], chars[turn]
            edges = np.flatnonzero(np.diff(chars)) + 1
            for group in np.split(before, edges):
                buckets[first[group[0]]].append(group)

    for c in range(256):
        i = 0
        while i < len(buckets[c]):  # grows while it is scanned
            out.append(buckets[c][i])
            induce(buckets[c][i])
            i += 1
        part = ordered[cuts[c] : cuts[c + 1]]
        if len(part):
            out.append(part)
            induce(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pos[order[pos[order] < stop[of[order]]]]


def common_prefixes(raw: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length of the common prefix, up to depth, of each suffix with the one before it in order; all have `depth` bytes."""
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), depth)
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 4096):
        j = min(i + 4096, len(order))
        near = np.flatnonzero((rows[order[i - 1 : j - 1], :8] == rows[order[i:j], :8]).all(1)) + i
        differ = rows[order[near - 1]] != rows[order[near]]
        out[near] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def repeated(parts: list[bytes], times: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each run (its bytes, its occurrences, its starts): which starts are repeated."""
    raw = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    begins = ends - [len(p) for p in parts]
    order = suffix_array(raw, begins, counts, ends, length)
    equal = common_prefixes(raw, order, length) >= length
    hit = np.zeros(len(raw), bool)
    hit[order[equal]] = True
    hit[order[np.flatnonzero(equal) - 1]] = True
    return [np.ones(n, bool) if t > 1 else hit[b : b + n] for b, n, t in zip(begins, counts, times)]


def spans_of(flags: np.ndarray) -> np.ndarray:
    """Begin and end of each stretch of set flags, flat."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge).astype(np.int32)


def sorted_groups(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """h, r, n, len, bytes in order of h -> h, r, spans: whole groups, about BATCH bytes at once."""
    rows: list[tuple] = []
    size, last = 0, None

    def out() -> pa.RecordBatch:
        flags = repeated([x[4] for x in rows], np.array([x[2] for x in rows]), np.array([x[3] for x in rows]), length)
        some = [i for i, f in enumerate(flags) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([rows[i][1] for i in some], pa.int64()), pa.array([spans_of(flags[i]) for i in some], pa.list_(pa.int32()))], names=["h", "r", "spans"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != last and size >= BATCH:
                yield out()
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[4])
    if rows:
        yield out()


def fetched(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """text, runs (h, r, n, p, len, hot) -> h, r, n, len, bytes (null where hot), and for hot ones the two hashes of each start."""
    fields = ("h", "r", "n", "len")
    for batch in batches:
        runs, of = batch.column(1).flatten(), np.repeat(np.arange(len(batch)), pa.compute.list_value_length(batch.column(1)).to_numpy())
        offsets, raw = text_buffers(batch.column(0))
        cols = {k: runs.field(k).to_numpy() for k in (*fields, "p")}
        hot = runs.field("hot").to_numpy(zero_copy_only=False)
        for at in range(0, len(of), 4096):
            part = slice(at, at + 4096)
            begin = offsets[of[part]] + cols["p"][part]
            end = begin + cols["len"][part] + length - 1
            data, one, two = [], [], []
            for a, b, is_hot in zip(begin.tolist(), end.tolist(), hot[part].tolist()):
                data.append(None if is_hot else raw[a:b].tobytes())
                if is_hot:
                    prefix = prefix_hash(raw[a:b])
                    i = np.arange(b - a - length + 1)
                    _, down = powers(len(prefix))
                    with np.errstate(over="ignore"):
                        x = (prefix[i + length] - prefix[i]) * down[i]
                        other = np.zeros(b - a + 1, np.uint64)
                        np.cumsum(mix(raw[a:b].astype(np.uint64) + np.uint64(77)) * powers(b - a)[0], out=other[1:])
                        y = (other[i + length] - other[i]) * down[i]
                    one.append(signed(mix(x)))
                    two.append(signed(mix(y ^ np.uint64(0x5555555555555555))))
                else:
                    one.append(None)
                    two.append(None)
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(cols[k][part]) for k in fields), *(pa.array(x, t) for x, t in zip((data, one, two), kinds))], names=[*fields, "bytes", "one", "two"])


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """From t, size, text: t, size, spans (begin and end of the starts of repeated strings of `length` bytes, flat; one row for each text that has any)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.select("t", "size", "text")
    runs = stage(texts.mapInArrow(lean(partial(found_runs, length=length)), RUNS), "repeats-runs")
    # Equal runs are summed before they move.
    distinct = runs.groupBy("h", "r").agg(F.count("*").alias("n"), F.max("own").alias("own"), F.min(F.struct("t", "size", "p", "len")).alias("at"))
    key = Window.partitionBy("h")
    counted = distinct.select("h", "r", "n", "at", F.sum("n").over(key).alias("all"), F.max("own").over(key).alias("own"), F.count("*").over(key).alias("kinds"), F.min("n").over(key).alias("least"))
    counted = counted.filter((F.col("all") > 1) | F.col("own"))
    wanted = stage(counted.select("h", "r", "n", "at.t", "at.size", "at.p", "at.len", (F.col("kinds") > GROUP).alias("hot"), (F.col("least") > 1).alias("sure")), "repeats-wanted")

    def read(runs: DataFrame) -> DataFrame:
        by_text = runs.groupBy("t", "size").agg(F.collect_list(F.struct("h", "r", "n", "p", "len", "hot")).alias("runs"))
        # Only texts that may hold a wanted run move, and once. Equal texts are one here: any of them holds the bytes.
        some = where(texts, runs.select("t").distinct(), "t").join(by_text, ["t", "size"]).dropDuplicates(["t", "size"])
        return some.select("text", "runs").mapInArrow(lean(partial(fetched, length=length)), "h long, r long, n long, len int, bytes binary, one array<long>, two array<long>")

    # Where each run of a key occurs more than once, every start is repeated, whatever the bytes are.
    sure = wanted.filter("sure").select("h", "r", F.array(F.lit(0), F.col("len")).alias("spans"))
    cold = read(wanted.filter("not sure and not hot")).select("h", "r", "n", "len", "bytes").repartition(4 * parts, "h").sortWithinPartitions("h", "r")
    spans = cold.mapInArrow(lean(partial(sorted_groups, length=length)), "h long, r long, spans array<int>").unionByName(sure)
    if not wanted.filter("hot and not sure").isEmpty():
        starts = read(wanted.filter("hot and not sure")).select("h", "r", "n", F.posexplode(F.arrays_zip("one", "two")).alias("i", "x")).select("h", "r", "n", "i", "x.one", "x.two")
        starts = stage(starts, "repeats-starts")
        many = starts.groupBy("one", "two").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("one", "two")
        hot = starts.join(many, ["one", "two"], "left_semi").select("h", "r", F.array(F.col("i"), F.col("i") + 1).alias("spans"))
        spans = spans.unionByName(hot.groupBy("h", "r").agg(F.flatten(F.array_sort(F.collect_list("spans"))).alias("spans")))  # at most RUN of them
    found = runs.select("t", "size", "h", "r", "p").join(stage(spans, "repeats-spans"), ["h", "r"])
    found = found.groupBy("t", "size", "p").agg(F.any_value("spans").alias("spans"))  # equal texts say the same
    return stage(found.groupBy("t", "size").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("p")))).alias("spans")), "repeats-found")


def covered(size: int, spans: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes to remove, from spans of starts."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, spans[0::2], 1)
    np.add.at(edge, spans[1::2] + length - 1, -1)
    on = np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]]))
    return np.flatnonzero(on == 1), np.flatnonzero(on == -1)


def joined_up(size: int, *ranges: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what the ranges cover together."""
    begins, ends = (np.concatenate(x) for x in zip(*ranges))
    return covered(size, np.stack([begins, ends], 1).ravel(), 1)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __text (nulls empty), and __t and __size, which stand for it."""
    clean = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    return clean.withColumns({"__t": F.xxhash64("__text"), "__size": F.octet_length("__text").cast("int")})


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[raw], [True]])))
    return edges[::2], edges[1::2]


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, size, text -> the same with CODE bytes for each word of the text."""
    for batch in batches:
        offsets, raw = text_buffers(batch.column(2))
        out = []
        for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = raw[i:j]
            out.append(span_hash(prefix_hash(own), *words_of(own)).view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["t", "size", "text"])


def covered_words(raw: np.ndarray, spans: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes to remove, from spans of starts in the codes of raw's words."""
    begins, ends = words_of(raw)
    a, b = covered(CODE * len(begins), spans, CODE * words)
    return begins[-(-a // CODE)], ends[b // CODE - 1]


def cut(docs: DataFrame, text: str = "text", as_text: bool = False, words: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, removed (begin and end of each removed stretch, flat) and kept (the remaining bytes; as_text: as a string, without characters that were cut in two). With words, repeated passages of so many words go too, however few bytes they have."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "removed", "kept")
    rows = keyed(docs, text)
    texts = rows.select(F.col("__t").alias("t"), F.col("__size").alias("size"), F.col("__text").alias("text"))
    none = F.lit(None).cast("array<int>")
    found = repeats(texts.filter(F.col("size") >= LENGTH)).select("t", "size", "spans", none.alias("words"))
    if words:
        codes = texts.filter(F.col("size") >= 2 * words - 1).mapInArrow(lean(coded), "t long, size int, text binary")
        found = found.unionByName(repeats(codes, CODE * words).select("t", "size", none.alias("spans"), F.col("spans").alias("words")))
        found = found.groupBy("t", "size").agg(F.any_value("spans", True).alias("spans"), F.any_value("words", True).alias("words"))
    found = found.select(F.col("t").alias("__t"), F.col("size").alias("__size"), F.col("spans").alias("__spans"), F.col("words").alias("__words"))
    names = docs.columns
    rows, keys = rows.select(*names, "__text", "__t", "__size"), stage(found.select("__t").distinct(), "repeats-keys")
    last = (*names, "__text", "__spans", "__words")
    if is_few(keys):
        near = rows.join(F.broadcast(keys), "__t", "left_semi").join(found, ["__t", "__size"], "left").select(*last)
        joined = near.unionByName(rows.join(F.broadcast(keys), "__t", "left_anti").select(*names, "__text", none.alias("__spans"), none.alias("__words")))
    else:  # each text moves once, and isn't sorted
        joined = rows.join(found.hint("shuffle_hash"), ["__t", "__size"], "left").select(*last)
    schema = docs.withColumns({"n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "removed": F.array(F.lit(0).cast("long")), "kept": F.lit("" if as_text else b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, n, where, kept = [], [], [], [], []
            for text, spans, passages in zip(*batch.columns[len(names) :]):
                raw = text.as_py().encode()
                a, b = covered(len(raw), np.asarray(spans.values)) if spans.is_valid else (np.zeros(0, int),) * 2
                if passages.is_valid:
                    a, b = joined_up(len(raw), (a, b), covered_words(np.frombuffer(raw, np.uint8), np.asarray(passages.values), words))
                edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                size.append(len(raw))
                gone.append(int((b - a).sum()))
                n.append(len(a))
                where.append(edges[1:-1])
                rest = b"".join([raw[i:j] for i, j in zip(edges[::2], edges[1::2])])
                kept.append(rest.decode(errors="ignore") if as_text else rest)
            cols = [pa.array(x, t) for x, t in zip((size, gone, n, where, kept), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string() if as_text else pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return joined.mapInArrow(lean(run), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
