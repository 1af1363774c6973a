"""Token-id files compressed by grammar: in each block, frequent pairs of ids are repeatedly replaced by nonterminals; the rules and their expansion lengths are stored, so a document is decoded without the rest of its block.

The file format: one Parquet row per block of about BLOCK_TOKENS ids, in ascending (shard, block) order, with the payload as bytes:
  header  8 unsigned 32-bit integers: magic, version, terminals, rules, symbols, documents, tokens low, tokens high
  rules   left and right symbol of each rule (2 x u32); symbols from `terminals` on are rules, and a rule refers to earlier ones only
  sizes   expansion length of each rule (u32)
  symbols the compressed sequence (u32)
  lengths ids of each document (u32)
  keys    doc_id of each document (i64), with a null mask (u8)
Documents lie in ascending doc_id order through shards and blocks. A shard is a range of doc_ids; no document is split.

Nulls: a null text is an empty one, and holds the end id only. Null doc_ids come first. Repeated doc_ids lie next to each other in an order fixed by their text. A very long text is one step of the encoder. An empty table gives an empty file. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stage, table
from .tokens import END_ID, encoder, with_ends

BLOCK_TOKENS = 1 << 20
MAGIC, VERSION = 0x52505231, 1
#: The least count of a pair worth a rule. A rule takes the room of three symbols (left, right, size) and each use saves one.
LEAST = 6
BLOCKS = "shard int, block int, before long, tokens long, payload binary"


def frequent_pairs(seq: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at the places `at` (ascending): those that occur `least` times there, as left << 32 | right; their counts; the places they stand at; and the number of the pair at each of these."""
    a, b = seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64)
    wide, far = np.uint64(int(seq.max()).bit_length()), np.uint64(max(1, len(at).bit_length()))
    if 2 * wide + far <= 64:  # pair and place in one number: sorted without an index
        both = (a << wide | b) << far | np.arange(len(at), dtype=np.uint64)
        both.sort()
        keys, order = both >> far, both & ((np.uint64(1) << far) - np.uint64(1))
    else:
        keys = a << wide | b
        order = np.argsort(keys, kind="stable").view(np.uint64)
        keys = keys[order]
    first = np.flatnonzero(np.concatenate([keys[:1] == keys[:1], keys[1:] != keys[:-1]]))
    n = np.diff(first, append=len(keys))
    often = n >= least
    keys, count = keys[first[often]], n[often]
    number = np.full(len(at), -1, np.int32)
    number[order[np.repeat(often, n)].view(np.int64)] = np.repeat(np.arange(len(count), dtype=np.int32), count)
    hit = np.flatnonzero(number >= 0)
    return (keys >> wide) << np.uint64(32) | keys & ((np.uint64(1) << wide) - np.uint64(1)), count, at[hit], number[hit]


def chosen(at: np.ndarray, number: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of the places give way to their rule: of overlapping pairs the more frequent goes first, then the left one."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    rank = rank[number]
    touch = at[1:] == at[:-1] + 1
    keep = np.ones(len(at), bool)
    keep[1:] &= ~(touch & (rank[:-1] <= rank[1:]))
    keep[:-1] &= ~(touch & (rank[1:] < rank[:-1]))
    alike = touch & (rank[:-1] == rank[1:])
    if alike.any():  # in a run of one pair ("aaaa") every other one may go, if the first does
        begin = np.concatenate([[True], ~alike])
        lead = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        keep |= ((np.arange(len(at)) - lead) % 2 == 0) & ~begin & np.concatenate([alike, [False]]) & keep[lead]
    return keep


def grammar(seq: np.ndarray, least: int = LEAST) -> tuple[int, np.ndarray, np.ndarray]:
    """(terminals, rules as rows of left and right, sequence): symbols from `terminals` on stand for rules. Rounds go on until no pair occurs `least` times; each makes a rule of every pair that does, wherever a more frequent one doesn't overlap it.

    A round looks only at places whose pair was frequent before or holds a new symbol: no other pair's count can have grown.
    """
    seq = np.ascontiguousarray(seq, np.uint32)
    first = terminals = int(seq.max()) + 1 if len(seq) else 0
    rules: list[np.ndarray] = [np.zeros((0, 2), np.uint32)]
    at = np.arange(max(len(seq) - 1, 0))
    while len(at):
        keys, counts, at, number = frequent_pairs(seq, at, least)
        keep = chosen(at, number, counts)
        if not len(keys):
            break
        live = np.zeros(len(seq), bool)
        live[at[~keep]] = True
        at, number = at[keep], number[keep]
        used = np.zeros(len(counts), bool)
        used[number] = True
        out = seq.copy()
        out[at] = first + (np.cumsum(used) - 1)[number]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        # The place before a new symbol may itself be the second half of another.
        live[np.maximum(at - 2, 0)] |= ~stays[np.maximum(at - 1, 0)]
        seq, live = out[stays], live[stays]
        at = np.flatnonzero(live[:-1])
        keys = keys[used]
        rules.append(np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        first += len(keys)
    return terminals, np.concatenate(rules), seq


def rule_sizes(terminals: int, rules: np.ndarray) -> np.ndarray:
    sizes = [1] * terminals
    for a, b in rules.tolist():
        sizes.append(sizes[a] + sizes[b])
    return np.array(sizes[terminals:], np.uint32)


class Block:
    """A payload, parsed without copying. ids(i) decodes one document; all_ids() everything."""

    def __init__(self, payload: bytes):
        head = np.frombuffer(payload, "<u4", 8)
        if head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a block of this format")
        self.terminals, n_rules, n_sym, n_docs = (int(x) for x in head[2:6])
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes, self.symbols, self.lengths = take("<u4", n_rules), take("<u4", n_sym), take("<u4", n_docs)
        self.keys, self.null = take("<i8", n_docs), take("u1", n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])

    def _symbol_sizes(self, symbols: np.ndarray) -> np.ndarray:
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.terminals
        size[rule] = self.sizes[symbols[rule] - self.terminals]
        return size

    def _wholly(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols become terminals: rules give way to their two sides, level by level."""
        out = symbols.astype(np.uint32)
        while (rule := out >= self.terminals).any():
            at = np.cumsum(rule + 1)[rule]
            sides = self.rules[out[rule] - self.terminals]
            out = np.repeat(out, rule + 1)
            out[at - 2], out[at - 1] = sides[:, 0], sides[:, 1]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        if len(symbols) < len(self.rules):
            return self._wholly(symbols)
        flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), self._wholly(self.rules.ravel())])
        begin = symbols.astype(np.int64)
        rule = symbols >= self.terminals
        begin[rule] = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes + self.terminals)[symbols[rule] - self.terminals]
        size = self._symbol_sizes(symbols)
        ends = np.cumsum(size)
        return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def ids(self, i: int) -> np.ndarray:
        """Of the i-th document alone: only the symbols that reach into it are expanded."""
        if not hasattr(self, "_ends"):
            self._ends = np.cumsum(self._symbol_sizes(self.symbols))
        lo, hi = self.starts[i], self.starts[i + 1]
        a = int(np.searchsorted(self._ends, lo, side="right"))
        b = int(np.searchsorted(self._ends, hi, side="left")) + 1
        skip = lo - (self._ends[a - 1] if a else 0)
        return self.expand(self.symbols[a:b])[skip : skip + (hi - lo)]


def block(ids: np.ndarray, lengths: np.ndarray, keys: list[int | None]) -> bytes:
    terminals, rules, seq = grammar(ids)
    head = np.array([MAGIC, VERSION, terminals, len(rules), len(seq), len(lengths), len(ids) & 0xFFFFFFFF, len(ids) >> 32], "<u4")
    null = np.array([k is None for k in keys], "u1")
    return b"".join(x.tobytes() for x in (head, rules.astype("<u4"), rule_sizes(terminals, rules).astype("<u4"), seq.astype("<u4"), np.array(lengths, "<u4"), np.array([k or 0 for k in keys], "<i8"), null))


def write(docs: DataFrame, path: str, end: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes the blocks to the shared folder and returns them as read from there: shard, block, before (ids of the shard before it), tokens, payload."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path), TaskContext.get().partitionId()
        flat, lengths, keys, size, before, number = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(flat)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([block(ids, np.concatenate(lengths), keys)], pa.binary())], names=["shard", "block", "before", "tokens", "payload"])

        for batch in batches:
            for ids, counts, first in enc.encode_column(batch.column(1)):
                ids, sizes, _ = with_ends(ids, counts, end)
                flat.append(ids)
                lengths.append(sizes)
                keys += batch.column(0).slice(first, len(counts)).to_pylist()
                size += len(ids)
                if size >= block_tokens:
                    yield out()
                    before, number = before + size, number + 1
                    flat, lengths, keys, size = [], [], [], 0
        if flat:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stage(rows.mapInArrow(lean(encode), BLOCKS), "token_files")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the blocks."""
    spark = blocks.sparkSession
    totals = blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect()  # one row for each shard
    base, sums = 0, []
    for r in totals:
        sums.append((r.shard, base))
        base += r.n
    shift = spark.createDataFrame(sums, "shard int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = Block(payload.as_buffer())
                raw = memoryview(b.all_ids().astype("<u4").tobytes())
                cuts = (4 * b.starts).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(b.keys, pa.int64(), mask=b.null.astype(bool)), pa.array(b.starts[:-1] + before), pa.array(b.lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = blocks.join(F.broadcast(shift), "shard").select((F.col("before") + F.col("base")).alias("before"), "payload")
    return spread.mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
