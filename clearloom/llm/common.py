"""What the operators share: reading tables, writing intermediate tables to the shared folder, and hashing words in numpy."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once; a single longer document is one step.
SLICE_BYTES = 1 << 18


#: Rows of an Arrow batch: whole texts, so fewer than Spark's 10,000.
BATCH_ROWS = 2000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at the end of a task the worker gives free memory back to the machine, which workers keep for later tasks otherwise."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # the default one keeps what it freed
        try:
            yield from run(batches)
        finally:
            if _powers["n"] > KEPT_POWERS:
                _powers.clear()
                _powers["n"] = 0
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where that is unset, as in local tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="clearloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing refers to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and give unused heap back to the machine. Between stages: Python workers of the next one need the room that the heap of the last one holds."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).filter(F.col("done").isNull()).collect()  # no rows


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_at = path
    clean_up(spark)
    return out


def remove(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*staged: DataFrame) -> None:
    """Deletes what stage() wrote: only where all that was made of it has been written too."""
    for df in staged:
        remove(df.sparkSession, df.staged_at)


#: Rows of keys up to which they are broadcast; more are shuffled.
FEW_ROWS = 200_000


def is_few(keys: DataFrame) -> bool:
    """Whether keys are at most FEW_ROWS; they are counted, as far as that."""
    return keys.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast if they are at most FEW_ROWS (they are counted, as far as that): else Spark moves the other side before it sees how few they are."""
    return F.broadcast(keys) if is_few(keys) else keys


def where(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows with one of the keys, if these are few, else all rows: for use before a join that drops the others anyway, so that nothing moves twice."""
    return rows.join(F.broadcast(keys), on, "left_semi") if is_few(keys) else rows


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges (i, j) of documents with at most `limit` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240501)
#: A random odd 64-bit value for each byte, and the multiplier of the rolling hash with its inverse.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_powers = {"n": 0}
#: Powers that a worker keeps between tasks (16 bytes each); a long text's are dropped with its task.
KEPT_POWERS = 1 << 16


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        size = max(n, 1 << 12)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _MUL, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all others."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of raw[i:j] times the i-th power of the multiplier."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); the length is part of the hash."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Words of more bytes are hashed by BLAKE2: the rolling hash maps some long words that differ in a regular way to one value.
LONG_WORD = 64


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents given by offsets into raw: hash of each word (A-Z lower-cased, split at ASCII white space), and the index of its document. A long text is hashed in pieces cut between words."""
    if len(raw) <= SLICE_BYTES:
        return _word_hashes(offsets, raw)
    out, at, base = [], 0, offsets[0]
    while at < len(raw):
        end = min(at + SLICE_BYTES, len(raw))
        while end < len(raw) and not SPACE[raw[end]]:
            space = np.flatnonzero(SPACE[raw[end : end + SLICE_BYTES]])
            end = end + int(space[0]) if len(space) else min(end + SLICE_BYTES, len(raw))
        out.append(_word_hashes(np.clip(offsets - base, at, end), raw[at:end]))
        at = end
    return np.concatenate([w for w, _ in out]), np.concatenate([d for _, d in out])


def _word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = offsets[0]
    raw = _LOWER[raw]
    solid = ~SPACE[raw]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[-1]] - base
    first = first[first < len(raw)]
    begin[first] |= solid[first]
    start = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    last = first[first > 0] - 1
    stop[last] |= solid[last]
    end = np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets - base, start, side="right") - 1
    out = span_hash(prefix_hash(raw), start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out, doc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def crc_mod(n: int):
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
