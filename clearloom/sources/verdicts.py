"""A data source that reads texts with their verdict: spark.dataSource.register(Verdicts), then

spark.read.format("clearloom_verdicts").option("path", ...).option("index", ...).load(), or spark.readStream with the same options.

path: a Parquet file or a folder of them, with columns named by `id` (doc_id) and `text` (text). index: Parquet with item_id and text, the protected works; it is read once for each task, so it is held to MOST_INDEX bytes. scorer: a name in SCORERS (tokens). tier: the trust tier that routes the score. A batch has a partition for each row group; a stream takes files in order of their names, `files` (100) at a time.

Rows: doc_id, text, matched (null: none), score, verdict. Null texts score 0. Ties go to the smaller item_id.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from clearloom.config import DEFAULT

MOST_INDEX = 256 << 20
WORD = re.compile(r"\w{3,}")
SCHEMA = "doc_id bigint, text string, matched bigint, score double, verdict string"


class Tokens:
    """least(0.98, greatest(1.5 x Jaccard, share of the work's words)) of distinct words, by an inverted index."""

    def __init__(self, works: list[tuple[int, str]], least: float = DEFAULT.candidate_least):
        self.least, self.sizes, self.posts = least, {}, defaultdict(list)
        for item, text in works:
            words = set(WORD.findall((text or "").lower()))
            self.sizes[item] = len(words)
            for w in words:
                self.posts[w].append(item)

    def __call__(self, text: str | None) -> tuple[int | None, float]:
        words = set(WORD.findall((text or "").lower()))
        best: tuple[float, int | None] = (self.least, None)
        for item, k in Counter(i for w in words for i in self.posts.get(w, ())).items():
            n = self.sizes[item]
            score = min(0.98, max(1.5 * (k / (len(words) + n - k)), k / n))
            if score > best[0] or best[1] is not None and score == best[0] and item < best[1]:
                best = score, item
        return (best[1], round(best[0], 4)) if best[1] is not None else (None, 0.0)


SCORERS: dict[str, Callable] = {"tokens": Tokens}


def verdict(score: float, tier: str, cfg=DEFAULT) -> str:
    low = cfg.low_base["TEXT"] + cfg.tier_shift.get(tier, 0.0)
    return "BLOCKED" if score >= cfg.text_threshold else "HUMAN_REVIEW" if score >= low else "PASSED"


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    fs, root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return fs, [root]
    found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
    return fs, sorted(f.path for f in found if f.type == pyarrow.fs.FileType.File and f.path.endswith(".parquet") and "/_" not in f.path[len(root) :] and "/." not in f.path[len(root) :])


@dataclass
class Part(InputPartition):
    file: str
    group: int


class _Scoring:
    def __init__(self, options):
        self.options = dict(options)
        if self.options.get("scorer", "tokens") not in SCORERS:
            raise ValueError(f"no scorer {self.options['scorer']!r}: one of {sorted(SCORERS)}")

    def _scorer(self) -> Callable:
        fs, files = _files(self.options["index"])
        if (size := sum(f.size for f in fs.get_file_info(files))) > MOST_INDEX:
            raise ValueError(f"an index of {size} bytes is too large for this source: use the joins")
        works = [(i, t) for f in files for i, t in zip(*(c.to_pylist() for c in pq.read_table(f, columns=["item_id", "text"], filesystem=fs).columns))]
        return SCORERS[self.options.get("scorer", "tokens")](works)

    def _groups(self, files: list[str]) -> list[Part]:
        fs, _ = _files(self.options["path"])
        return [Part(f, g) for f in files for g in range(pq.ParquetFile(f, filesystem=fs).num_row_groups)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        score, tier = self._scorer(), self.options.get("tier", "public-web-unknown")
        fs, _ = _files(self.options["path"])
        columns = [self.options.get("id", "doc_id"), self.options.get("text", "text")]
        for batch in pq.ParquetFile(partition.file, filesystem=fs).iter_batches(1000, row_groups=[partition.group], columns=columns):
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in columns)
            got = [score(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), texts.cast(pa.string()), pa.array([m for m, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64()), pa.array([verdict(s, tier) for _, s in got])], names=["doc_id", "text", "matched", "score", "verdict"])


class _Batch(_Scoring, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self._groups(_files(self.options["path"])[1])


class _Stream(_Scoring, DataSourceStreamReader):
    """An offset is the name of the last file that was read."""

    at: str | None = None

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        new = [f for f in _files(self.options["path"])[1] if f > (self.at or "")][: int(self.options.get("files", 100))]
        self.at = new[-1] if new else self.at or ""
        return {"file": self.at}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.at = max(self.at or "", end["file"])
        return self._groups([f for f in _files(self.options["path"])[1] if start["file"] < f <= end["file"]])

    def commit(self, end: dict) -> None:
        pass


class Verdicts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clearloom_verdicts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
