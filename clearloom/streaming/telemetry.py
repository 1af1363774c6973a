"""Spans as rows: what ran, with which attributes, when, how long and over how many rows; of batch work by Observation, of streams by a listener. p95 comes from the table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SPAN = "span_id string, name string, plane string, attributes map<string,string>, start_time double, ms double, rows long, failed boolean"


class Span:
    def __init__(self):
        self._seen: list[Observation] = []
        self.rows: int | None = None

    def observe(self, df: DataFrame) -> DataFrame:
        """df, whose rows are counted as they pass in the first action on it."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def counted(self) -> int | None:
        return sum(o.get["rows"] for o in self._seen) if self._seen else self.rows


class Spans:
    """Writes spans to a folder of Parquet files; flush() after some, a few rows each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._rows = spark, path, []

    @contextmanager
    def span(self, name: str, plane: str = "data", **attributes) -> Iterator[Span]:
        """A block of batch work. The rows of what it observes are counted if an action ran on it within the block."""
        s, start, began, failed = Span(), time.time(), time.perf_counter(), True
        try:
            yield s
            failed = False
        finally:
            ms = 1000 * (time.perf_counter() - began)
            self.add(name, plane, attributes, start, ms, None if failed else s.counted(), failed)

    def add(self, name: str, plane: str, attributes: dict, start: float, ms: float, rows: int | None, failed: bool = False) -> None:
        self._rows.append((str(uuid.uuid4()), name, plane, {k: str(v) for k, v in attributes.items()}, start, ms, rows, failed))

    def flush(self) -> None:
        rows, self._rows = self._rows, []
        if rows:
            self.spark.createDataFrame(rows, SPAN).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SPAN).parquet(self.path)

    def p95(self) -> DataFrame:
        """name, n, p95_ms, rows of each name, by an approximate percentile, which partial aggregates merge."""
        return self.table().groupBy("name").agg(F.count("*").alias("n"), F.percentile_approx("ms", 0.95, 10_000).alias("p95_ms"), F.sum("rows").alias("rows"))

    def listener(self) -> StreamingQueryListener:
        """A span for each micro-batch that had input: spark.streams.addListener(spans.listener())."""
        return _Listener(self)


class _Listener(StreamingQueryListener):
    def __init__(self, spans: Spans):
        self.spans = spans

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.spans.add(p.name or str(p.id), "stream", {"batch": p.batchId, "run": p.runId}, time.time() - p.batchDuration / 1000, float(p.batchDuration), p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.spans.add(str(event.id), "stream", {"error": event.exception[:500]}, time.time(), 0.0, None, True)
