"""Streams: a priority queue with retries and dead letters, scans of new files, and dedup with kept state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clearloom.config import DEFAULT


def order(items: DataFrame) -> DataFrame:
    """Smallest priority first, then in order of arrival."""
    return items.orderBy("priority", "seq")


def retried(attempts: DataFrame, retries: int = DEFAULT.queue_retries, start: int = 10, step: int = 5) -> DataFrame:
    """item_id, retry_count, priority, dead, error_log from failures (item_id, seq, error): each requeues with a lower priority, until more than `retries` failed."""
    rows = attempts.groupBy("item_id").agg(F.count("*").alias("retry_count"), F.array_sort(F.collect_list(F.struct("seq", "error"))).alias("e"))  # a few failures each
    log = F.transform("e", lambda x, i: F.concat(F.lit("Attempt "), (i + 1).cast("string"), F.lit(": "), x.error))
    dead = F.col("retry_count") > retries
    return rows.select("item_id", "retry_count", (start + step * F.least("retry_count", F.lit(retries))).alias("priority"), dead.alias("dead"), log.alias("error_log"))


def metrics(items: DataFrame, depth: int = DEFAULT.queue_depth) -> DataFrame:
    """Depths and totals of items with state (queued, done, dead)."""
    queued = F.count_if(F.col("state") == "queued")
    return items.agg(queued.alias("queue_depth"), F.count_if(F.col("state") == "dead").alias("dlq_depth"), F.count("*").alias("total_enqueued"), F.count_if(F.col("state") == "done").alias("total_processed"), (queued >= depth).alias("backpressure_active"))


def retry_stream(failures: DataFrame, retries: int = DEFAULT.queue_retries) -> DataFrame:
    """Of a stream of failures (item_id, error): each item's count and whether it is dead, with the count kept as state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((count,))
        yield pd.DataFrame({"item_id": [key[0]], "retry_count": [count], "dead": [count > retries]})

    return failures.groupBy("item_id").applyInPandasWithState(run, "item_id string, retry_count long, dead boolean", "count long", "update", GroupStateTimeout.NoTimeout)


def scan_stream(spark: SparkSession, path: str, schema: str, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, per_trigger: int = 1000):
    """Scans new Parquet files as they come; a restart goes on where the checkpoint ends, and a repeated batch overwrites its own part."""

    def each(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Extra, not in the engine's model: event-time counts."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n"))
