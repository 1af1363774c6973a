"""The poll loop: each trigger fetches the sources that are due, at most a few of each domain, and notes when."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearloom.functions.text import source_domain
from clearloom.operators import commits

SOURCE = "source_id string, url string, active boolean, last_crawled_at timestamp"


def due(sources: DataFrame, per_domain: int = 3) -> DataFrame:
    """Active sources, at most per_domain of each domain: never crawled ones first, then the longest unvisited. Those left over come in later triggers, so a hot domain is spread in time; ranks are cut within tasks before rows move."""
    rows = sources.filter("active").withColumn("domain", source_domain(F.col("url")))
    turn = Window.partitionBy("domain").orderBy(F.asc_nulls_first("last_crawled_at"), "source_id")
    return rows.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= per_domain).drop("turn")


def poll_once(registry: commits.Versions, fetch: Callable[[DataFrame], DataFrame], out: str, number: int, at, per_domain: int = 3) -> int:
    """One trigger: what fetch makes of the due sources (it keeps source_id; sources that it drops count as not visited) goes to out/batch=number, and their visits to the registry. Returns how many were visited. Run again with the same number, it overwrites its own part; sources are visited again then, as a fetch can't be undone."""
    sources = commits.current(registry, "source_id")
    if sources is None:
        return 0
    fetch(due(sources, per_domain)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    visited = registry.spark.read.parquet(f"{out}/batch={number}").select("source_id").distinct()
    crawled = sources.join(visited, "source_id", "left_semi").withColumn("last_crawled_at", F.lit(at).cast("timestamp")).select(*(x.split()[0] for x in SOURCE.split(", ")))
    n = crawled.count()
    if n:
        commits.upsert(registry, crawled)
    return n


def poll(spark: SparkSession, registry_path: str, fetch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str = "10 seconds", per_domain: int = 3):
    """Starts the loop; a restart goes on with the next trigger's number."""
    registry = commits.Versions(spark, registry_path)

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is not None:
            poll_once(registry, fetch, out, number, now, per_domain)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
