"""Sinks: reports, append-only audit, write-once evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearloom.config import DEFAULT

from .commits import Versions

MINIMAL = ["asset_id", "status", "track", "matched_source", "similarity_score", "asset_hash", "certificate_id"]


def report_json(results: DataFrame, path: str, minimal: bool = False) -> None:
    (results.select(*MINIMAL) if minimal else results).write.mode("overwrite").json(path)


def minimal_report(results: DataFrame) -> DataFrame:
    return results.select(*MINIMAL)


class AuditLog:
    """Events by month. They are appended, never changed."""

    def __init__(self, path: str):
        self.path = path

    def append(self, events: DataFrame) -> None:
        events.withColumn("ym", F.date_format("recorded_at", "yyyy-MM")).write.mode("append").partitionBy("ym").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def by_batch(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return self.read(spark).filter(F.col("batch_id") == batch_id).orderBy("id")

    def by_hash(self, spark: SparkSession, asset_hash: str) -> DataFrame:
        return self.read(spark).filter(F.col("asset_hash") == asset_hash).orderBy(F.desc("id"))

    def update(self, *_a, **_k):
        raise PermissionError("audit events are append-only")

    delete = update


def vault_path(asset_hash: Column) -> Column:
    """Two characters of the hash, then the hash."""
    bare = F.lower(F.substring_index(asset_hash, ":", -1))
    return F.concat_ws("/", F.substring(bare, 1, 2), bare)


class EvidenceLocker:
    """Write-once records by hash; a second record of a hash is refused, also where two writers store at once: each looks at what the other committed before its own version counts."""

    def __init__(self, path: str, retention_days: int = DEFAULT.retention_days):
        self.path, self.retention_days = path, retention_days

    def store(self, records: DataFrame) -> int:
        """The new version's number; FileExistsError if any of the hashes is locked, and then nothing is stored."""
        spark = records.sparkSession
        rows = records.withColumn("vault", vault_path(F.col("asset_hash"))).withColumn("prefix", F.substring("vault", 1, 2))
        if not rows.groupBy("asset_hash").count().filter("count > 1").isEmpty():
            raise FileExistsError("evidence of this hash is locked")

        def check(held: DataFrame) -> None:
            if not rows.join(held.select("asset_hash"), "asset_hash", "left_semi").isEmpty():
                raise FileExistsError("evidence of this hash is locked")

        return Versions(spark, self.path).commit(rows, check=check)

    def read(self, spark: SparkSession) -> DataFrame | None:
        return Versions(spark, self.path).read()

    def retrieve(self, spark: SparkSession, asset_hash: str) -> DataFrame:
        rows = self.read(spark)
        if rows is None:
            raise FileNotFoundError(self.path)
        return rows.filter(F.col("asset_hash") == asset_hash).drop("_version").withColumn("retention_days", F.lit(self.retention_days))


def fallback_bbox(width: Column, height: Column) -> Column:
    """The box that stands in where no template position is known: a tenth in, eight tenths wide."""
    part = lambda c, x: F.floor(c * x).cast("int")
    return F.struct(part(width, 0.1).alias("x"), part(height, 0.1).alias("y"), part(width, 0.8).alias("w"), part(height, 0.8).alias("h"))
