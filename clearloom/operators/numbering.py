"""Row numbers over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id that count within a partition.
_WITHIN = 33


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """rows with their place in `order`, from 1, as `name`. Rows are sorted by ranges and checkpointed; then one count for each partition goes to the driver, and each row adds the counts of the partitions before. The order has to be total for numbers that repeat from run to run."""
    kept = rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__m", _WITHIN)
    sizes = sorted((r.part, r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    out = kept.withColumn("__part", part).join(F.broadcast(table), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND((1 << _WITHIN) - 1) + 1).drop("__m", "__part", "__before")
