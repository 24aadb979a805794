"""Exact row numbers without putting a group, or the whole table, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusworks.session import materialise


def dense_positions(df: DataFrame, order: list, by: list[str] = (), name: str = "pos") -> DataFrame:
    """Number the rows 1, 2, … in ``order`` within each ``by`` group; order must be total.

    The rows are range-partitioned by (by, order), so one large group spreads over many tasks,
    and written once so that partition numbers cannot change. Only one row per (partition, group)
    enters the window that adds up the offsets.
    """
    keys: list[Column] = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialise(
        placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "positions"
    )
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_p"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    position = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return placed.join(offsets, same).withColumn(name, position).select(*df.columns, name)
