"""Exact row numbers without pulling a group into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.session import cut_lineage

# Groups up to this size are numbered by a plain window.
WINDOW_MAX_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group (a map-side combined count)."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return top or 0


def range_parts(df: DataFrame, max_group: int) -> int:
    """Range partitions for a split: enough that none holds more than ``WINDOW_MAX_ROWS``, or ``max_group`` where that takes
    no more partitions than a shuffle has. A small bound must not make a task of every few rows."""
    rows = df.count()
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / max(max_group, WINDOW_MAX_ROWS)), min(math.ceil(rows / max_group), usual))


def number_rows(df: DataFrame, keys: list[str], order: list, out: str, max_group: int = WINDOW_MAX_ROWS) -> DataFrame:
    """Add 1-based row numbers within ``keys`` by ``order`` (which must break all ties).

    Small groups use a window. When a group is larger, or there are no keys at all, the rows are
    range-partitioned by (keys, order), numbered within each partition, and shifted by the sizes
    of the partitions before it. The range partitioning is written to the checkpoint folder once,
    so both passes see the same partition bounds even after an executor is lost.
    """
    if keys and largest_group(df, keys) <= max_group:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    parts = range_parts(df, max_group)
    placed = cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    joined = local.join(shifts, [*keys, "_part"])
    return joined.withColumn(out, (F.col("_local") + F.col("_shift")).cast("long")).select(*df.columns, out)


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """First ``n`` rows per group. Spark cuts each task's share to ``n`` rows per group before the
    shuffle (window group limit), so hot groups do not travel."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def next_after(df: DataFrame, keys: list[str], order: str, columns: dict[str, object], max_group: int = WINDOW_MAX_ROWS) -> DataFrame:
    """Add, per named Column, its smallest non-null value among the later rows of the group.

    Same split as :func:`number_rows`: within a range partition by a window, across partitions by
    a suffix minimum over one row per (group, partition).
    """
    later = (1, Window.unboundedFollowing)
    if largest_group(df, keys) <= max_group:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(*later)
        return df.withColumns({name: F.min(column).over(window) for name, column in columns.items()})
    parts = range_parts(df, max_group)
    named = df.withColumns({f"_in_{name}": column for name, column in columns.items()})
    placed = cut_lineage(named.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()))
    firsts = placed.groupBy(*keys, "_part").agg(*[F.min(f"_in_{name}").alias(f"_min_{name}") for name in columns])
    beyond = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*later)
    tails = firsts.select(*keys, "_part", *[F.min(f"_min_{name}").over(beyond).alias(f"_tail_{name}") for name in columns])
    local = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(*later)
    joined = placed.withColumns({f"_near_{name}": F.min(f"_in_{name}").over(local) for name in columns}).join(tails, [*keys, "_part"])
    return joined.select(*df.columns, *[F.coalesce(f"_near_{name}", f"_tail_{name}").alias(name) for name in columns])
