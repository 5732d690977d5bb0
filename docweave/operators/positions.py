"""Exact positions in a total order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import stage


def with_position(df: DataFrame, by: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row within its ``by`` group under ``order``.

    A ``row_number`` over the group would sort a whole group in one task.  Here the rows
    are range-partitioned on ``by + order`` (a big group spreads over many tasks), each
    task numbers its own rows, and per-task counts give the offsets.  ``order`` must be
    total within a group.  The numbered rows are staged, because range bounds come from
    a sample and must not be drawn twice.
    """
    keys = [F.col(c) for c in by]
    numbered = stage(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    # One row per (group, task): at most #groups + #tasks rows in total.
    starts = numbered.groupBy(*by, "_part").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        *(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)),
        F.col("_part").alias("_at"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):  # a NULL group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("_mid") + F.col("_shift"))
        .drop("_mid", "_part", "_shift", "_at", *(f"_by_{i}" for i in range(len(by))))
    )


def part_of(doc: str, parts: int) -> Column:
    """Which of ``parts`` rows a member of a list goes to, by a hash that other engines have as well."""
    if parts == 1:
        return F.lit(0).cast("bigint")
    head = F.substring(F.md5(F.col(doc).cast("string").cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % parts
