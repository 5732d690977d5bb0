"""A reproducible shuffle into shards whose places can be computed.

Every document gets its global row number in the order of ``doc_id`` (then size, CRC-32).
A keyed Feistel network permutes the numbers 0..n-1 (cycle walking keeps them in range), so
document ``i`` goes to shard ``p(i) mod shards``, slot ``p(i) div shards``: counts differ by
one at most, slots have no gaps, and nothing but ``n`` and the seed is needed to compute a place.

Null ``doc_id`` comes first; null text counts as no bytes (CRC-32 0).  Rows that agree in
id, size and CRC-32 are interchangeable.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import stage

ROUNDS = 6
WALK = 128  # each step leaves the range with probability below 1/2


def feistel(x: Column, bits: int, seed: int) -> Column:
    """A permutation of the numbers below ``2 ** (2 * bits)``."""
    mask = F.lit((1 << bits) - 1)
    left, right = F.shiftright(x, bits), x.bitwiseAND(mask)
    for r in range(ROUNDS):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(r), right).bitwiseAND(mask))
    return F.shiftleft(left, bits).bitwiseOR(right)


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` in a shuffle of 0..n-1; fails rather than leave the range."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)

    def walk(y: Column, _: Column) -> Column:
        return F.when(y < n, y).otherwise(feistel(y, bits, seed))

    y = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x, bits, seed), walk)
    return F.when(y < n, y).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Add ``_row``, the global row number under ``order``, without sorting in one task."""
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = stage(
        stage(ranged)  # range bounds are drawn from rows that don't change
        .repartitionByRange(*order, "_tie")
        .withColumn("_task", F.spark_partition_id())
        .sortWithinPartitions(*order, "_tie")
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    tasks = placed.groupBy("_task").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = tasks.select("_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    n = tasks.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    numbered = placed.join(F.broadcast(shift), "_task")  # a row per task
    return numbered.withColumn("_row", F.col("_mid") + F.col("_shift")).drop("_tie", "_task", "_mid", "_shift"), n


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"])
    place = numbered.withColumn("_place", permuted(F.col("_row"), n, seed))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
    )
