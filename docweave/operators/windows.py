"""Tumbling windows by document count or by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from docweave.operators.positions import with_position

DEFAULT_WINDOW = 430_000  # fixed value: documents per window when none is given


def sequence_window(df: DataFrame, seq: str | Column, n: int = DEFAULT_WINDOW) -> DataFrame:
    """Window id from a gap-free sequence column: ``seq div n``.  No shuffle."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return df.withColumn("w", F.floor(seq / F.lit(n)).cast("bigint"))


def count_window(
    df: DataFrame, order: list[str | Column], n: int = DEFAULT_WINDOW, by: list[str] | None = None
) -> DataFrame:
    """Every ``n`` documents in ``order`` make one window, counted per source ``by``.

    Leftovers form a last, smaller window.  ``order`` must be total (add the id).
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = with_position(df, by or [], cols, "_pos")
    return placed.withColumn("w", F.floor(F.col("_pos") / F.lit(n)).cast("bigint")).drop("_pos")


def utc_instant(ts: Column) -> Column:
    """A timestamp without time zone read as UTC, whatever the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts))


def time_window(df: DataFrame, ts: str | Column, duration: str = "3 minutes") -> DataFrame:
    """Window id from event time: start of the tumbling window in epoch seconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if isinstance(df.select(ts).schema[0].dataType, TimestampNTZType):
        ts = utc_instant(ts)
    return df.withColumn("w", F.unix_timestamp(F.window(ts, duration)["start"]))


def window_counts(documents: DataFrame, *extra: str) -> DataFrame:
    """Documents per window (and per ``extra`` columns, such as the partition id)."""
    return documents.groupBy("w", *extra).agg(F.count(F.lit(1)).alias("n_docs"))
