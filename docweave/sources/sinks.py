"""Join results out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joinable_lines(sets: DataFrame) -> DataFrame:
    """Partner sets as text: ``(w, DocumentID, JoinableDocuments)``, ``None`` when empty."""
    text = F.array_join(F.transform("partners", lambda p: p.cast("string")), ",")
    return sets.select(
        "w",
        F.col("doc").cast("string").alias("DocumentID"),
        F.when(F.size("partners") == 0, "None").otherwise(text).alias("JoinableDocuments"),
    )


def _by_window(df: DataFrame) -> DataFrame:
    """Rows of a window in as few tasks as their size asks for, so that its folder gets few files.

    Dealt by document instead, every task would write a file for every window.
    """
    return df.hint("rebalance", F.col("w"))


def write_joinable_csv(sets: DataFrame, path: str, mode: str = "error") -> None:
    """``DocumentID|JoinableDocuments`` lines, one folder of part files per window."""
    _by_window(joinable_lines(sets)).write.partitionBy("w").mode(mode).csv(path, sep="|", header=True)


def write_pairs(joined: DataFrame, path: str, mode: str = "error") -> None:
    """Couples (or any other windowed result) as parquet, one folder per window."""
    _by_window(joined).write.partitionBy("w").mode(mode).parquet(path)


def stream_pairs(joined: DataFrame, path: str, checkpoint: str):
    """The same for a streaming result: exactly-once file sink, all available input."""
    return (
        joined.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
