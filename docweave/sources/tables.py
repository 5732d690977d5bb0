"""Rows of any table as documents, and document labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def documents_from_table(
    df: DataFrame, doc: str | Column, attrs: dict[str, str | Column], w: str | Column | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Each row as a document ``(w, doc, m, *keep)``; a NULL cell is an absent attribute.

    A narrow projection: the scan still prunes to the columns named and no shuffle occurs.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cells = [
        F.struct(F.lit(name.strip()).alias("attr"), F.trim(as_col(c).cast("string")).alias("val"))
        for name, c in attrs.items()
    ]
    present = F.filter(F.array(*cells), lambda p: p["val"].isNotNull())
    window = F.lit(0).cast("bigint") if w is None else as_col(w).cast("bigint")
    return df.select(
        window.alias("w"), as_col(doc).alias("doc"), F.map_from_entries(present).alias("m"), *(keep or [])
    )


def with_doc_id(df: DataFrame, *parts: str | Column, name: str = "doc") -> DataFrame:
    """Document identity from its origin, such as file name and position."""
    return df.withColumn(name, F.concat_ws("#", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def tag_stream(df: DataFrame, name: str) -> DataFrame:
    """Stream label and ingest time on every document."""
    return df.withColumn("stream", F.lit(name)).withColumn("ingest_ts", F.current_timestamp())
