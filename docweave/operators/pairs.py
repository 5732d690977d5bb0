"""Documents as rows with a map, documents as long pair tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import values as V


def shred(documents: DataFrame) -> DataFrame:
    """Documents ``(w, doc, m)`` to distinct pairs ``(w, doc, attr, val)``.

    No shuffle: a document is one row and its map holds each attribute once, so the
    exploded pairs are already distinct.
    """
    return explode_pairs(documents, ["w", "doc"], F.col("m"))


def explode_pairs(df: DataFrame, keep: list[str | Column], m: Column) -> DataFrame:
    """One row per entry of the map ``m``, with columns ``attr`` and ``val``.

    The outer form with a filter behind it gives the same rows as a plain explode, but
    stops the optimizer from adding a "map is not empty" filter below, which would build
    the map (or parse its JSON) a second time for every row.
    """
    return df.select(*keep, F.explode_outer(m).alias("attr", "val")).where("attr IS NOT NULL")


def with_normal_map(df: DataFrame, entries: Column, nulls: str = "text") -> DataFrame:
    """Add the document map ``m`` from raw ``ARRAY<STRUCT<key,value>>``: both sides trimmed,
    values never NULL, the last of repeated keys kept.

    Done in steps, each column used several times by the next, so that every step is
    computed once per row.
    """
    trimmed = F.transform(
        entries,
        lambda e: F.struct(
            F.trim(e["key"]).alias("key"), V.canonical_value(e["value"], nulls).alias("value")
        ),
    )
    steps = df.withColumn("_entries", trimmed).withColumn(
        "_keys", F.reverse(F.transform("_entries", lambda e: e["key"]))
    )
    # In the reversed key list the first match of a key is its last occurrence.
    is_last = lambda e, i: F.size("_keys") - F.array_position("_keys", e["key"]) == i
    last = F.when(F.size(F.array_distinct("_keys")) == F.size("_keys"), F.col("_entries")).otherwise(
        F.filter("_entries", is_last)
    )
    kept = F.filter(last, lambda e: e["value"].isNotNull())
    return steps.withColumn("m", F.map_from_entries(kept)).drop("_entries", "_keys")


def to_document(pairs: DataFrame) -> DataFrame:
    """Pairs to documents.  Repeated pairs collapse; of several values of one attribute
    the greatest is kept, so the map is always well-formed.

    The first aggregation combines repeated pairs before the shuffle; the list that is
    then collected is one document's attributes.
    """
    one_value = pairs.groupBy("w", "doc", "attr").agg(F.max("val").alias("val"))
    return one_value.groupBy("w", "doc").agg(
        F.map_from_entries(F.collect_list(F.struct("attr", "val"))).alias("m")
    )


def dedupe_documents(documents: DataFrame, order: str | Column) -> DataFrame:
    """Last write per document id per window, by the arrival order ``order``.

    ``max_by`` combines on the map side, so an id that fills a third of the input
    shrinks to one row per task before anything is shuffled.
    """
    rest = [c for c in documents.columns if c not in ("w", "doc")]
    order = F.col(order) if isinstance(order, str) else order
    return (
        documents.groupBy("w", "doc")
        .agg(F.max_by(F.struct(*rest), order).alias("_last"))
        .select("w", "doc", *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def pair_union(x: DataFrame, y: DataFrame) -> DataFrame:
    """Set union of two long tables with the same columns."""
    return x.unionByName(y).distinct()


def pair_intersection(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.intersect(y.select(*x.columns))


def pair_difference(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.subtract(y.select(*x.columns))
