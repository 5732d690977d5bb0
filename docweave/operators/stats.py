"""Attribute and pair statistics of a window.

Every count starts with ``groupBy(w, attr, val)``, which combines before the shuffle: a
pair carried by a third of all documents costs one row per task, not one per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.pairs import shred
from docweave.operators.positions import part_of, with_position


def pair_counts(documents: DataFrame) -> DataFrame:
    """``(w, attr, val, n_docs)``."""
    return shred(documents).groupBy("w", "attr", "val").agg(F.count(F.lit(1)).alias("n_docs"))


def attr_stats(documents: DataFrame) -> DataFrame:
    """``(w, attr, n_docs, n_vals)``: documents carrying the attribute, distinct values."""
    return (
        pair_counts(documents)
        .groupBy("w", "attr")
        .agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_vals"))
    )


def approx_attr_stats(documents: DataFrame, rsd: float = 0.02) -> DataFrame:
    """As ``attr_stats`` with a sketch for the distinct values: one shuffle of tiny rows."""
    return (
        shred(documents)
        .groupBy("w", "attr")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.approx_count_distinct("val", rsd).alias("n_vals"),
        )
    )


def rank_attrs(stats: DataFrame) -> DataFrame:
    """Rank from 1 per window: most documents, then fewest values, then name."""
    order = [F.desc("n_docs"), F.asc("n_vals"), F.asc("attr")]
    return with_position(stats, ["w"], order, "rank").withColumn("rank", F.col("rank") + 1)


def join_attr_order(documents: DataFrame) -> DataFrame:
    """Global attribute order of a window for joining: ``(w, attr, rank)``."""
    return rank_attrs(attr_stats(documents)).select("w", "attr", "rank")


def pair_index(documents: DataFrame, parts: int = 1) -> DataFrame:
    """Inverted index ``(w, attr, val, n_docs, block, docs)``.

    Every posting list is dealt to ``parts`` rows (``block``) by document hash, whatever its
    length, so with enough parts no task holds one whole hot list.  Empty rows are left out.
    """
    block = part_of("doc", parts).alias("block")
    lists = shred(documents).groupBy("w", "attr", "val", block).agg(F.sort_array(F.collect_list("doc")).alias("docs"))
    return lists.join(pair_counts(documents), ["w", "attr", "val"]).select(
        "w", "attr", "val", "n_docs", "block", "docs"
    )


def posting_lists(documents: DataFrame, parts: int = 1) -> DataFrame:
    """Attribute to values to documents: ``pair_index`` plus the attribute's totals.

    Columns ``(w, attr, n_occurrences, n_vals, val, block, docs)``; kept long so that an
    attribute with millions of values stays distributed.
    """
    totals = attr_stats(documents).withColumnRenamed("n_docs", "n_occurrences")
    return pair_index(documents, parts).join(totals, ["w", "attr"]).select(
        "w", "attr", "n_occurrences", "n_vals", "val", "block", "docs"
    )


def sorted_pairs(documents: DataFrame) -> DataFrame:
    """Each document's pairs in the join order of its window: ``(w, doc, pairs)``.

    The list collected per group is one document's own pairs.
    """
    ranked = shred(documents).join(join_attr_order(documents), ["w", "attr"])
    return (
        ranked.groupBy("w", "doc")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "attr", "val"))).alias("pairs"))
    )


def universal_attrs(documents: DataFrame) -> DataFrame:
    """Attributes that every non-empty document of the window carries: ``(w, attr, n_docs)``."""
    docs = (
        documents.where(F.size("m") > 0).groupBy("w").agg(F.count(F.lit(1)).alias("_window_docs"))
    )
    return (
        attr_stats(documents)
        .join(docs, "w")
        .where(F.col("n_docs") == F.col("_window_docs"))
        .select("w", "attr", "n_docs")
    )
