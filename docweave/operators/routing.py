"""Sending each document to the partitions that own one of its pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.pairs import explode_pairs, shred

UNSEEN_THRESHOLD = 3  # fixed value: documents with an unseen pair before it is added


def _keys(table: DataFrame) -> list[str]:
    return [c for c in ("w", "attr", "val") if c in table.columns]


def _routed_pairs(documents: DataFrame, composite_only: bool) -> DataFrame:
    """Pairs to route by, with the document's ``route_all`` flag."""
    has = documents.columns
    flag = F.col("route_all") if "route_all" in has else F.lit(False)
    m = F.col("m")
    if composite_only and "composite" in has:
        only = F.map_filter("m", lambda k, _: k == F.col("composite"))
        m = F.when(F.col("composite").isNotNull(), only).otherwise(m)
    return explode_pairs(documents, ["w", "doc", flag.alias("route_all")], m)


def route(
    documents: DataFrame, table: DataFrame, k: int, unseen: str = "broadcast", composite_only: bool = False
) -> DataFrame:
    """``(w, doc, pids)``: sorted distinct partitions of each document that has a pair.

    ``unseen='broadcast'`` sends a document with a pair in no partition to all ``k``;
    ``unseen='hash'`` gives each such pair one partition by its hash, so all its carriers
    still meet.  Either way any two joinable documents share a partition.
    ``composite_only`` routes expanded documents by their composite pair alone.  A table
    without ``w`` serves all windows.
    """
    pid = F.col("pid")
    if unseen == "hash":
        pid = F.coalesce(pid, F.pmod(F.xxhash64("attr", "val"), F.lit(k)).cast("int"))
    elif unseen != "broadcast":
        raise ValueError("unseen must be 'broadcast' or 'hash'")
    # The list holds at most k ids; duplicates combine before the shuffle.
    found = (
        _routed_pairs(documents, composite_only)
        .join(table, _keys(table), "left")
        .groupBy("w", "doc")
        .agg(
            F.sort_array(F.collect_set(pid)).alias("_found"),
            F.bool_or(F.col("route_all") | pid.isNull()).alias("_all"),
        )
    )
    everywhere = F.sequence(F.lit(0), F.lit(k - 1))
    return found.select("w", "doc", F.when(F.col("_all"), everywhere).otherwise(F.col("_found")).alias("pids"))


def unseen_counts(documents: DataFrame, table: DataFrame, threshold: int = UNSEEN_THRESHOLD) -> DataFrame:
    """Pairs of a window that no partition owns: ``(w, attr, val, n_docs, candidate)``.

    Composite pairs are exempt.  A table without ``w`` serves all windows.
    """
    expanded = "composite" in documents.columns
    pairs = explode_pairs(documents, ["w", "composite"] if expanded else ["w"], F.col("m"))
    if expanded:
        pairs = pairs.where(F.col("composite").isNull() | (F.col("attr") != F.col("composite")))
    counts = pairs.groupBy("w", "attr", "val").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.join(table, _keys(table), "left_anti").withColumn(
        "candidate", F.col("n_docs") >= threshold
    )


def update_candidates(documents: DataFrame, unseen: DataFrame) -> DataFrame:
    """Documents carrying a pair that reached the threshold, once each: ``(w, doc)``."""
    wanted = unseen.where("candidate").select("w", "attr", "val")
    return (
        shred(documents).join(wanted, ["w", "attr", "val"], "left_semi").select("w", "doc").distinct()
    )


def routing_stats(routes: DataFrame) -> DataFrame:
    """Copies per document: ``(w, n_docs, copies, avg_copies, min_copies, max_copies)``."""
    n = F.size("pids")
    return routes.groupBy("w").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(n).alias("copies"),
        (F.sum(n) / F.count(F.lit(1))).alias("avg_copies"),
        F.min(n).cast("bigint").alias("min_copies"),
        F.max(n).cast("bigint").alias("max_copies"),
    )
