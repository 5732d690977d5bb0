"""Packing groups into ``k`` balanced partitions, and partition tables.

A partition table is long: ``(w, attr, val, pid)``.  Whatever the packing, joins routed by
a table are exact; the packing only decides balance and copies per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.groups import GROUP, order_groups
from docweave.operators.pairs import shred
from docweave.session import stage

_SEGMENTS = "w long, n_docs long, start long, segs array<struct<from:long,pids:array<int>>>"


def _run_segments(loads: np.ndarray, size: int, count: int) -> list[dict]:
    """Who receives each of ``count`` equal items given one by one to the least loaded.

    Partition p offers slots at loads ``L_p, L_p + size, ...``; items take slots in
    ascending load, higher id first among equals.  Sorting slots by (load // size,
    load % size, -id) shows that between two entry levels the same partitions are served
    round after round, so each segment is a fixed cycle.  ``loads`` is advanced in place.
    """
    level, rest = loads // size, loads % size
    order = sorted(range(len(loads)), key=lambda p: (rest[p], -p))
    entries = np.unique(level)
    segs, given = [], 0
    for i, lv in enumerate(entries):
        if given >= count:
            break
        cycle = [p for p in order if level[p] <= lv]
        rounds = (entries[i + 1] - lv) * len(cycle) if i + 1 < len(entries) else count - given
        take = int(min(rounds, count - given))
        segs.append({"from": given, "pids": cycle})
        full, extra = divmod(take, len(cycle))
        for j, p in enumerate(cycle):
            loads[p] += size * (full + (1 if j < extra else 0))
        given += take
    return segs


def _fold_sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    """One window's size histogram (one row per distinct group size) through the fold."""
    pdf = pdf.sort_values(["opens", "start"], ascending=[False, True])
    loads = pdf.loc[pdf["opens"], "n_docs"].to_numpy(dtype=np.int64).copy()
    rows = []
    for r in pdf.loc[~pdf["opens"]].itertuples():
        rows.append((r.w, r.n_docs, r.start, _run_segments(loads, int(r.n_docs), int(r.n))))
    return pd.DataFrame(rows, columns=["w", "n_docs", "start", "segs"])


def _assign_additive(ordered: DataFrame, k: int) -> DataFrame:
    """Largest first, each group to the partition with the least sum of group sizes.

    Only sizes matter to that rule, and groups of one size form a run with a closed form.
    So a window's sequential part sees one row per distinct size (at most about the square
    root of the window's pairs), never the groups; each group then finds its place in its
    run by arithmetic.
    """
    opening = ordered.where(F.col("pos") < k)
    later = ordered.where(F.col("pos") >= k)
    runs = later.groupBy("w", "n_docs").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    histogram = opening.select(
        "w", "n_docs", F.col("pos").alias("start"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("opens")
    ).unionByName(runs.withColumn("opens", F.lit(False)))
    segments = histogram.groupBy("w").applyInPandas(_fold_sizes, _SEGMENTS)
    j = F.col("pos") - F.col("start")
    seg = F.element_at(F.filter("segs", lambda s: s["from"] <= j), -1)
    turn = ((j - seg["from"]) % F.size(seg["pids"])).cast("int")
    placed = later.join(segments, ["w", "n_docs"]).select("w", *GROUP, F.get(seg["pids"], turn).alias("pid"))
    return opening.select("w", *GROUP, F.col("pos").cast("int").alias("pid")).unionByName(placed)


def assign_partitions(groups: DataFrame, k: int, load: str = "additive") -> DataFrame:
    """Partition of each group: ``(w, g_attr, g_val, pid)``.

    The ``k`` groups with most documents open partitions 0 to k-1; each later group goes
    to the least loaded partition, the highest id among equals.

    ``load='additive'``: load is the sum of group sizes.
    ``load='snake'``: back-and-forth dealing by position, no loads at all.
    """
    ordered = stage(order_groups(groups))
    if load == "snake":
        turn, slot = F.floor(F.col("pos") / k), F.col("pos") % k
        pid = F.when(turn % 2 == 0, slot).otherwise(k - 1 - slot)
        return ordered.select("w", *GROUP, pid.cast("int").alias("pid"))
    if load != "additive":
        raise ValueError("load must be 'additive' or 'snake'")
    return _assign_additive(ordered, k)


def partition_table(groups: DataFrame, assignment: DataFrame) -> DataFrame:
    """``(w, attr, val, pid)`` from groups and their partitions."""
    return groups.select("w", *GROUP, "attr", "val").join(assignment, ["w", *GROUP]).select(
        "w", "attr", "val", "pid"
    )


def partition_loads(routes: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct documents per partition: ``(w, pid, n_docs)`` from ``routes``.

    A partition of the window's ``table`` that received no document has load 0.
    """
    given = routes.select("w", F.explode("pids").alias("pid"), F.lit(1).cast("bigint").alias("n"))
    open_ = table.select("w", "pid").distinct().withColumn("n", F.lit(0).cast("bigint"))
    return given.unionByName(open_).groupBy("w", "pid").agg(F.sum("n").alias("n_docs"))


def least_loaded(loads: DataFrame) -> DataFrame:
    """The least loaded partition per window, the highest id among equals."""
    return loads.groupBy("w").agg(
        F.min(F.struct("n_docs", (-F.col("pid")).alias("neg"))).alias("_m")
    ).select("w", (-F.col("_m.neg")).alias("pid"), "_m.n_docs")


def partition_quality(routes: DataFrame) -> DataFrame:
    """``(w, n_docs, max_load, avg_comm)``: distinct routed documents, the largest
    partition, and copies per document."""
    docs = routes.groupBy("w").agg(F.count(F.lit(1)).alias("n_docs"))
    given = routes.select("w", F.explode("pids").alias("pid")).groupBy("w", "pid").agg(F.count(F.lit(1)).alias("n_docs"))
    loads = given.groupBy("w").agg(
        F.max("n_docs").alias("max_load"), F.sum("n_docs").alias("_copies")
    )
    return docs.join(loads, "w").select(
        "w", "n_docs", "max_load", (F.col("_copies") / F.col("n_docs")).alias("avg_comm")
    )


def choose_partition(table: DataFrame, new_documents: DataFrame, loads: DataFrame) -> DataFrame:
    """Partition each new document should be added to: ``(w, doc, pid, overlap)``.

    Most pairs in common first, then the least load, then the lowest id.  A document with
    no pair in common goes to the least loaded partition.  All documents of a batch see
    the table and loads as they stood when the batch began.
    """
    common = (
        shred(new_documents)
        .join(table, ["w", "attr", "val"])
        .groupBy("w", "doc", "pid")
        .agg(F.count(F.lit(1)).alias("overlap"))
        .join(loads, ["w", "pid"], "left")
    )
    order = F.struct((-F.col("overlap")).alias("neg"), F.coalesce("n_docs", F.lit(0)).alias("n"), "pid")
    best = common.groupBy("w", "doc").agg(F.min(order).alias("_b"))
    idle = loads.groupBy("w").agg(F.min(F.struct("n_docs", "pid")).alias("_idle"))
    return (
        new_documents.select("w", "doc")
        .join(best, ["w", "doc"], "left")
        .join(idle, "w", "left")
        .select(
            "w",
            "doc",
            F.coalesce("_b.pid", "_idle.pid").alias("pid"),
            F.coalesce(-F.col("_b.neg"), F.lit(0)).cast("bigint").alias("overlap"),
        )
    )


def update_partitions(table: DataFrame, new_documents: DataFrame, loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add every pair of each new document to its chosen partition, and one to the load.

    Returns the new table and the new loads.  A pair may then be in several partitions.
    """
    chosen = choose_partition(table, new_documents, loads)
    added = shred(new_documents).join(chosen, ["w", "doc"]).select("w", "attr", "val", "pid")
    grown = chosen.groupBy("w", "pid").agg(F.count(F.lit(1)).alias("_new"))
    return table.unionByName(added).distinct(), loads.join(grown, ["w", "pid"], "left").select(
        "w", "pid", (F.col("n_docs") + F.coalesce("_new", F.lit(0))).alias("n_docs")
    )
