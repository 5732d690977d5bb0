"""Association groups: pairs clustered by the documents they occur in.

A group is named by its first pair ``(g_attr, g_val)``; pairs belong to one group each,
so the name is unique in its window.  Document sets are never collected: they are
compared through counts and fingerprints that combine before the shuffle, so a pair
carried by a third of all documents is as cheap as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.pairs import shred
from docweave.operators.positions import with_position
from docweave.session import stage

GROUP = ["g_attr", "g_val"]


def _doc_set_fingerprint() -> list[Column]:
    """Aggregates that are equal for equal document sets: size, least and greatest id, and
    two independent 64-bit xor hashes (two different sets of one size agree on all five
    with a probability below 2**-128)."""
    return [
        F.count(F.lit(1)).alias("n_docs"),
        F.min("doc").alias("_lo"),
        F.max("doc").alias("_hi"),
        F.bit_xor(F.xxhash64(F.lit(1), "doc")).alias("_x1"),
        F.bit_xor(F.xxhash64(F.lit(2), "doc")).alias("_x2"),
    ]


_SET = ["n_docs", "_lo", "_hi", "_x1", "_x2"]


def _equivalence(pairs: DataFrame) -> DataFrame:
    sets = pairs.groupBy("w", "attr", "val").agg(*_doc_set_fingerprint())
    # All members of a group occur together in each of its documents, so a group is no
    # larger than one document and the window below stays small.
    first = F.min(F.struct("attr", "val")).over(Window.partitionBy("w", *_SET))
    return sets.withColumn("_g", first).select(
        "w",
        F.col("_g.attr").alias("g_attr"),
        F.col("_g.val").alias("g_val"),
        "n_docs",
        "attr",
        "val",
        F.col("_lo").alias("lo"),
        F.col("_hi").alias("hi"),
    )


def equivalence_groups(documents: DataFrame) -> DataFrame:
    """Pairs with the identical document set: ``(w, g_attr, g_val, n_docs, attr, val)``."""
    return _equivalence(shred(documents)).drop("lo", "hi")


def group_summary(groups: DataFrame) -> DataFrame:
    """One row per group: ``(w, g_attr, g_val, n_docs, n_pairs)``."""
    return groups.groupBy("w", *GROUP).agg(
        F.max("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_pairs")
    )


def order_groups(groups: DataFrame) -> DataFrame:
    """Groups of a window by document count, largest first: adds ``pos`` from 0.

    Equal counts are ordered by the group's name.
    """
    return with_position(
        group_summary(groups), ["w"], [F.desc("n_docs"), F.asc("g_attr"), F.asc("g_val")]
    )


def top_k_groups(groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` groups with most documents per window, with ``rank`` from 1.

    A rank limit, which Spark applies per task before it shuffles the survivors.
    """
    order = Window.partitionBy("w").orderBy(F.desc("n_docs"), F.asc("g_attr"), F.asc("g_val"))
    return (
        group_summary(groups)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def _first_candidates(pairs: DataFrame, eq: DataFrame) -> DataFrame:
    """Larger groups present in both the least and the greatest document of each group:
    ``(w, g, cand)`` where there is any.

    A group's containers occur in all of its documents, so two witnesses leave few
    candidates, and decide everything for groups with one or two documents.  Structs are
    ``(neg, g_attr, g_val)`` with ``neg`` the negative size, so their order is the group
    order.  Only the first pair of a group is looked up; the others occur with it.
    """
    names = eq.where("attr = g_attr AND val = g_val").select(
        "w", "attr", "val", (-F.col("n_docs")).alias("neg"), "lo", "hi"
    )
    name = F.struct("neg", F.col("attr").alias("g_attr"), F.col("val").alias("g_val"))
    # Per document: its groups, and which of them it is a witness of.
    per_doc = (
        pairs
        .join(names, ["w", "attr", "val"])
        .groupBy("w", "doc")
        .agg(
            F.collect_list(name).alias("gs"),
            F.collect_list(F.when((F.col("doc") == F.col("lo")) | (F.col("doc") == F.col("hi")), name)).alias("of"),
        )
    )
    return (
        per_doc.select("w", "gs", F.explode("of").alias("g"))
        .select("w", "g", F.expr("filter(gs, h -> h.neg < g.neg)").alias("larger"))
        .groupBy("w", "g")
        .agg(F.collect_list("larger").alias("seen"))
        .select("w", "g", F.array_intersect(F.col("seen")[0], F.element_at("seen", -1)).alias("cand"))
        .where(F.size("cand") > 0)
    )


def absorbers(pairs: DataFrame, eq: DataFrame) -> DataFrame:
    """For each group whose documents are a strict subset of another's: the first such
    other group in order, ``(w, g_attr, g_val, into)``.  ``pairs`` are the shredded documents.

    The first container in order is never itself contained in another one, since that
    would be larger and come earlier; so one pass settles all groups.  For candidates
    that two witnesses cannot decide, common documents are counted, combined before the
    shuffle, and compared with the size of the smaller group.
    """
    found = stage(_first_candidates(pairs, eq))
    settled = found.where("g.neg >= -2").select("w", "g", F.array_min("cand").alias("into"))
    unsure = found.where("g.neg < -2")
    none = F.lit(None).cast(found.schema["cand"].dataType).alias("cand")
    names = (
        unsure.select("w", "g.g_attr", "g.g_val", "cand", F.col("g.neg").alias("neg"))
        .unionByName(
            unsure.select("w", F.explode("cand").alias("h")).distinct().select("w", "h.g_attr", "h.g_val", none, "h.neg")
        )
        .groupBy("w", F.col("g_attr").alias("attr"), F.col("g_val").alias("val"), "neg")
        .agg(F.first("cand", ignorenulls=True).alias("cand"))
    )
    member = F.struct("neg", F.col("attr").alias("g_attr"), F.col("val").alias("g_val"))
    counted = (
        pairs
        .join(names, ["w", "attr", "val"])
        .groupBy("w", "doc")
        .agg(
            F.collect_list(member).alias("gs"),
            F.collect_list(F.when(F.col("cand").isNotNull(), F.struct(member.alias("g"), "cand"))).alias("open"),
        )
        .select("w", "gs", F.explode("open").alias("o"))
        .select("w", "o.g", F.explode(F.array_intersect("o.cand", "gs")).alias("h"))
        .groupBy("w", "g", "h")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == -F.col("g.neg"))
        .groupBy("w", "g")
        .agg(F.min("h").alias("into"))
    )
    return settled.unionByName(counted).select("w", "g.g_attr", "g.g_val", "into")


def association_groups(documents: DataFrame) -> DataFrame:
    """Equivalence groups with contained groups absorbed by the first larger one:
    ``(w, g_attr, g_val, n_docs, attr, val)`` with the absorber's name and documents."""
    # Read three times, which is cheaper than making the maps again.
    pairs = stage(shred(documents))
    eq = stage(_equivalence(pairs))
    into = absorbers(pairs, eq)
    return eq.join(into, ["w", *GROUP], "left").select(
        "w",
        F.coalesce("into.g_attr", "g_attr").alias("g_attr"),
        F.coalesce("into.g_val", "g_val").alias("g_val"),
        F.coalesce(-F.col("into.neg"), F.col("n_docs")).alias("n_docs"),
        "attr",
        "val",
    )


def local_association_groups(documents: DataFrame, shards: int, shard: Column | None = None) -> DataFrame:
    """Association groups found per shard: ``(w, shard, g_attr, g_val, n_docs, attr, val)``.

    Documents are dealt to ``shards`` by hash unless ``shard`` says where they go.
    """
    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)) if shard is None else shard
    dealt = documents.withColumn("shard", shard.cast("bigint"))
    inner = dealt.select(F.struct("w", "shard").alias("w"), "doc", "m")
    return association_groups(inner).select(
        "w.w", "w.shard", *GROUP, "n_docs", "attr", "val"
    )


def collect_local_groups(*parts: DataFrame) -> DataFrame:
    """Union of the groups of several shards or runs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_group_pairs(local: DataFrame) -> DataFrame:
    """Keep a pair only in the group with fewest pairs, sizes taken before any removal.

    Ties go to the group with most documents, then by name and shard.  Groups left
    without pairs vanish.
    """
    key = ["w", "shard", *GROUP]
    sizes = local.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pairs"))
    best = F.min(F.struct("n_pairs", (-F.col("n_docs")).alias("neg"), "g_attr", "g_val", "shard"))
    return (
        local.join(sizes, key)
        .groupBy("w", "attr", "val")
        .agg(best.alias("_b"))
        .select("w", "_b.shard", "_b.g_attr", "_b.g_val", "attr", "val")
    )


def regroup_global(kept: DataFrame, documents: DataFrame) -> DataFrame:
    """Document sets over all shards; groups whose sets are equal are merged.

    Returns ``(w, g_attr, g_val, n_docs, attr, val)`` named by the first pair.
    """
    key = ["w", "shard", *GROUP]
    docs = shred(documents).join(kept, ["w", "attr", "val"]).select(*key, "doc").distinct()
    sets = docs.groupBy(*key).agg(*_doc_set_fingerprint())
    named = kept.groupBy(*key).agg(F.min(F.struct("attr", "val")).alias("_first")).join(sets, key)
    # A group may hold very many pairs, so names are settled on one row per group first.
    merged = named.groupBy("w", *_SET).agg(F.min("_first").alias("_g"))
    names = named.join(merged, ["w", *_SET]).select(*key, "_g", "n_docs")
    return kept.join(names, key).select(
        "w", F.col("_g.attr").alias("g_attr"), F.col("_g.val").alias("g_val"), "n_docs", "attr", "val"
    )
