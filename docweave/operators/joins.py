"""The windowed natural self-join and what is derived from it.

``natural_join`` and its variants return each joinable couple of a window once, as
``(w, a, b)`` with ``a < b``.  They differ only in which attributes form the join key
(see ``docweave.plans.core_attributes``); all are exact.

Cost of the shape join: a document is emitted once per shape of its window it can meet,
and when the core holds all attributes every row the join produces is a result.  No plan
here enumerates the members of a frequent pair against each other and filters later.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators.pairs import explode_pairs
from docweave.operators.positions import part_of
from docweave.plans.core_attributes import (
    FREQUENT,
    HOT,
    MAX_CORE,
    Core,
    choose_core,
    hot_core,
    key_text,
    shape_mask,
    universal_core,
)
from docweave.session import stage


TASK = 1_000_000  # rows of some 100 bytes that a task of a join reads
MAX_SHAPES = 512  # shapes listed for every row; more are met by a join


def _sides(documents: DataFrame, core: Core, by: list[str], keep: list[str]) -> DataFrame:
    """Project documents to what the join needs: shape, core values and the rest map."""
    cols = [F.col(c) for c in by] + ["doc", shape_mask(core.attrs).alias("mask")]
    cols.append(
        F.array(*[F.try_element_at("m", F.lit(a)) for a in core.attrs]).cast("array<string>").alias("vals")
    )
    if core.rest:
        rest = F.col("m")
        if core.attrs:
            rest = F.map_filter("m", lambda k, _: ~k.isin(list(core.attrs)))
        cols.append(rest.alias("rest"))
    return documents.select(*cols, *[F.col(c) for c in keep])


def _split_hot_keys(left: DataFrame, right: DataFrame, keys: list[str], cell: int):
    """Cut join keys with many rows on a side into a grid of (left part, right part) cells.

    Left rows fall into one of ``ceil(n_left / cell)`` parts and are copied to every right
    part, and the other way round, so each pair of rows still meets in exactly one cell
    and no task handles more than about ``cell x cell`` combinations of one key.  Counting
    uses 64-bit key hashes, combined before the shuffle; a hash collision would only add
    parts, never change the result.
    """
    h = F.xxhash64(*keys).alias("_h")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    if right is left:
        sides = left.select(h, one.alias("nl"), one.alias("nr"))
    else:
        sides = left.select(h, one.alias("nl"), zero.alias("nr")).unionAll(right.select(h, zero.alias("nl"), one.alias("nr")))
    # Staged, so that few hot keys are known to be few, and all rows need not move to meet them.
    counts = stage(
        sides.groupBy("_h")
        .agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
        .where(((F.col("nl") > cell) | (F.col("nr") > cell)) & (F.col("nl") > 0) & (F.col("nr") > 0))
        .select(
            "_h",
            F.ceil(F.col("nl") / cell).alias("_pl"),
            F.ceil(F.col("nr") / cell).alias("_pr"),
        )
    )
    pl, pr = F.coalesce("_pl", F.lit(1)), F.coalesce("_pr", F.lit(1))

    def parts(df: DataFrame, own: Column, other: Column, own_name: str, other_name: str):
        return (
            df.withColumn("_h", F.xxhash64(*keys))
            .join(counts, "_h", "left")
            .withColumn(own_name, F.pmod(F.xxhash64("doc", F.lit(own_name)), own))
            .withColumn(other_name, F.explode(F.sequence(F.lit(0).cast("bigint"), other - 1)))
            .drop("_h", "_pl", "_pr")
        )

    return parts(left, pl, pr, "_gl", "_gr"), parts(right, pr, pl, "_gr", "_gl"), [*keys, "_gl", "_gr"]


def _by_window(left: DataFrame, right: DataFrame, by: list[str], self_join: bool, rows: float) -> DataFrame:
    """Rows of both sides, with whole windows in tasks; where the sides differ, ``first`` tells them apart.

    A row is sent once, before it is copied to shapes or pairs, for both sides of a self-join.
    """
    if not self_join:
        left = left.withColumn("first", F.lit(True)).unionByName(right.withColumn("first", F.lit(False)))
    for c in by:
        left = left.where(F.col(c).isNotNull())
    tasks = math.ceil(rows / TASK)
    more = tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, *by) if more else left.repartition(*by)


def _shapes_here(rows: DataFrame, by: list[str], self_join: bool) -> tuple[DataFrame, Column]:
    """Rows of whole windows once per shape of their window they can meet, as ``s`` and ``t``, and
    which of them are left ones."""
    window, own, other = Window.partitionBy(*by), F.col("mask"), F.col("other")
    if self_join:
        met, first = F.collect_set("mask").over(window), own <= other
        s, t = F.least(own, other), F.greatest(own, other)
    else:
        first = F.col("first")
        sides = [F.collect_set(F.when(f, own)).over(window) for f in (first, ~first)]
        met = F.when(first, sides[1]).otherwise(sides[0])
        s, t = F.when(first, own).otherwise(other), F.when(first, other).otherwise(own)
    meets = lambda o: o.bitwiseAND(own) != 0
    return rows.withColumn("_met", met).withColumn("other", F.explode(F.filter("_met", meets))).withColumns({"s": s, "t": t}).drop("_met"), first


def _listed(rows: DataFrame, keys: list[str], first: Column, alike: Column) -> DataFrame:
    """What ``_expand_matches`` gives, from the list of right rows of each key.

    No list is longer than its window.  A window function, unlike a join, takes rows of
    whole windows as they lie.  Where ``alike``, left rows are the right ones as well.
    """
    kept = [c for c in rows.columns if c not in (*keys, "first")]
    # The hash comes first because rows are sorted by the keys, and numbers compare fastest.
    rows = rows.withColumn("_h", F.xxhash64(*keys))
    here = Window.partitionBy("_h", *keys)
    met = rows.withColumn("_bs", F.collect_list(F.when(alike | ~first, F.struct(*kept))).over(here))
    met = met.where(first & (F.size("_bs") > F.when(alike, 1).otherwise(0)))
    pairs = met.select(*keys, *[F.col(c).alias(f"{c}_a") for c in kept], F.explode("_bs").alias("_b"))
    return pairs.select(*keys, *[f"{c}_a" for c in kept], *[F.col(f"_b.{c}").alias(f"{c}_b") for c in kept])


def _side(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keys])


def _expand_matches(left: DataFrame, right: DataFrame, keys: list[str], rows: float) -> DataFrame:
    """The join that produces couples, always as a shuffled sort-merge join.

    Its output can be far larger than its inputs, so even small inputs are spread over
    the cluster by key instead of being broadcast into the tasks that read them, and
    sorted runs spill where a hash table would have to fit.  Where the session's tasks would read
    more than ``TASK`` of the ``rows`` of both sides each, there are more of them.
    """
    left, right = _side(left, keys, "a"), _side(right, keys, "b")
    tasks = math.ceil(rows / TASK)
    if tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right.hint("merge"), keys)


def _all_shapes(left: DataFrame, right: DataFrame, by: list[str]) -> list[int] | None:
    """The shapes of all documents, if most windows have most of them and they are few; else None."""
    seen = left.select(*by, "mask")
    seen = seen if right is left else seen.unionAll(right.select(*by, "mask"))
    seen = stage(seen.where("mask != 0").distinct())
    masks = seen.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SHAPES + 1).collect()
    if len(masks) > MAX_SHAPES or len(masks) * seen.select(*by).distinct().count() > 2 * sum(r["n"] for r in masks):
        return None
    return sorted(r["mask"] for r in masks)


def _met_shapes(left: DataFrame, right: DataFrame, by: list[str], self_join: bool) -> tuple[DataFrame, DataFrame]:
    """Left rows once per shape ``t`` they can meet, right rows once per shape ``s``.

    Shape 0 meets none, so documents without core attributes drop out here.  Where windows have
    their shapes in common, each row is copied where it is read: a join on window and shape
    would bring all rows of one shape into one task.
    """
    shapes = _all_shapes(left, right, by)
    if shapes is not None:
        every = F.array(*[F.lit(m).cast("bigint") for m in shapes]).cast("array<bigint>")
        own = F.col("mask")
        meets = lambda o, below, above: (o.bitwiseAND(own) != 0) & ((below <= above) if self_join else F.lit(True))
        ts = F.explode(F.filter(every, lambda t: meets(t, own, t))).alias("t")
        ss = F.explode(F.filter(every, lambda s: meets(s, s, own))).alias("s")
        l = left.select("*", ts).withColumnRenamed("mask", "s")
        return l, right.select("*", ss).withColumnRenamed("mask", "t")
    s = left.select(*by, F.col("mask").alias("s")).distinct()
    t = right.select(*by, F.col("mask").alias("t")).distinct()
    # Shapes meeting shapes inside a window: at most 2 ** |core| of each, whatever the
    # number of documents.
    meet = s.join(t, by).where("(s & t) != 0")
    if self_join:
        meet = meet.where("s <= t")
    return (
        left.withColumnRenamed("mask", "s").join(meet, [*by, "s"]),
        right.withColumnRenamed("mask", "t").join(meet, [*by, "t"]),
    )


def _shape_couples(left: DataFrame, right: DataFrame, core: Core, by: list[str], self_join: bool, cell: int) -> DataFrame:
    """Couples whose documents have at least one core attribute in common."""
    key, keys = key_text(len(core.attrs)), [*by, "s", "t", "key"]
    if 0 < core.window <= cell:
        rows, first = _shapes_here(_by_window(left, right, by, self_join, core.emits), by, self_join)
        rows = rows.withColumn("key", key).withColumn("first", first).drop("vals", "mask", "other")
        joined = _listed(rows, keys, F.col("first"), F.col("s") == F.col("t") if self_join else F.lit(False))
    else:
        l, r = _met_shapes(left, right, by, self_join)
        l, r = l.withColumn("key", key).drop("vals"), r.withColumn("key", key).drop("vals")
        if core.hot:
            l, r, keys = _split_hot_keys(l, r, keys, cell)
        joined = _expand_matches(l, r, keys, core.emits)
    if self_join:
        joined = joined.where("s < t OR doc_a < doc_b")
    else:
        joined = joined.where("doc_a != doc_b")
    n = F.bit_count(F.expr("s & t")).cast("bigint")
    if core.rest:
        joined = joined.where(V.agree(F.col("rest_a"), F.col("rest_b")))
        n = n + F.size(V.common_attrs(F.col("rest_a"), F.col("rest_b")))
    return joined.withColumn("n_shared", n)


def _index_couples(left: DataFrame, right: DataFrame, core: Core, by: list[str], self_join: bool, cell: int) -> DataFrame:
    """Couples without a common core attribute, found through a pair outside the core.

    A couple that shares several pairs is kept at the first of them only, decided inside
    the join, so no deduplicating shuffle follows.
    """

    def postings(df: DataFrame) -> DataFrame:
        return explode_pairs(df.drop("vals"), ["*"], F.col("rest"))

    keys = [*by, "attr", "val"]
    if 0 < core.window <= cell:
        rows = postings(_by_window(left, right, by, self_join, core.postings)).where("val IS NOT NULL")
        joined = _listed(rows, keys, F.lit(True) if self_join else F.col("first"), F.lit(self_join))
    else:
        l = postings(left)
        r = l if right is left else postings(right)
        if core.hot:
            l, r, keys = _split_hot_keys(l, r, keys, cell)
        joined = _expand_matches(l, r, keys, core.postings)
    joined = joined.where("doc_a < doc_b" if self_join else "doc_a != doc_b")
    if core.attrs:
        joined = joined.where("(mask_a & mask_b) = 0")
    shared = V.common_attrs(F.col("rest_a"), F.col("rest_b"))
    joined = joined.where(V.agree(F.col("rest_a"), F.col("rest_b"))).where(
        F.array_min(shared) == F.col("attr")
    )
    return joined.withColumn("n_shared", F.size(shared).cast("bigint"))


def couples(
    left: DataFrame,
    right: DataFrame | None,
    core: Core,
    by: tuple[str, ...] = ("w",),
    keep: tuple[str, ...] = (),
    cell: int = HOT,
) -> DataFrame:
    """Joined rows with ``by``, ``doc_a``, ``doc_b``, ``n_shared`` and kept columns.

    ``right=None`` is the self-join of ``left``; each couple then appears once, in either
    orientation.
    """
    by, keep = list(by), list(keep)
    l = _sides(left, core, by, keep)
    r = l if right is None else _sides(right, core, by, keep)
    self_join = right is None
    out = [*by, "doc_a", "doc_b", "n_shared", *[f"{c}_{s}" for c in keep for s in "ab"]]
    found = []
    if core.attrs:
        found.append(_shape_couples(l, r, core, by, self_join, cell).select(*out))
    if core.index:
        found.append(_index_couples(l, r, core, by, self_join, cell).select(*out))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _ordered(joined: DataFrame, shared: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    cols = ["w", F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")]
    first, last = ("a", "b"), ("b", "a")
    kept = [
        F.when(F.col("doc_a") <= F.col("doc_b"), F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}")
        for c in keep for x, y in (first, last)
    ]
    return joined.select(*cols, *(["n_shared"] if shared else []), *kept)


def natural_join(
    documents: DataFrame, core: Core | None = None, shared: bool = False, max_core: int = MAX_CORE, cell: int = HOT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """All joinable couples per window, with the core chosen by cost.

    Ids must be unique within a window; ``dedupe_documents`` makes them so.
    Pass ``core`` to reuse an earlier choice and skip the statistics jobs.
    ``shared=True`` adds ``n_shared``, the number of equal pairs of the couple; ``keep`` names
    columns of the documents to add as ``<name>_a`` and ``<name>_b``.
    """
    core = core or choose_core(documents, max_core, cell)
    return _ordered(couples(documents, None, core, keep=keep, cell=cell), shared, keep)


def natural_join_index(documents: DataFrame, shared: bool = False, frequent: int = FREQUENT, cell: int = HOT) -> DataFrame:
    """Inverted-index join: candidates share a pair.

    Attributes with a pair carried by more than ``frequent`` documents of a window become
    join keys instead, so posting lists longer than that are not enumerated.
    """
    return _ordered(couples(documents, None, hot_core(documents, hot=frequent), cell=cell), shared)


def natural_join_universal(documents: DataFrame, shared: bool = False, cell: int = HOT) -> DataFrame:
    """Equi-join on the attributes every document carries; only the others are checked."""
    return _ordered(couples(documents, None, universal_core(documents, hot=cell), cell=cell), shared)


def natural_join_partitioned(documents: DataFrame, routes: DataFrame, core: Core | None = None, cell: int = HOT) -> DataFrame:
    """Join inside each partition of ``routes (w, doc, pids)`` and unite the results.

    A couple meeting in several partitions is emitted in the smallest common one, where the
    smaller partitions of the two, which each copy carries, have nothing in common.  The
    routed documents are staged, one row each, because the join reads them several times.
    """
    core = core or choose_core(documents, hot=cell)
    routed = stage(documents.select("w", "doc", "m").join(routes.select("w", "doc", "pids"), ["w", "doc"]))
    pids = routed.withColumn("pids", F.sort_array("pids"))
    placed = pids.select("w", "doc", "m", "pids", F.posexplode("pids").alias("at", "pid"))
    placed = placed.select("w", "doc", "m", "pid", F.slice("pids", F.lit(1), F.col("at")).alias("below"))
    copies = routed.agg(F.avg(F.size("pids"))).first()[0] or 1.0
    core = replace(core, emits=core.emits * copies, postings=core.postings * copies)
    joined = couples(placed, None, core, by=("w", "pid"), keep=("below",), cell=cell)
    return _ordered(joined.where(~F.arrays_overlap("below_a", "below_b")), False)


def joinable_with(probe: DataFrame, documents: DataFrame, core: Core | None = None, cell: int = HOT) -> DataFrame:
    """Partners in ``documents`` of each ``probe`` document: ``(w, doc, partner)``."""
    core = replace(core or choose_core(documents, hot=cell), window=0)  # probes were not counted
    if not core.rest:
        # A probe may carry attributes that no document has; they never matter.
        probe = probe.withColumn("m", F.map_filter("m", lambda k, _: k.isin(list(core.attrs))))
    return couples(probe, documents, core, cell=cell).select(
        "w", F.col("doc_a").alias("doc"), F.col("doc_b").alias("partner")
    )


def symmetric(joined: DataFrame) -> DataFrame:
    """Couples as ``(w, doc, partner)`` in both directions."""
    both = F.array(
        F.struct(F.col("a").alias("doc"), F.col("b").alias("partner")),
        F.struct(F.col("b").alias("doc"), F.col("a").alias("partner")),
    )
    return joined.select("w", F.explode(both).alias("_c")).select("w", "_c.doc", "_c.partner")


def joinable_sets(joined: DataFrame, documents: DataFrame, parts: int = 1) -> DataFrame:
    """Partner set of every document, empty ones included: ``(w, doc, part, partners)``.

    Every document's partners are dealt to ``parts`` rows by hash, whatever the size of the
    window; rows without a partner are left out.  A document without any partner has one
    row, part 0, with an empty list.
    """
    part = part_of("partner", parts).alias("part")
    # Staged, because the join would else run again for the documents without partners.
    some = stage(
        symmetric(joined)
        .groupBy("w", "doc", part)
        .agg(F.sort_array(F.collect_list("partner")).alias("partners"))
    )
    alone = documents.select("w", "doc").join(some.select("w", "doc"), ["w", "doc"], "left_anti")
    empty = F.array().cast(some.schema["partners"].dataType)
    return some.unionByName(alone.select("w", "doc", F.lit(0).cast("bigint").alias("part"), empty.alias("partners")))


def merged_documents(joined: DataFrame, documents: DataFrame) -> DataFrame:
    """The joined documents themselves: ``(w, a, b, m)`` with the pairs of both sides."""
    left = documents.select("w", F.col("doc").alias("a"), F.col("m").alias("_ma"))
    right = documents.select("w", F.col("doc").alias("b"), F.col("m").alias("_mb"))
    return (
        joined.select("w", "a", "b")
        .join(left, ["w", "a"])
        .join(right, ["w", "b"])
        .select("w", "a", "b", V.merge_maps(F.col("_ma"), F.col("_mb")).alias("m"))
    )
