"""Expansion: low-variety attributes joined into one composite pair for routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_expansion(ranked: DataFrame, k: int) -> DataFrame:
    """Attributes to combine so that about ``k`` distinct values exist: ``(w, attr, rank)``.

    Walks the ranking of ``rank_attrs``: nothing when the first attribute alone has ``k``
    values, else attributes until the sum of their distinct values reaches ``k``.  Every
    attribute has at least one value, so ranks beyond ``k`` cannot be chosen and are cut
    before the running sum.
    """
    order = Window.partitionBy("w").orderBy("rank")
    earlier = F.sum("n_vals").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("n_vals").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        ranked.where(F.col("rank") <= k)
        .select("w", "attr", "rank", F.coalesce(earlier, F.lit(0)).alias("_before"), first.alias("_first"))
        .where((F.col("_first") < k) & (F.col("_before") < k))
        .select("w", "attr", "rank")
    )


def expansion_attrs(chosen: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """One row per window: ``(w, attrs)`` in rank order, at most ``k`` names each.

    With ``windows (w)`` given, windows without expansion are present with an empty list.
    """
    lists = chosen.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("rank", "attr"))).alias("_l"))
    names = F.transform("_l", lambda x: x["attr"])
    if windows is None:
        return lists.select("w", names.alias("attrs"))
    empty = F.array().cast("array<string>")
    return windows.join(lists, "w", "left").select("w", F.coalesce(names, empty).alias("attrs"))


def composite_attr(attrs: Column) -> Column:
    """Name of the composite: the JSON list of the attribute names, so it cannot be
    mistaken whatever characters names contain."""
    return F.to_json(attrs)


def expand(documents: DataFrame, expansion: DataFrame, enabled: bool = True) -> DataFrame:
    """Replace the chosen pairs of complete documents by one composite pair.

    Returns ``(w, doc, m, route_all, composite, ...)``.  Documents that lack a chosen
    attribute keep their pairs and get ``route_all``: they may join complete ones, so they
    go everywhere.  ``composite`` is the name of the new pair, NULL where there is none.
    """
    if not enabled:
        return documents.withColumn("route_all", F.lit(False)).withColumn(
            "composite", F.lit(None).cast("string")
        )
    # The old map is renamed before the new one is built: a lambda in the same select
    # would otherwise read the new ``m``.
    joined = documents.withColumnRenamed("m", "_m").join(expansion, "w", "left").withColumn(
        "attrs", F.coalesce("attrs", F.array().cast("array<string>"))
    )
    attrs = F.col("attrs")
    complete = F.forall(attrs, lambda a: F.map_contains_key("_m", a))
    values = F.to_json(F.transform(attrs, lambda a: F.try_element_at("_m", a)))
    expanded = F.map_concat(
        F.map_filter("_m", lambda k, _: ~F.array_contains(attrs, k)),
        F.create_map(composite_attr(attrs), values),
    )
    replaced = (F.size(attrs) > 0) & complete
    others = [c for c in documents.columns if c != "m"]
    return joined.select(
        *others,
        F.when(replaced, expanded).otherwise(F.col("_m")).alias("m"),
        ((F.size(attrs) > 0) & ~complete).alias("route_all"),
        F.when(replaced, composite_attr(attrs)).alias("composite"),
    )


def contract(documents: DataFrame, expansion: DataFrame) -> DataFrame:
    """Inverse of ``expand``: the composite pair back to the original pairs."""
    name = composite_attr(F.col("attrs"))
    values = F.from_json(F.try_element_at("m", name), "array<string>")
    original = F.map_concat(
        F.map_filter("m", lambda k, _: k != name), F.map_from_arrays(F.col("attrs"), values)
    )
    has = F.coalesce((F.size("attrs") > 0) & F.map_contains_key("m", name), F.lit(False))
    others = [c for c in documents.columns if c not in ("m", "route_all", "composite")]
    return documents.join(expansion, "w", "left").select(
        *others, F.when(has, original).otherwise(F.col("m")).alias("m")
    )
