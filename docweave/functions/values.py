"""Scalar rules: how a value becomes comparable text, and predicates on pairs.

Everything here is a Catalyst expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = "struct<attr:string,val:string>"


def canonical_value(col: Column, nulls: str = "text") -> Column:
    """Comparable text of a scalar: types are erased, both ends trimmed.

    ``nulls='text'`` makes a null the text ``null`` (so null equals null);
    ``nulls='drop'`` leaves it NULL, which later reads as "attribute absent".
    """
    text = F.trim(col.cast("string"))
    if nulls == "drop":
        return text
    return F.coalesce(text, F.lit("null"))


def canonical_set_value(arr: Column) -> Column:
    """Array compared as a set: distinct members in sorted order, as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(arr)))


def canonical_set_text(text: Column) -> Column:
    """The same for an array that is still JSON text; other text is left alone."""
    arr = F.from_json(text, "array<string>")
    looks_like_array = F.trim(text).startswith("[") & arr.isNotNull()
    return F.when(looks_like_array, canonical_set_value(arr)).otherwise(text)


def pair(attr: Column, val: Column) -> Column:
    return F.struct(F.trim(attr).alias("attr"), F.trim(val).alias("val"))


def trim_pairs(pairs: Column) -> Column:
    """Trim both sides of every pair of an ``ARRAY<STRUCT<attr,val>>``."""
    ends = r"^[\x00-\x20]+|[\x00-\x20]+$"  # control characters count as space
    return F.transform(pairs, lambda p: pair(F.regexp_replace(p["attr"], ends, ""), F.regexp_replace(p["val"], ends, "")))


def pair_equal(x: Column, y: Column) -> Column:
    """Null-safe equality of two pair structs."""
    return x.eqNullSafe(y)


def same_attr(x: Column, y: Column) -> Column:
    return x["attr"].eqNullSafe(y["attr"])


def same_val(x: Column, y: Column) -> Column:
    return x["val"].eqNullSafe(y["val"])


def decode_pairs(encoded: Column, sep: str = "-") -> Column:
    """``ARRAY<'attr<sep>val'>`` to pairs, cutting at the first separator only."""
    s = F.lit(sep)
    return F.transform(
        encoded,
        lambda t: pair(
            F.when(F.contains(t, s), F.substring_index(t, sep, 1)).otherwise(t),
            F.when(F.contains(t, s), F.substr(t, F.locate(sep, t) + F.lit(len(sep)))).otherwise(
                F.lit("")
            ),
        ),
    )


def encode_pairs(pairs: Column, sep: str = "-") -> Column:
    """Pairs to ``ARRAY<'attr<sep>val'>``."""
    return F.transform(pairs, lambda p: F.concat_ws(sep, p["attr"], p["val"]))


def map_pairs(m: Column) -> Column:
    """Map to its pairs, sorted by attribute: the canonical array form of a document."""
    return F.array_sort(
        F.transform(
            F.map_entries(m), lambda e: F.struct(e["key"].alias("attr"), e["value"].alias("val"))
        )
    )


def pairs_map(pairs: Column) -> Column:
    """Pairs to map.  One value per attribute is assumed."""
    return F.map_from_entries(pairs)


def pair_overlap(x: Column, y: Column) -> Column:
    """Pairs two maps have in common."""
    return F.array_intersect(map_pairs(x), map_pairs(y))


def is_doc_subset(inner: Column, outer: Column) -> Column:
    """Whether every element of array ``inner`` is in array ``outer``."""
    return F.size(F.array_except(inner, outer)) == 0


def common_attrs(x: Column, y: Column) -> Column:
    return F.array_intersect(F.map_keys(x), F.map_keys(y))


def agree(x: Column, y: Column) -> Column:
    """No attribute carried by both maps has different values (values are never NULL)."""
    return F.forall(F.map_entries(x), lambda e: F.coalesce(F.try_element_at(y, e["key"]) == e["value"], F.lit(True)))


def conflicts(x: Column, y: Column) -> Column:
    """Some attribute carried by both maps has different values."""
    return ~agree(x, y)


def shares(x: Column, y: Column) -> Column:
    """At least one equal pair."""
    return F.exists(F.map_entries(x), lambda e: F.coalesce(F.try_element_at(y, e["key"]) == e["value"], F.lit(False)))


def merge_maps(x: Column, y: Column) -> Column:
    """Union of the pairs of two joinable documents."""
    return F.map_concat(x, F.map_filter(y, lambda k, _: ~F.map_contains_key(x, k)))
