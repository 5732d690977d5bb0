"""Choice of the core attributes of a natural join.

Joinable documents agree on every attribute both carry.  If the set of attributes of a
document, restricted to a short *core* list, is its *shape*, then two documents of
shapes S and T with S ∩ T not empty can only join when they are equal on S ∩ T: that is
an equi-join on those values.  Couples without a common core attribute must share a pair
outside the core, and come from the inverted index.  Any core gives the exact result;
the choice here only decides how many rows and false candidates the plan produces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.stats import pair_counts, universal_attrs

MAX_CORE = 16
SMALL_SCHEMA = 5
HOT = 4096  # documents per key above which a join key is split into cells
FREQUENT = 256  # documents per pair above which the index join takes its attribute as key


@dataclass(frozen=True)
class Core:
    """``attrs``: the core list.  ``rest``: other attributes may exist and must be checked.
    ``index``: two joinable documents may have no core attribute in common.  ``hot``: some
    pair may be carried by more than ``HOT`` documents of one window, so keys must be
    split.  All three default to the safe answer.  ``emits`` and ``postings``: about how many
    rows both sides of the shape join and of the index join have, ``window``: the most documents
    with pairs that one window has, 0 if that is not known."""

    attrs: tuple[str, ...]
    rest: bool = True
    index: bool = True
    hot: bool = True
    emits: float = field(default=0, compare=False)
    postings: float = field(default=0, compare=False)
    window: int = field(default=0, compare=False)


def _frequent_attrs(documents: DataFrame, limit: int) -> tuple[list, int, int]:
    """The ``limit`` most frequent attributes as rows ``(attr, n, most)``, the number of
    non-empty documents and the most of them in one window.  ``most`` is the most documents of one
    window carrying the attribute.

    A bounded top-k reaches the driver; counting shuffles one row per window and attribute
    from each task.
    """
    # A NULL entry next to the attributes of each document counts the documents themselves.
    entries = F.explode(F.concat(F.map_keys("m"), F.array(F.lit(None).cast("string"))))
    rows = (
        documents.where(F.size("m") > 0)
        .select("w", entries.alias("attr"))
        .groupBy("w", "attr")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("attr")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        .orderBy(F.desc("n"), F.asc_nulls_first("attr"))
        .limit(limit + 1)
        .collect()
    )
    total, window = next(((r["n"], r["most"]) for r in rows if r["attr"] is None), (0, 0))
    return [r for r in rows if r["attr"] is not None], total, window


def _index_candidates(documents: DataFrame, attrs: tuple[str, ...]) -> tuple[dict[str, float], int]:
    """Couples the index would enumerate through each of ``attrs``, and the most documents that carry one pair of them."""
    counts = pair_counts(documents).where(F.col("attr").isin(list(attrs)))
    cost = F.sum(F.col("n_docs") * (F.col("n_docs") - 1) / 2).alias("candidates")
    rows = counts.groupBy("attr").agg(cost, F.max("n_docs").alias("most")).collect()
    return {r["attr"]: r["candidates"] for r in rows}, max((r["most"] for r in rows), default=0)


def shape_mask(attrs: tuple[str, ...]) -> Column:
    """Bit i is set when the document carries core attribute i."""
    mask = F.lit(0).cast("bigint")
    for i, attr in enumerate(attrs):
        mask = mask + F.when(F.map_contains_key("m", attr), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def common_key(n: int) -> Column:
    """Join key of shapes ``s`` and ``t``: the values of their common core attributes, the
    other places empty.  Both shapes are part of the key, so an empty place is unambiguous."""
    common = F.expr("s & t")
    at = lambda i: F.when(common.bitwiseAND(1 << i) != 0, F.get("vals", F.lit(i))).otherwise("")
    return F.array(*[at(i) for i in range(n)])


def key_text(n: int) -> Column:
    """``common_key`` as one text, which takes a fraction of the array's bytes in a shuffle.

    Values are preceded by their length, so no two lists of values give the same text.
    """
    common = F.expr("s & t")
    value = lambda i: F.get("vals", F.lit(i))
    sized = lambda i: F.coalesce(F.concat(F.length(value(i)).cast("string"), F.lit(":"), value(i)), F.lit("-"))
    return F.concat(*[F.when(common.bitwiseAND(1 << i) != 0, sized(i)).otherwise("") for i in range(n)])


def _replicated_rows(documents: DataFrame, attrs: tuple[str, ...]) -> dict[int, float]:
    """For every prefix of ``attrs``: an upper bound of the rows the shape join emits.

    Per window, documents times distinct shapes.  Shapes are counted from the distinct
    masks, of which a window has at most ``2 ** len(attrs)``.
    """
    masks = documents.select("w", shape_mask(attrs).alias("mask")).groupBy("w", "mask").agg(
        F.count(F.lit(1)).alias("n")
    )
    prefix = F.explode(F.sequence(F.lit(1), F.lit(len(attrs)))).alias("p")
    shapes = (
        masks.select("w", "mask", "n", prefix)
        .withColumn("mask", F.expr("mask & (shiftleft(1L, p) - 1)"))
        .groupBy("w", "p", "mask")
        .agg(F.sum("n").alias("n"))
        .groupBy("w", "p")
        .agg((F.sum("n") * F.count(F.lit(1))).cast("double").alias("rows"))
    )
    return {r["p"]: r["rows"] for r in shapes.groupBy("p").agg(F.sum("rows").alias("rows")).collect()}


def _all_pairs(documents: DataFrame) -> float:
    return documents.agg(F.sum(F.size("m").cast("double"))).first()[0] or 0.0


def _cheapest_prefix(documents: DataFrame, names: tuple[str, ...]) -> tuple[int, float, int]:
    """How many of ``names`` to take so that emitted shape rows plus index candidates
    through the others are fewest, those shape rows, and the most documents that carry one pair of ``names``."""
    emitted = _replicated_rows(documents, names)
    candidates, most = _index_candidates(documents, names)
    best, best_cost = 0, sum(candidates.values())
    for p in range(1, len(names) + 1):
        cost = emitted[p] + sum(candidates[a] for a in names[p:])
        if cost <= best_cost:
            best, best_cost = p, cost
    return best, emitted.get(best, 0.0), most


def choose_core(documents: DataFrame, max_core: int = MAX_CORE, hot: int = HOT) -> Core:
    """Core that minimises emitted shape rows plus index candidates.

    Most frequent attributes come first: an attribute in every document adds no shape
    but makes the join key more selective.
    """
    top, total, window = _frequent_attrs(documents, max_core + 1)
    names = tuple(r["attr"] for r in top[:max_core])
    more = len(top) > max_core
    # No pair is more frequent than its attribute, and none than its window has documents.
    any_hot = window > hot and (more or any(r["most"] > hot for r in top))
    if not top:
        return Core(())
    if len(top) <= min(SMALL_SCHEMA, max_core):
        return Core(names, rest=False, index=False, hot=any_hot, emits=total * 2.0 ** len(names), window=window)
    best, emits, pair = _cheapest_prefix(documents, names)
    any_hot = any_hot and (more or pair > hot)  # a key is no more frequent than each of its pairs
    rest = more or best < len(names)
    # One attribute that no document lacks gives every two documents a common one.
    covered = best > 0 and top[0]["n"] == total
    pairs = _all_pairs(documents) if more else sum(r["n"] for r in top)
    postings = 2 * (pairs - sum(r["n"] for r in top[:best]))
    return Core(names[:best], rest, rest and not covered, any_hot, emits, postings, window)


def _key_couples(documents: DataFrame, attrs: tuple[str, ...]) -> tuple[float, float]:
    """Rows the shape join emits with ``attrs`` as core, and couples of rows that meet at its keys.

    Equal core values are counted first, so a frequent key is a few rows per task.
    """
    vals = F.array(*[F.try_element_at("m", F.lit(a)) for a in attrs]).cast("array<string>")
    n = F.count(F.lit(1)).cast("double").alias("n")
    rows = documents.select("w", shape_mask(attrs).alias("s"), vals.alias("vals")).where("s != 0")
    rows = rows.groupBy("w", "s", "vals").agg(n)
    shapes = rows.select("w", F.col("s").alias("t")).distinct()
    met = rows.join(shapes, "w").where("(s & t) != 0").select(
        "w", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), F.xxhash64(common_key(len(attrs))).alias("key"),
        F.when(F.col("s") <= F.col("t"), F.col("n")).otherwise(0).alias("l"),
        F.when(F.col("s") >= F.col("t"), F.col("n")).otherwise(0).alias("r"),
    )
    sides = met.groupBy("w", "lo", "hi", "key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    got = sides.agg(F.sum(F.col("l") + F.col("r")), F.sum(F.col("l") * F.col("r"))).first()
    return got[0] or 0.0, got[1] or 0.0


def _selective(documents: DataFrame, names: tuple[str, ...], max_core: int, hot: int) -> tuple[tuple[str, ...], float]:
    """``names`` and as many further attributes, most frequent first, as it takes until rows meet
    at most ``hot`` others on average, or the best of the lists tried; and the rows that are emitted with them.

    Frequent attributes alone make keys as frequent as their pairs.
    """
    more = [r["attr"] for r in _frequent_attrs(documents, max_core)[0] if r["attr"] not in names]
    best, least, rows = names, float("inf"), 0.0
    while True:
        emitted, met = _key_couples(documents, names)
        if emitted + met < least:
            best, least, rows = names, emitted + met, emitted
        if met <= hot * emitted or not more or len(names) == max_core:
            return best, rows
        names = (*names, more.pop(0))


def hot_core(documents: DataFrame, max_core: int = MAX_CORE, hot: int = FREQUENT) -> Core:
    """Core of the index join: only attributes with a pair too frequent to enumerate, most
    frequent pair first, as far as taking them pays off.

    Where keys made of them hold too many documents, less frequent attributes join them; keys
    are split like any hot key.
    """
    per_attr = pair_counts(documents).groupBy("attr").agg(F.max("n_docs").alias("f_max"))
    top = per_attr.where(F.col("f_max") > hot).orderBy(F.desc("f_max"), F.asc("attr"))
    names = tuple(r["attr"] for r in top.limit(max_core).collect())
    if len(names) > SMALL_SCHEMA:
        names = names[: _cheapest_prefix(documents, names)[0]]
    emits = 0.0
    if names:
        names, emits = _selective(documents, names, max_core, hot)
    return Core(names, rest=True, hot=bool(names), emits=emits, postings=2 * _all_pairs(documents))


def universal_core(documents: DataFrame, max_core: int = MAX_CORE, hot: int = HOT) -> Core:
    """Core of the universal-attribute join: attributes universal in the most windows.

    When one of them is universal in all windows the index part has nothing to find.
    """
    seen = (
        universal_attrs(documents)
        .groupBy("attr")
        .agg(F.count(F.lit(1)).alias("windows"), F.max("n_docs").alias("most_docs"))
        .orderBy(F.desc("windows"), F.asc("attr"))
        .limit(max_core)
        .collect()
    )
    windows = documents.where(F.size("m") > 0).select("w").distinct().count()
    everywhere = [r for r in seen if r["windows"] == windows]
    # Attributes universal only in some windows may form many shapes in the others.
    names = tuple(r["attr"] for r in seen)
    if len(seen) - len(everywhere) > SMALL_SCHEMA:
        names = names[: max(len(everywhere), _cheapest_prefix(documents, names)[0])]
    index = not everywhere
    any_hot = index or any(r["most_docs"] > hot for r in seen)
    return Core(names, rest=True, index=index, hot=any_hot)
