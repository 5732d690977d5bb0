"""Natural joins over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators.pairs import explode_pairs
from docweave.plans.core_attributes import common_key, shape_mask

MAX_STREAM_CORE = 5


def _windowed(documents: DataFrame, duration: str, delay: str, core: tuple[str, ...]) -> DataFrame:
    rest = F.col("m")
    if core:
        rest = F.map_filter("m", lambda k, _: ~k.isin(list(core)))
    vals = F.array(*[F.try_element_at("m", F.lit(a)) for a in core]).cast("array<string>")
    return (
        documents.withWatermark("ts", delay)
        .withColumn("win", F.window("ts", duration))
        .select("win", "doc", shape_mask(core).alias("mask"), vals.alias("vals"), rest.alias("rest"))
    )


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Stream-stream equi-join on the window and ``keys``.

    The window is an event-time column of both sides, so state of a window is dropped once
    the watermark passes its end.
    """
    l = left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns])
    r = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    on = F.col("win_a") == F.col("win_b")
    for k in keys:
        on = on & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    return l.join(r, on)


def _in_cells(postings: DataFrame, cells: dict[str, int], copies: bool) -> DataFrame:
    """Postings with ``cell``: one of the attribute's declared cells by document, or a copy for each."""
    number = F.lit(1)
    for attr, n in cells.items():
        number = F.when(F.col("attr") == attr, n).otherwise(number)
    if copies:
        return postings.withColumn("cell", F.explode(F.sequence(F.lit(0), number - 1)))
    return postings.withColumn("cell", F.pmod(F.xxhash64("doc"), number).cast("int"))


def _by_shape(postings: DataFrame, attrs: list[str], right: bool) -> DataFrame:
    """Postings of ``attrs`` (in their order) once per shape of the documents they can meet, as ``s``, ``t`` and ``key``.

    The shape says which of ``attrs`` a document carries.  A couple is produced at its first common
    attribute, so a posting meets no document that shares an earlier one, and only those equal in
    the later ones that both carry.  The lesser shape is on the left.  Other postings have shape 0.
    """
    bit, own = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i, attr in enumerate(attrs):
        bit = F.when(F.col("attr") == attr, F.lit(1 << i).cast("bigint")).otherwise(bit)
        own = own + F.when(F.map_contains_key("rest", attr), F.lit(1 << i)).otherwise(F.lit(0))
    vals = F.array(*[F.try_element_at("rest", F.lit(a)) for a in attrs]).cast("array<string>")
    shaped = postings.withColumn("bit", bit).withColumn("own", F.when(F.col("bit") != 0, own).otherwise(F.lit(0))).withColumn("vals", vals)
    near = "other <= own" if right else "own <= other"
    met = f"filter(sequence(0L, {2 ** len(attrs) - 1}L), other -> (other & bit) = bit AND (own & other & (bit - 1)) = 0 AND {near})"
    met = F.explode(F.when(F.col("bit") != 0, F.expr(met)).otherwise(F.array(F.lit(0).cast("bigint"))))
    one, other = ("t", "s") if right else ("s", "t")
    # The key holds what such a posting shares of ``attrs``, so the others are all that is left to compare.
    left_over = F.when(F.col("bit") != 0, F.map_filter("rest", lambda k, _: ~k.isin(attrs))).otherwise(F.col("rest"))
    shaped = shaped.withColumn(other, met).withColumnRenamed("own", one).withColumn("key", common_key(len(attrs)))
    return shaped.withColumn("rest", left_over).drop("bit", "vals")


def _first_at(x: Column, y: Column, attr: Column) -> Column:
    """No attribute that both maps carry has different values or comes before ``attr``."""
    other = lambda e: F.try_element_at(y, e["key"])
    fits = lambda e: F.when(e["key"] >= attr, F.coalesce(other(e) == e["value"], F.lit(True))).otherwise(other(e).isNull())
    return F.forall(F.map_entries(x), fits)


def _couples(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.unix_timestamp(F.col("win_a.start")).alias("w"),
        F.least("doc_a", "doc_b").alias("a"),
        F.greatest("doc_a", "doc_b").alias("b"),
    )


def stream_natural_join(
    documents: DataFrame,
    duration: str = "3 minutes",
    delay: str = "1 minute",
    core: tuple[str, ...] = (),
    cells: dict[str, int] | None = None,
) -> DataFrame:
    """Joinable couples ``(w, a, b)`` of streaming documents ``(doc, m, ts)``, append mode.

    ``duration`` is the tumbling event-time window, ``delay`` the watermark; rows later
    than that are dropped.  Ids must be unique within a window.  Each couple is produced once, as soon as both documents are
    there: the shared pair at which it is emitted is decided inside the join, so no
    aggregation has to wait for the window to close.

    Name attributes of few values in ``core`` (at most five).  They become join keys over
    all shapes they can form, as in the batch join, so a value carried by a third of the
    stream is not enumerated against itself; remaining pairs go through the index.
    ``cells`` spreads the state of an attribute's pairs over as many keys each: a document's
    pair is kept in one cell on the left side, and in all of them on the right.  Where two or
    more have cells, a pair of one (of the first five, by name) meets only documents that agree in the others.
    """
    if len(core) > MAX_STREAM_CORE:
        raise ValueError(f"core may name at most {MAX_STREAM_CORE} attributes")
    docs = _windowed(documents, duration, delay, core)
    postings = explode_pairs(docs, ["win", "doc", "mask", "rest"], F.col("rest"))
    left, right = (_in_cells(postings, cells or {}, copies) for copies in (False, True))
    keys, once = ["attr", "val", "cell"], F.col("doc_a") < F.col("doc_b")
    frequent = sorted(set(cells or {}) - set(core))[:MAX_STREAM_CORE]
    if len(frequent) > 1:
        left, right = (_by_shape(side, frequent, copies) for side, copies in ((left, False), (right, True)))
        keys = [*keys, "s", "t", "key"]
        once = (F.col("doc_a") != F.col("doc_b")) & ((F.col("s_a") < F.col("t_a")) | once)
    rest = _meet(left, right, keys).where(
        once
        & ((F.col("mask_a").bitwiseAND(F.col("mask_b"))) == 0)
        & _first_at(F.col("rest_a"), F.col("rest_b"), F.col("attr_a"))
    )
    found = _couples(rest)
    if core:
        shapes = f"sequence(1L, {2 ** len(core) - 1}L)"
        key = common_key(len(core)).alias("key")
        left = docs.selectExpr(
            "*", "mask AS s", f"explode(filter({shapes}, t -> (mask & t) != 0 AND mask <= t)) AS t"
        ).select("win", "doc", "rest", "s", "t", key)
        right = docs.selectExpr(
            "*", "mask AS t", f"explode(filter({shapes}, s -> (mask & s) != 0 AND s <= mask)) AS s"
        ).select("win", "doc", "rest", "s", "t", key)
        met = _meet(left, right, ["s", "t", "key"]).where(
            (F.col("s_a") < F.col("t_a")) | (F.col("doc_a") < F.col("doc_b"))
        )
        found = found.unionByName(_couples(met.where(V.agree(F.col("rest_a"), F.col("rest_b")))))
    return found
