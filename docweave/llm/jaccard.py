"""Exact Jaccard join on word shingles, in size-banded tiles with bitmap signatures.

Texts are sets of distinct 5-word shingles; equal sets are one node.  In a total order of the
shingles (rare ones first, by classes of a first count, then by hash) two sets that are alike
enough share one of their first shingles, and two of a list that is one longer.  A tile holds the
sets of a size band that have one such shingle in common, and the larger ones of the band below
that may be alike to them.  Tiles are compared in tasks (``leaves.py``): the bits that differ in
hashed bitmaps bound the overlap of a pair from above, and what remains is decided by
intersecting the sorted arrays.  A tile that is too large for one task and holds several
components is dealt by a grid of cells, from ``GRID`` parts on first by a second shared shingle, so
no link is lost.

Links are needed for components, so pairs within a known component are not tried again, and a
task's links are reduced to a forest.

Null and wordless text has an empty set and links with nothing; texts of any length count whole.
Rows that repeat an id or a text are rows of one node.  Rows get the component of their set: the
smallest id of all rows linked to it; null ids name nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.chosen_paths import named, pieces_of, set_ids, shingle_sets
from docweave.llm.columns import free_name
from docweave.llm.leaves import linked
from docweave.llm.packed import PACKED, find, mapped, merge, pack, save, shard_count, shared_folder, unique_counts
from docweave.llm.words import U64, blocks, mix, offsets, text_bytes
from docweave.session import stage

SHINGLE = 5
HELD = 2_000_000
CLASSES = np.array([8, 64, 512, 4096])  # counts beyond which a shingle stands later in the order
BAND = 4.0  # a band of sizes spans this factor
BITS = 1 << 13  # of a bitmap, at most
GRID = 4  # parts of a large tile that meet in a grid; a second shingle would copy its sets more often
NODE = "n long, node long, first array<long>, places array<int>, bits binary"


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of ``n`` must share with any set alike to it."""
    return -(-percent * n // 100)


def prefixes(flat: np.ndarray, at: np.ndarray, order: dict | None, percent: int) -> list[np.ndarray]:
    """The first shingles of each set in the common order: enough for sets alike to share two, if they have two."""
    n = np.diff(at)
    size = np.minimum(n, n - least_overlap(n, percent) + 2)
    rank = np.zeros(len(flat), np.uint8)
    if order is not None and len(flat):
        keys, back = np.unique(flat, return_inverse=True)
        place, ranges = find(order["folder"], "often", order["often"], keys, order["shards"])
        ranked = np.zeros(len(keys), np.uint8)
        for s, i, j in ranges:
            ok = np.flatnonzero(place[i:j] >= 0) + i
            ranked[ok] = mapped(f"{order['folder']}/class-{s}", np.uint8)[place[ok]]
        rank = ranked[back]
    out = []
    for k, m in enumerate(size.tolist()):
        s, r = flat[at[k] : at[k + 1]], rank[at[k] : at[k + 1]]
        out.append(s[:m] if not r[:m].any() else s[np.argsort(r, kind="stable")[:m]])
    return out


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle at its hash; at least four times as many bits as shingles, up to ``BITS``."""
    bits = min(1 << max(6, int(4 * len(shingles) - 1).bit_length()), BITS)
    out = np.zeros(bits, bool)
    out[(mix(shingles) % U64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def at_most(n: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Upper bounds of all intersections: a bit that the other lacks is a shingle it lacks."""
    short = min(len(b) for b in bits)
    rows = np.stack([np.bitwise_or.reduce(b.reshape(-1, short), axis=0) for b in bits]).view(U64)
    lacks = np.zeros((len(rows), len(rows)), np.int16)
    for i in range(0, len(rows), 256):  # bounds what lies in memory
        for w in range(rows.shape[1]):
            lacks[i : i + 256] += np.bitwise_count(rows[i : i + 256, w, None] & ~rows[None, :, w])
    bound = n[:, None].astype(np.int32) - lacks
    return np.minimum(bound, bound.T)


def may_link(percent: int, n: np.ndarray, sketches: pa.Array) -> np.ndarray:
    bound = at_most(n, [np.frombuffer(s.as_buffer(), np.uint8) for s in sketches])
    near = bound * (100 + percent) >= (n[:, None] + n[None, :]) * percent
    np.fill_diagonal(near, False)
    return near


def _count(shards: int, order: dict | None, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at):
            sets = shingle_sets(at[i : j + 1] - at[i], data[at[i] : at[j]], SHINGLE)
            held.append(np.concatenate([np.zeros(0, U64), *prefixes(*sets, order, percent)]))  # a copy, so the sets can go
            n += len(held[-1])
            if n > HELD:
                yield from pack(*unique_counts(np.concatenate(held)), shards)
                held, n = [], 0
    if n:
        yield from pack(*unique_counts(np.concatenate(held)), shards)


def _keep(folder: str, name: str, shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keep the shingles that occur again, or for the first count the frequent ones with a class."""
    if name == "often":
        some = counts > CLASSES[0]
        save(f"{folder}/class-{shard}", np.searchsorted(CLASSES, counts[some]).astype(np.uint8))
    else:
        some = counts > 1
    save(f"{folder}/{name}-{shard}", keys[some])
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(some.sum())], pa.int64())], ["shard", "n"])


def _nodes(order: dict, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text; first shingles that another text has too, and a bitmap where there are any."""
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at):
            flat_sets, begin = shingle_sets(at[i : j + 1] - at[i], data[at[i] : at[j]], SHINGLE)
            first = prefixes(flat_sets, begin, order, percent)
            flat = np.concatenate([np.zeros(0, U64), *first])
            keys, back = np.unique(flat, return_inverse=True)
            place, _ = find(order["folder"], "shared", order["shared"], keys, order["shards"])
            good = (place >= 0)[back] if len(flat) else np.zeros(0, bool)
            start = offsets(np.array([len(f) for f in first], np.int64))
            there = np.flatnonzero(good)
            own = np.searchsorted(start, there, side="right") - 1
            number = np.bincount(own, minlength=len(first))
            bits = [bitmap(flat_sets[a:b]).tobytes() if m else None for a, b, m in zip(begin[:-1], begin[1:], number, strict=True)]
            columns = [
                pa.array(np.diff(begin), pa.int64()),
                pa.array(set_ids(flat_sets, begin)),
                pa.ListArray.from_arrays(pa.array(offsets(number), pa.int32()), pa.array(flat[good].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(offsets(number), pa.int32()), pa.array(there - start[own], pa.int32())),
                pa.array(bits, pa.binary()),
            ]
            carried = [c.slice(i, j - i) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*carried, *columns], [*batch.schema.names[1:], "n", "node", "first", "places", "bits"])


def _tiles(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node): a tile per shared first shingle and band of sizes."""
    base = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # places up to which one is shared
    each = nodes.withColumn("x", F.explode(F.arrays_zip("first", "places"))).where(F.col("x.places") < base)

    def band(size):
        return F.floor(F.log(size) / F.log(F.lit(BAND)) + 1e-9)

    # The largest set that may be alike is 100 / percent times as large, so at most a band above.
    bands = F.array_distinct(F.array(band(F.col("n").cast("double")), band(F.col("n") * (100 / percent))))
    return each.withColumn("band", F.explode(bands)).select(F.xxhash64(F.col("x.first"), "band").alias("key"), "node")


def _second(nodes: DataFrame, percent: int, members: DataFrame, level: int) -> DataFrame:
    """The tiles of a large tile by each further first shingle: sets alike share two."""
    each = members.join(nodes.select("node", "first"), "node").withColumn("x", F.explode("first"))
    return each.select(F.xxhash64("key", "x").alias("key"), "node", "c")


def shingle_components(docs: DataFrame, percent: int = 80, hashed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (the size of its set), component_id (the smallest id that links reach).

    ``hashed`` adds ``text_hash``, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    order: dict = {"folder": shared_folder(spark, "shingles"), "shards": shard_count(texts)}

    def count(name: str) -> set[int]:
        counted = texts.mapInArrow(functools.partial(_count, order["shards"], order if "often" in order else None, percent), PACKED)
        kept = merge(counted, order["shards"], functools.partial(_keep, order["folder"], name), "shard int, n long")
        return {r.shard for r in kept.collect() if r.n}

    order["often"] = count("often")
    order["shared"] = count("shared")
    # The row whose set stands for a node is found again by its id.
    given = docs.select("text", "doc_id", F.xxhash64("doc_id").alias("row_id"), *([F.xxhash64("text").alias("text_hash")] if hashed else []))
    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, row_id long, {'text_hash long, ' * hashed}{NODE}"
    rows = stage(given.mapInArrow(functools.partial(_nodes, order, percent), schema))
    some = rows.where("bits is not null")
    nodes = stage(some.groupBy("node").agg(*(F.min(c).alias(c) for c in ("n", "row_id", "first", "places", "bits"))))
    found = linked(
        _tiles(nodes, percent),
        functools.partial(_second, nodes, percent),
        2,
        nodes.select("node", "n", F.col("bits").alias("sketch"), "row_id"),
        pieces_of(given, SHINGLE),
        percent,
        functools.partial(may_link, percent),
        many=True,
        grid=GRID,
    )
    return named(rows, found, ("text_hash",) if hashed else ())


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of linked texts, that with the smallest id; columns unchanged.

    Rows that agree in id and text are one.  Of rows without an id, those with equal texts are
    one, and those linked to a row with an id go.  Texts without words all stay.
    """
    found = shingle_components(docs.select("doc_id", "text"), percent, hashed=True)
    stays = found.where("n_shingles = 0 or component_id <=> doc_id")
    ids = stays.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("_id"), "text_hash").distinct()
    key, text = free_name(docs.columns, "_id_text"), free_name(docs.columns, "_text_hash")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text: F.xxhash64("text")})
    left = keyed.join(ids, (keyed[key] == ids["_id"]) & (keyed[text] == ids["text_hash"]), "left_semi")
    return left.dropDuplicates([key, text]).drop(key, text)
