"""Substring dedup by content-defined chunks.

A rolling hash over ``SEED`` bytes cuts a text where the hash is the smallest of all that fit in
some window of ``min_bytes`` bytes.  So a cut depends on nearby bytes only, and equal windows of
``min_bytes`` are cut at the same byte: every repeated passage of that length has a seed (the
``SEED`` bytes after a cut) in common with its first place.  Seed digests are counted over all
texts; those that occur again are kept as sorted arrays in the shared folder.

Each repeated seed stands for the windows whose smallest hash it has.  Of seeds whose windows are
all equal the first place (smallest doc_id, then place) stays.  If a seed has places whose windows
differ, the windows of one place of each kind are compared one by one.  What is removed is the
union of all windows that occurred before: the exact matches, however long, from ``min_bytes`` on.
Of a passage that overlaps its own first place, what lies beyond that place is removed.

No character is split: one that a match holds in part stays.  Null text stays null, empty text
empty.  Rows that agree in id and text are one document and get one answer.  Null ids come last.
Digests have 64 bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import free_name, scan
from docweave.llm.packed import PACKED, find, merge, pack, save, shard_count, shared_folder, unique_counts
from docweave.llm.words import SPAN, U64, _powers, blocks, expand, mix, offsets, text_bytes
from docweave.session import stage

SEED = 32
MIN_BYTES = 96
GEAR = mix(np.arange(256, dtype=U64) + U64(77)).astype(np.uint32)
HELD = 2_000_000  # digests a task sorts at once
KINDS = 1_000  # places of a seed with different windows that one task compares


def seeds(at: np.ndarray, data: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all seeds of a block of texts, in order, and of the first and last window of each."""
    n = len(data) - min_bytes + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    h = GEAR[data]
    for m in (1, 2, 4, 8, 16):
        h[m:] += h[:-m] << np.uint32(m)  # the right side is taken before it is added
    h = h[SEED - 1 :]  # by the first byte of the seed
    h[(data[: len(h)] & 0xC0) == 0x80] = 0xFFFFFFFF  # a seed begins with a character
    least = h.astype(U64) << U64(32) | np.arange(len(h), dtype=U64)
    width, have = min_bytes - SEED + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    starts = expand(at[:-1], np.maximum(np.diff(at) - min_bytes + 1, 0))  # windows inside one text
    of = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(of)][: len(first)] - 1
    return of[first], starts[first], starts[last]


def cuts(at: np.ndarray, data: np.ndarray, min_bytes: int = MIN_BYTES) -> np.ndarray:
    """Ends (exclusive) of all chunks of a block of texts, in order: where seeds and texts begin or end."""
    return np.unique(np.r_[np.setdiff1d(seeds(at, data, min_bytes)[0], at[:-1]), at[1:][np.diff(at) > 0]])


def digests(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A 64-bit digest per range of bytes; starts and ends are in order, ranges shorter than ``SPAN``."""
    out = np.empty(len(ends), U64)
    power, inverse = _powers(SPAN)
    i = 0
    while i < len(ends):
        s = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s + SPAN, side="right")))
        sums = np.zeros(ends[j - 1] - s + 1, U64)
        np.cumsum(_TABLE[data[s : ends[j - 1]]] * power[: len(sums) - 1], out=sums[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64))
        i = j
    return out


_TABLE = mix(np.arange(256, dtype=U64) + U64(1))


def _count(shards: int, min_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at):
            own = data[at[i] : at[j]]
            p, _, _ = seeds(at[i : j + 1] - at[i], own, min_bytes)
            held.append(digests(p, p + SEED, own))
            n += len(held[-1])
            if n > HELD:
                yield from pack(*unique_counts(np.concatenate(held)), shards)
                held, n = [], 0
    if n:
        yield from pack(*unique_counts(np.concatenate(held)), shards)


def _gather(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pack(*unique_counts(batch.column(0).to_numpy().view(U64)), shards)


def _keep(folder: str, name: str, least: int, shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    again = keys[counts >= least]
    save(f"{folder}/{name}-{shard}", again)
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(again)], pa.int64())], ["shard", "n"])


def _known(folder: str, name: str, total: int, shards: set[int], keys: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted arrays of that name."""
    distinct, back = np.unique(keys, return_inverse=True)
    return find(folder, name, shards, distinct, total)[0][back] >= 0


def _rows(values: list, row: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Lists of structs for ``n`` texts; ``row`` is in order."""
    return pa.ListArray.from_arrays(
        pa.array(offsets(np.bincount(row, minlength=n)), pa.int32()), pa.StructArray.from_arrays(values, fields=list(kind))
    )


PLACES = "array<struct<digest: long, windows: long, i: int, end: int>>"
CONTEXTS = "array<struct<digest: long, i: int, context: binary>>"


def _repeats(folder: str, total: int, shards: set[int], min_bytes: int, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Repeated seeds: digests of the seed and of its windows, and the bytes these cover.  Of seeds with
    the same windows a text has the first; what the others cover comes without digests."""
    kind = pa.struct([("digest", pa.int64()), ("windows", pa.int64()), ("i", pa.int32()), ("end", pa.int32())])
    for column in columns:
        at, data = text_bytes(column)
        parts = [pa.array([], pa.list_(kind))]
        for i, j in blocks(at):
            own, text = at[i : j + 1] - at[i], data[at[i] : at[j]]
            p, lo, hi = seeds(own, text, min_bytes)
            d = digests(p, p + SEED, text)
            again = _known(folder, "repeats", total, shards, d) if len(d) else np.zeros(0, bool)
            d, lo, end = d[again], lo[again], hi[again] + min_bytes
            whole = digests(lo, end, text)
            row = np.searchsorted(own, lo, side="right") - 1
            order = np.lexsort((lo, whole, row))
            new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(whole[order].view(np.int64)) != 0)][: len(order)]
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            one, other, before = np.sort(order[new]), order[~new], first[~new]
            a, b = np.maximum(lo[other], lo[before] + min_bytes), end[other]
            r, a, b = union(row[other], a, b)
            rows = np.r_[row[one], r]
            sort = np.argsort(rows, kind="stable")
            none = np.r_[np.zeros(len(one), bool), np.ones(len(r), bool)][sort]
            fill = lambda x, y: np.r_[x, y][sort]
            zero = np.zeros(len(r), np.int64)
            parts.append(
                _rows(
                    [
                        pa.array(fill(d[one].view(np.int64), zero), mask=none),
                        pa.array(fill(whole[one].view(np.int64), zero), mask=none),
                        pa.array(fill(lo[one], a) - own[rows[sort]], pa.int32()),
                        pa.array(fill(end[one], b) - own[rows[sort]], pa.int32()),
                    ],
                    rows[sort], j - i, kind,
                )
            )
        yield pa.concat_arrays(parts)


def union(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges [a, b) of each row joined where they touch, in order."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order].astype(np.int64), b[order].astype(np.int64)
    if not len(a):
        return row, a, b
    apart = row.astype(np.int64) << 33  # texts have under 2^31 bytes
    reach = np.maximum.accumulate(b + apart) - apart
    new = np.r_[True, (a[1:] > reach[:-1]) | (row[1:] != row[:-1])]
    return row[new], a[new], reach[np.r_[np.flatnonzero(new)[1:], len(a)] - 1]


def _contexts(folder: str, total: int, shards: set[int], min_bytes: int, columns) -> Iterator[pa.Array]:
    """Bytes of the windows of the places that are kept under ``mixed``, with the seed's digest."""
    kind = pa.struct([("digest", pa.int64()), ("i", pa.int32()), ("context", pa.binary())])
    for column, keys in columns:
        at, data = text_bytes(column)
        keys = keys.to_numpy(zero_copy_only=False).view(U64)
        parts = [pa.array([], pa.list_(kind))]
        for i, j in blocks(at):
            own, text = at[i : j + 1] - at[i], data[at[i] : at[j]]
            p, lo, hi = seeds(own, text, min_bytes)
            row = np.searchsorted(own, lo, side="right") - 1
            chosen = _known(folder, "mixed", total, shards, place_key(keys[i:j][row], lo - own[row])) if len(lo) else np.zeros(0, bool)
            p, lo, row, size = p[chosen], lo[chosen], row[chosen], (hi - lo)[chosen] + min_bytes
            context = pa.Array.from_buffers(
                pa.binary(), len(lo), [None, pa.py_buffer(offsets(size).astype(np.int32)), pa.py_buffer(text[expand(lo, size)])]
            )
            d = digests(p, p + SEED, text).view(np.int64)
            parts.append(_rows([pa.array(d), pa.array(lo - own[row], pa.int32()), context], row, j - i, kind))
        yield pa.concat_arrays(parts)


def _single(table: pa.Table, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and digest of all windows of the contexts."""
    at, data = text_bytes(table.column("context"))
    n = np.diff(at) - min_bytes + 1
    starts, row = expand(at[:-1], n), np.repeat(np.arange(len(n)), n)
    return row, starts - at[row] + table.column("i").to_numpy()[row], digests(starts, starts + min_bytes, data)


def _compare(min_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts in order of digest, document and place: the windows of a digest that occurred before."""

    def later(table: pa.Table) -> pa.RecordBatch:
        k, d = (table.column(c).to_numpy() for c in ("k", "digest"))
        row, place, w = _single(table, min_bytes)
        w = mix(w + d[row].view(U64))
        order = np.argsort(w, kind="stable")
        new = np.r_[True, w[order][1:] != w[order][:-1]][: len(order)]
        before = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))][~new]
        other = order[~new]
        same = k[row[other]] == k[row[before]]
        a, b = place[other], place[other] + min_bytes
        start = np.where(same, np.maximum(a, place[before] + min_bytes), a)
        again = ~same | (a != place[before])
        r, start, end = union(row[other][again], start[again], b[again])
        return pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["k", "i", "end"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        d = table.column("digest").to_numpy()
        done = int(np.flatnonzero(d == d[-1])[0]) if len(d) else 0
        if done:
            yield later(table.slice(0, done))
        held = table.slice(done)
    if held is not None and len(held):
        yield later(held)


def _spread(min_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per window."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        row, place, w = _single(table, min_bytes)
        k, ids = table.column("k").to_numpy(), table.column("doc_id").combine_chunks().take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(k[row]), ids, pa.array(w.view(np.int64)), pa.array(place, pa.int32())], ["k", "doc_id", "digest", "i"])


def place_key(keys: np.ndarray, i: np.ndarray) -> np.ndarray:
    """A 64-bit key of a place: the text's key and the byte."""
    return mix(keys + mix(i.astype(U64) + U64(1)))


def _place_keys(columns) -> Iterator[pa.Array]:
    for keys, i in columns:
        yield pa.array(place_key(keys.to_numpy(zero_copy_only=False).view(U64), i.to_numpy(zero_copy_only=False)).view(np.int64))


def _cut(texts_and_ranges) -> Iterator[pa.Array]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for texts, ranges in texts_and_ranges:
        out, spans, numbers = [], [], []
        for text, drop in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            found = []
            if drop and text:
                raw = text.encode()
                a, b = np.array([(x["i"], x["end"]) for x in drop]).T
                kept, at, chars = [], 0, 0
                for _, a, b in zip(*(x.tolist() for x in union(np.zeros(len(a), np.int64), a, b)), strict=True):
                    while a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    if a < b:
                        kept.append(raw[at:a])
                        chars += len(kept[-1].decode())
                        found.append({"start": chars, "end": (chars := chars + len(raw[a:b].decode()))})
                        at = b
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
            spans.append(found)
            numbers.append(sum(x["end"] - x["start"] for x in found))
        yield pa.StructArray.from_arrays(
            [pa.array(out, pa.string()), pa.array(spans, pa.list_(span)), pa.array(numbers, pa.int64())],
            ["text", "spans", "n_removed"],
        )


CUT = "struct<text: string, spans: array<struct<start: long, end: long>>, n_removed: long>"


def _firsts(places: DataFrame, key: str, *more: str) -> DataFrame:
    """The first place of each key, with its count."""
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "k", "i")).alias("first")
    found = places.groupBy(key, *more).agg(first, F.count("*").alias("n"))
    return found.select(key, *more, F.col("first.k").alias("k0"), F.col("first.i").alias("i0"), "n")


def _later(places: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """``places`` that are not their key's first, with ``k0`` and ``i0`` of that one."""
    # Keys with over a thousandth of all places, so at most a thousand, are joined by broadcast.
    first = first.where("n > 1")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = first.where(F.col("n") > max(10_000, total // 1000)).select(key, "k0", "i0")
    rest = places.join(F.broadcast(hot.select(key)), key, "left_anti").join(first.select(key, "k0", "i0"), key)
    return rest.unionByName(places.join(F.broadcast(hot), key)).where("k <> k0 or i <> i0")


def drop_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, ``removed`` spans (code points of the old
    text, end exclusive) and ``n_removed`` characters; columns of these names are replaced."""
    if not 2 * SEED <= min_bytes <= SPAN // 2:
        raise ValueError(f"min_bytes must be from {2 * SEED} to {SPAN // 2}")
    spark = docs.sparkSession
    shards, folder = shard_count(docs.select("text")), shared_folder(spark, "chunks")

    def keep(packed: DataFrame, name: str, least: int) -> set[int]:
        meta = merge(packed, shards, functools.partial(_keep, folder, name, least), "shard int, n long").collect()
        return {r.shard for r in meta if r.n}

    repeated = keep(docs.select("text").mapInArrow(functools.partial(_count, shards, min_bytes), PACKED), "repeats", 2)
    key = F.xxhash64("doc_id", "text")
    found = scan(_repeats, PLACES, folder, shards, repeated, min_bytes)("text")
    found = stage(docs.select(key.alias("k"), "doc_id", found.alias("x")).select("k", "doc_id", F.inline("x")))
    places = found.where("digest is not null")
    first = stage(_firsts(places, "windows", "digest"))
    # Windows differ between these places of a seed; each kind is there once.
    mixed = stage(first.groupBy("digest").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    kinds = first.join(mixed, "digest", "left_semi").select(scan(_place_keys, "long")("k0", "i0"))
    chosen = keep(kinds.mapInArrow(functools.partial(_gather, shards), PACKED), "mixed", 1)
    context = scan(_contexts, CONTEXTS, folder, shards, chosen, min_bytes)("text", "k")
    context = docs.select("doc_id", "text", key.alias("k")).select("k", "doc_id", context.alias("x"))
    context = stage(context.select("k", "doc_id", F.inline("x")))
    # Few kinds are compared in one task; the windows of many are dealt out one by one.
    many = F.broadcast(mixed.where(F.col("kinds") > KINDS).select("digest"))
    order = ("digest", F.isnull("doc_id"), "doc_id", "k", "i")
    few = context.join(many, "digest", "left_anti").repartition("digest").sortWithinPartitions(*order)
    few = few.mapInArrow(functools.partial(_compare, min_bytes), "k long, i int, end int")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    single = context.join(many, "digest", "left_semi")
    single = stage(single.mapInArrow(functools.partial(_spread, min_bytes), f"k long, doc_id {id_type}, digest long, i int"))
    own = F.expr(f"if(k = k0, greatest(i, i0 + {min_bytes}), i)").cast("int").alias("i")
    again = _later(single, _firsts(single, "digest"), "digest").select("k", own, (F.col("i") + min_bytes).cast("int").alias("end"))
    later = _later(places, first, "windows").select("k", "i", "end")
    gone = later.unionByName(few).unionByName(again).unionByName(found.where("digest is null").select("k", "i", "end"))
    gone = gone.groupBy("k").agg(F.collect_set(F.struct("i", "end")).alias("ranges"))
    k, c = free_name(docs.columns, "_k"), free_name(docs.columns, "_cut")
    joined = docs.withColumn(k, key).join(gone.select(F.col("k").alias(k), F.col("ranges").alias(c)), k, "left")
    cut = joined.withColumn(c, scan(_cut, CUT)("text", c))
    return cut.withColumns({"text": F.col(f"{c}.text"), "removed": F.col(f"{c}.spans"), "n_removed": F.col(f"{c}.n_removed")}).drop(c, k)
