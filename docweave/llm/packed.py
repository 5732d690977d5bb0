"""Sorted 64-bit keys with counts, gathered by a Spark shuffle and kept as mapped arrays.

Tasks sort and count their own keys and send one packed row per shard; a shard is a range
of key values, and keys are hashes, so shards are even and each is merged in one task.  The
merged arrays go to the folder that ``spark.checkpoint.dir`` names; workers map them.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docweave.llm.words import U64, offsets
from docweave.session import stage_dir

PACKED = "shard int, keys binary, counts binary"
SHARD = 8 << 20
MOST_SHARDS = 1 << 16
UNKNOWN = 1 << 60
ROW = 1 << 13  # keys of a packed row


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{stage_dir(spark)}/docweave/{name}-{uuid.uuid4().hex}"


def shard_count(texts: DataFrame) -> int:
    """A power of two: at least the session's number of shuffle partitions, and one per ``SHARD`` bytes of the tables read."""
    spark = texts.sparkSession
    leaves = texts._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(b for b in sizes if b < UNKNOWN)  # rows that come from no table have no size
    wanted = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(size // SHARD, MOST_SHARDS))
    return 1 << (wanted - 1).bit_length()


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def save(path: str, array: np.ndarray) -> None:
    """Whole file or none, so a repeated task may write it again."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_output_stream(at) as out:
            out.write(np.ascontiguousarray(array).tobytes())
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    part = f"{local}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.ascontiguousarray(array).tofile(out)
    os.replace(part, local)


def load(path: str, dtype) -> np.ndarray:
    """The array, mapped if the folder is a mounted one, read otherwise."""
    local = _local(path)
    if local is None:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_file(at) as f:
            return np.frombuffer(f.read(), dtype)
    if not os.path.getsize(local):
        return np.zeros(0, dtype)
    return np.memmap(local, dtype, "r")


mapped = functools.lru_cache(maxsize=400)(load)


def unique_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with summed counts."""
    if not len(keys):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    if counts is None:
        k = np.sort(keys)
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        return k[at], np.diff(np.r_[at, len(k)])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(counts[order].astype(np.int64), at)


def shard_bounds(shards: int) -> np.ndarray:
    return np.arange(1, shards, dtype=U64) << U64(64 - (shards - 1).bit_length())


def pack(keys: np.ndarray, counts: np.ndarray, shards: int, shard_of: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of bounded size from sorted distinct keys; shards are key ranges unless given per key."""
    if shard_of is None:
        at = np.array([0, *np.searchsorted(keys, shard_bounds(shards)), len(keys)])
    else:
        order = np.argsort(shard_of, kind="stable")
        keys, counts = keys[order], counts[order]
        at = offsets(np.bincount(shard_of, minlength=shards))
    small = np.minimum(counts, 0xFFFFFFFF).astype(np.uint32)
    rows = [(s, i, min(i + ROW, at[s + 1])) for s in np.flatnonzero(np.diff(at)).tolist() for i in range(at[s], at[s + 1], ROW)]
    for k in range(0, len(rows), 1000):
        some = rows[k : k + 1000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _, _ in some], pa.int32()),
                pa.array([keys[i:j].tobytes() for _, i, j in some], pa.binary()),
                pa.array([small[i:j].tobytes() for _, i, j in some], pa.binary()),
            ],
            ["shard", "keys", "counts"],
        )


def merge(
    df: DataFrame, shards: int, finish: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``finish(shard, keys, counts)`` once per shard, with all its distinct keys in order."""
    return df.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        functools.partial(_merge, finish), schema
    )


def _merge(finish, batches):
    shard, keys, counts, waiting = None, [], [], 0
    for batch in batches:
        for s, k, c in zip(*(batch.column(i) for i in range(3)), strict=True):
            if s.as_py() != shard:
                if shard is not None:
                    yield from finish(shard, *unique_counts(np.concatenate(keys), np.concatenate(counts)))
                shard, keys, counts, waiting = s.as_py(), [], [], 0
            keys.append(np.frombuffer(k.as_buffer(), U64))
            counts.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
            waiting += len(keys[-1])
            if waiting > 2 * len(keys[0]) + 1_000_000:  # combine early, so repeats don't pile up
                k0, c0 = unique_counts(np.concatenate(keys), np.concatenate(counts))
                keys, counts, waiting = [k0], [c0], len(k0)
    if shard is not None:
        yield from finish(shard, *unique_counts(np.concatenate(keys), np.concatenate(counts)))


def find(folder: str, name: str, shards: set[int], keys: np.ndarray, total: int) -> tuple[np.ndarray, list]:
    """For sorted keys: place of each within its shard's array or -1, and the key ranges by shard."""
    place = np.full(len(keys), -1, np.int64)
    at = [0, *np.searchsorted(keys, shard_bounds(total)).tolist(), len(keys)]
    ranges = []
    for s in range(total):
        i, j = at[s], at[s + 1]
        if j > i and s in shards:
            have = mapped(f"{folder}/{name}-{s}", U64)
            p = np.searchsorted(have, keys[i:j])
            ok = p < len(have)
            ok[ok] = have[p[ok]] == keys[i:j][ok]
            place[i:j][ok] = p[ok]
            ranges.append((s, i, j))
    return place, ranges
