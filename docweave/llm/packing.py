"""Packing of token sequences by minimum bin slack.

Documents become token ids plus an end id.  A document is cut after every ``capacity`` ids;
its full pieces are sequences of their own, its rest is a piece to pack.  Only the number of
pieces per length matters to the packing, and there are fewer than ``capacity`` lengths, so
the packing is done on that histogram: each sequence starts with the longest length left, a
bitset subset-sum over the lengths left finds the filling closest to capacity, backtracking
gives its counts, and the filling is used as often as the histogram allows.  Pieces are then
placed by arithmetic: their rank within their length says which filling, and where in it.

Null text is empty: one end id.  An empty table gives no rows.  Rows that repeat are pieces
of their own.  Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import stage

END = 1
KNOWN = 150_000  # words that a worker remembers
#: Fixed value: the pattern that the tokenizer's byte-level parts follow.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long"


class Ids:
    """Token ids of texts by a tokenizer's file of byte-level merges.

    The file's vocabulary also serves as ranks for a faster encoder with the same pattern and
    merges.  It takes Latin-1 texts, on which both encoders agree; others go to the tokenizer,
    which is loaded at the first of them, as it takes about as much memory again.
    The pattern begins a new part at a space between non-spaces, and at a line feed between
    non-spaces, so the ids of words between such places don't depend on each other and are
    remembered.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        # The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        ranks.pop(b"<|endoftext|>", None)
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace("\n", " \n").split(" ")
        joined = text.replace("\n", "")
        plain = joined.isprintable() and not text[:1].isspace() and not text[-1:].isspace()
        if not plain or "" in words or "\n" in words or "\n " in text:
            return self.learn(text)
        try:
            return self.learn(words[0]) + b"".join(map(self.known.__getitem__, words[1:]))
        except KeyError:
            if len(self.known) > KNOWN:
                self.known.clear()
            for w in set(words[1:]).difference(self.known):
                self.known[w] = self.learn(w if w[0] == "\n" else " " + w)
            return self.learn(words[0]) + b"".join(map(self.known.__getitem__, words[1:]))

    def learn(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()


_encoders: dict[str, Ids] = {}


def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Ids(path)
    encode = _encoders[path].encode
    task = TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    end = END.to_bytes(4, "little")
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        rows: list[tuple] = []
        for doc, text in zip(docs, texts, strict=True):
            ids = encode(text.as_py() or "") + end
            n = len(ids) // 4
            for s in range(0, n, capacity):
                size = min(capacity, n - s)
                rows.append((doc, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, task, int(seen[size])))
                seen[size] += 1
        if rows:
            columns = list(zip(*rows, strict=True))
            names = [p.split()[0] for p in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
    _encoders[path].known.clear()


def fill(counts: list[int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest possible within ``room``; ``counts[l]`` are left."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in range(room, 0, -1):
        left = min(counts[size], room // size)
        take = 1
        while left:
            take = min(take, left)
            steps.append((reach, size, take))
            reach |= (reach << (size * take)) & mask
            left -= take
            take *= 2
            if reach >> room:
                left = 0
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for before, size, take in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + take
            total -= size * take
    return used


def fillings(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, counts by length) until nothing is left."""
    counts = [histogram.get(size, 0) for size in range(capacity + 1)]
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            used = fill(counts, capacity - longest)
            counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
            times = min(counts[size] // k for size, k in used.items())
            for size, k in used.items():
                counts[size] -= times * k
            out.append((times, used))
    return out


def placement(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, count in a sequence, first sequence, first offset)."""
    taken, sequence, rows = {}, 0, []
    for times, used in fillings(histogram, capacity):
        offset = 0
        for size in sorted(used, reverse=True):
            k, low = used[size], taken.get(size, 0)
            rows.append((size, low, low + times * k - 1, k, sequence, offset))
            taken[size] = low + times * k
            offset += k * size
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stage(texts.mapInArrow(functools.partial(_pieces, tokenizer, capacity), PIECES))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # Fewer than capacity lengths; every use of a filling exhausts a length or halves what is left of it.
    plan = spark.createDataFrame(
        placement(histogram, capacity) or [(0, 0, -1, 1, 0, 0)],
        "p_length long, low long, high long, k long, sequence long, first long",
    )
    ranked = pieces.join(shift, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("shift"))
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("p_length")) & F.col("rank").between(F.col("low"), F.col("high"))
    )
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.expr("sequence + (rank - low) div k").alias("sequence_id"),
        (F.col("first") + (F.col("rank") - F.col("low")) % F.col("k") * F.col("length")).alias("offset"),
    )
