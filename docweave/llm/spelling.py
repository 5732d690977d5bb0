"""Spelling variants: words one edit apart, found by edits probed against Bloom filters.

Words of whole texts are counted per task and merged by word.  A word's hash is a polynomial over
its code points, so the hashes of all its deletions and replacements follow by arithmetic.  They
are probed against blocked Bloom filters, one per word length, that are broadcast; only positives
become strings, are shuffled, and meet the vocabulary in an exact join, which removes what the
filter let through by mistake.  An insertion is the deletion seen from the longer word, and of two
words that differ in one place only the one with the smaller code point there is probed.

A broadcast holds at most ``FILTER`` bytes at ``BITS`` bits a word: a larger vocabulary is cut
into slices by hash, one broadcast and one pass over the vocabulary each.

Null and empty texts have no words; a null id is written as nothing.  Repeated rows count again.
Texts and words may be of any length: edits of a word are made in pieces of bounded size.  Ties
between near words of equal count go to the word that sorts first by code points.  An empty
table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.words import INVERSE, ROOT, U64, mix, text_bytes
from docweave.session import stage

RUN = "[A-Za-zÀ-ÿ]"
ALPHABET = np.array([*range(97, 123), *range(0xC0, 0x100)], np.int64)  # what a lower-cased word is made of
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HELD = 300_000  # distinct words counted in a task before they are sent
BITS = 24  # of a filter per word
FILTER = 64 << 20  # bytes of a broadcast
SEGMENT = 1 << 13  # blocks of 8 bytes in a row of a filter that is gathered
PROBES = 1 << 20  # edits made at once


def _count(shortest: int, typos: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"{RUN}{{{shortest},}}")
    held: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        ids = batch.column(0).to_pylist()
        at, data = text_bytes(batch.column(1))
        for i, doc in enumerate(ids):
            text = data[at[i] : at[i + 1]].tobytes().translate(LOWER).decode("utf-8", "replace")
            own = Counter(m.group() for m in run.finditer(text))
            if typos:
                prefix = b"" if doc is None else str(doc).encode()
                for word, n in own.items():
                    h = zlib.crc32(prefix + b":" + word.encode())
                    if h % typos == 0:
                        at_ = h % len(word)
                        word = word[:at_] + word[at_ + 1 :]
                        if len(word) < shortest:
                            continue
                    held[word] += n
            else:
                held.update(own)
            if len(held) > HELD:
                yield sent()
    if held:
        yield sent()


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, typos: int | None = None) -> DataFrame:
    """word, n of all maximal runs of letters of at least ``shortest`` code points, A-Z lower-cased.

    ``typos``: of the runs whose CRC-32 with their document's id this number divides, one code
    point is deleted, as a slip of the pen would.
    """
    counts = docs.select("doc_id", "text").mapInArrow(functools.partial(_count, shortest, typos), "word string, n long")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A fixed number of parts, as the edits of few bytes of words are much work.
    words = counts.repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))
    return stage(words.where(F.col("n") >= least))


# Hashes


def word_arrays(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word begins."""
    text = words.to_pylist()
    points = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.int64)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in text], dtype=np.int64)])


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(6, n.bit_length()))


def value(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U64) + U64(1))


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """The polynomial over the first 0, 1, ... code points of one word or of equally long ones."""
    terms = value(points) * powers(ROOT, points.shape[-1])[: points.shape[-1]]
    out = np.zeros((*points.shape[:-1], points.shape[-1] + 1), U64)
    np.cumsum(terms, axis=-1, out=out[..., 1:])
    return out


def spread(h: np.ndarray, length: int) -> np.ndarray:
    """What filters are addressed by."""
    return mix(h + U64(length) * U64(ROOT))


def slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    return (mix(key) % U64(slices)).astype(np.int64)


def bits_of(key: np.ndarray) -> np.ndarray:
    """Up to five bits of a block."""
    out = np.zeros(key.shape, U64)
    for k in range(5):
        out |= U64(1) << ((key >> U64(6 * k)) & U64(63))
    return out


# Filters


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Per batch and word length: the batch, its rows of that length, their code points as a matrix."""
    for batch in batches:
        points, at = word_arrays(batch.column(0))
        size = np.diff(at)
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            step = max(1, PROBES // max(n, len(ALPHABET)))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                yield batch, some, points[at[some][:, None] + np.arange(n)], n


def _segments(blocks: dict[int, int], slices: int, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the filters that a task's words set: a row per segment."""
    parts: dict[tuple[int, int], np.ndarray] = {}
    for _, _, points, n in _by_length(batches):
        key = spread(prefix_hashes(points)[:, -1], n)
        key = key[slice_of(key, slices) == turn]
        block = ((key >> U64(32)) % U64(blocks[n])).astype(np.int64)
        bits = bits_of(key)
        for s in np.unique(block // SEGMENT).tolist():
            here = block // SEGMENT == s
            part = parts.setdefault((n, s), np.zeros(min(SEGMENT, blocks[n] - s * SEGMENT), U64))
            np.bitwise_or.at(part, block[here] - s * SEGMENT, bits[here])
    if parts:
        names = list(parts)
        columns = [pa.array([k[0] for k in names], pa.int32()), pa.array([k[1] for k in names], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([parts[k].tobytes() for k in names], pa.binary())], ["length", "segment", "bits"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal segments of several tasks as one; a task holds those dealt to it."""
    whole: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for n, s, b in zip(*(batch.column(i) for i in range(3)), strict=True):
            key, bits = (n.as_py(), s.as_py()), np.frombuffer(b.as_buffer(), U64)
            whole[key] = whole[key] | bits if key in whole else bits.copy()
    for (n, s), bits in whole.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["length", "segment", "bits"]
        )


def filter_slice(words: DataFrame, lengths: dict[int, int], slices: int, turn: int) -> dict[int, np.ndarray]:
    """One blocked filter per word length over the words of a slice; at most ``FILTER`` bytes."""
    blocks = {n: max(1, -(-count * BITS // 64 // slices)) for n, count in lengths.items()}
    kind = "length int, segment int, bits binary"
    parts = words.select("word").mapInArrow(functools.partial(_segments, blocks, slices, turn), kind)
    whole = parts.repartition("length", "segment").mapInArrow(_joined, kind)
    filters = {n: np.zeros(b, U64) for n, b in blocks.items()}
    for r in whole.toLocalIterator():
        filters[r.length][r.segment * SEGMENT :][: len(r.bits) // 8] = np.frombuffer(r.bits, U64)
    return filters


# Edits


def _probe(shared, slices: int, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n and each of its edits that may be a word of the slice."""
    filters = shared.value

    def positive(h: np.ndarray, length: int) -> np.ndarray:
        bits = filters[length]
        key = spread(h, length)
        want = bits_of(key)
        found = (bits[((key >> U64(32)) % U64(len(bits))).astype(np.int64)] & want) == want
        return found & (slice_of(key, slices) == turn) if slices > 1 else found

    for batch, rows, points, n in _by_length(batches):
        sums = prefix_hashes(points)
        whole, power = sums[:, -1], powers(ROOT, n)
        inverse = U64(INVERSE)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, places, code point or -1
        step = max(1, PROBES // (len(rows) * len(ALPHABET)))
        for a in range(0, n, step):
            b = min(a + step, n)
            if n - 1 in filters:
                # Of equal neighbours only the first is deleted.
                h = sums[:, a:b] + (whole[:, None] - sums[:, a + 1 : b + 1]) * inverse
                hit = positive(h, n - 1)
                hit[:, max(1 - a, 0) :] &= points[:, max(a, 1) : b] != points[:, max(a, 1) - 1 : b - 1]
                r, p = np.nonzero(hit)
                found.append((r, p + a, np.full(len(r), -1)))
            if n in filters:
                here = points[:, a:b, None]
                h = whole[:, None, None] + (value(ALPHABET)[None, None, :] - value(here)) * power[a:b][None, :, None]
                r, p, c = np.nonzero(here < ALPHABET[None, None, :])
                hit = positive(h[r, p, c], n)
                found.append((r[hit], p[hit] + a, ALPHABET[c[hit]]))
        r, p, c = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        for i in range(0, len(r), 10_000):
            word = batch.column(0).take(pa.array(rows[r[i : i + 10_000]]))
            edits = [
                w[:at] + ("" if to < 0 else chr(to)) + w[at + 1 :]
                for w, at, to in zip(word.to_pylist(), p[i : i + 10_000].tolist(), c[i : i + 10_000].tolist(), strict=True)
            ]
            counts = batch.column(1).take(pa.array(rows[r[i : i + 10_000]]))
            yield pa.RecordBatch.from_arrays([word, counts, pa.array(edits, pa.string())], ["word", "n", "edit"])


def near_words(words: DataFrame, most: int = FILTER) -> DataFrame:
    """word, near, near_n of all pairs of words that one edit turns into each other, both ways."""
    spark = words.sparkSession
    # One row per length that words have; as lengths differ, there are at most sqrt(2 * letters) of them.
    lengths = {r.size: r.n for r in words.groupBy(F.char_length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    total = sum(-(-n * BITS // 64) * 8 for n in lengths.values())
    slices = -(-total // most)
    pairs = None
    for turn in range(slices):
        shared = spark.sparkContext.broadcast(filter_slice(words, lengths, slices, turn))
        positives = words.select("word", "n").mapInArrow(functools.partial(_probe, shared, slices, turn), "word string, n long, edit string")
        known = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
        exact = stage(positives.join(known, "edit"))
        shared.destroy()
        pairs = exact if pairs is None else pairs.union(exact)
    there = pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    return there.union(pairs.select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame, ratio: int) -> DataFrame:
    """word, root: the end of the chain of forms from each word that has one.

    Counts grow by ``ratio`` with every form and stay below 2^63, which bounds the chains; what a
    word has reached doubles in each round.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio)))):
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reached = reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reached = stage(reached)
    return reached


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near, root per word of a vocabulary.

    A word's form is its near word of largest count, if that is at least ``ratio`` times its own;
    its root is where forms lead in the end, itself if it has none.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best")
    grouped = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.select("word", "n").join(grouped, "word", "left")
    near_n = -F.col("best.least")
    has = near_n >= ratio * F.col("n")
    forms = stage(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"), F.when(has, near_n).alias("form_n"),
        )
    )
    ends = roots(forms.where("form is not null"), ratio)
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
