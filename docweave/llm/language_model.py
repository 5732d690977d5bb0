"""Interpolated modified Kneser-Ney bigram model over whole corpora.

Counting: tasks count their own words, then pairs, and a shuffle merges the packed counts by
shard.  Words are numbered by their place in the sorted array of word hashes, and a pair is its
two numbers, so nothing is lost to hashing beyond the 64-bit word hash.  Pairs of one context
share a shard, except for the at most 8 x shards most frequent contexts, whose pairs are
spread.  Merged arrays (words, counts, pairs, contexts, continuation counts) lie sorted in the
shared folder; workers map them and look up the sorted keys of a block of texts.

Tokens: lower-cased words between white space, then one end token.  An unknown word has the
uniform share of the lowest order, 1 / (V + 1).  Null text is empty: one end token.  With no
training text every token has probability 1 / (V + 1) = 1.  Repeated rows count repeatedly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import free_name, scan
from docweave.llm.packed import PACKED, find, mapped, merge, pack, save, shard_count, shared_folder, unique_counts
from docweave.llm.words import U64, blocks, mix, offsets, row_sums, text_bytes, word_hashes
from docweave.session import stage

END = int(mix(np.array([0xE4D], U64))[0])
HELD = 2_500_000  # words or pairs a task sorts at once
READ = 4 << 20  # bytes of text scored at once
MANY = "kind string, shard int, keys binary, counts binary, v long, n1 long, n2 long, n3 long, n4 long, total long"


def tokens(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the texts' offsets in them."""
    words, counts = word_hashes(at, data)
    start = offsets(counts + 1)
    out = np.empty(len(words) + len(counts), U64)
    ends = np.zeros(len(out), bool)
    ends[start[1:] - 1] = True
    out[ends] = U64(END)
    out[~ends] = words
    return out, start


def _texts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at, limit):
            yield tokens(at[i : j + 1] - at[i], data[at[i] : at[j]])


def _packed(parts: Iterator[np.ndarray], packer) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n > HELD:
            yield from packer(*unique_counts(np.concatenate(held)))
            held, n = [], 0
    if n:
        yield from packer(*unique_counts(np.concatenate(held)))


def _count_words(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _packed((t for t, _ in _texts(batches, READ)), lambda k, c: pack(k, c, shards))


def _rows(**columns) -> pa.RecordBatch:
    """A batch of MANY; columns not given are null."""
    n = len(next(iter(columns.values())))
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in MANY.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields], [name for name, _ in fields]
    )


def _save_words(folder: str, shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    save(f"{folder}/word-{shard}", keys)
    save(f"{folder}/count-{shard}", counts.astype(np.int64))
    yield _rows(kind=["words"], shard=[shard], v=[len(keys)], total=[int(counts.sum())])
    top = np.argsort(-counts, kind="stable")[:256]
    top = top[counts[top] > counts.sum() // 2048]
    yield _rows(kind=["top"] * len(top), shard=[shard] * len(top), v=top.tolist(), total=counts[top].tolist())


def word_numbers(model: dict, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words' numbers (-1 if unknown) and counts, and each token's place among them."""
    keys, back = np.unique(words, return_inverse=True)
    place, ranges = find(model["folder"], "word", model["word_shards"], keys, model["shards"])
    number, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    for s, i, j in ranges:
        ok = np.flatnonzero(place[i:j] >= 0) + i
        number[ok] = place[ok] + model["base"][s]
        count[ok] = mapped(f"{model['folder']}/count-{s}", np.int64)[place[ok]]
    return number, count, back


def contexts(model: dict, number: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What stands before each token: a word's number, -1, or V at the start of a text."""
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[start[:-1]] = model["V"]
    return before


def pair_shards(model: dict, keys: np.ndarray) -> np.ndarray:
    v = keys >> U64(32)
    spread = np.isin(v, model["hot"])
    return (mix(np.where(spread, keys, v)) % U64(model["shards"])).astype(np.int64)


def _count_pairs(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value

    def pairs():
        for words, start in _texts(batches, READ):
            number, _, back = word_numbers(model, words)
            number = number[back]
            yield (contexts(model, number, start).astype(U64) << U64(32)) | number.astype(U64)

    yield from _packed(pairs(), lambda k, c: pack(k, c, model["shards"], pair_shards(model, k)))


def _classes(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per group: how many counts are 1, 2, and more."""
    return np.stack([np.add.reduceat((counts == 1).astype(np.int64), at), np.add.reduceat((counts == 2).astype(np.int64), at), np.add.reduceat((counts > 2).astype(np.int64), at)], 1)


def _save_pairs(shared, shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = shared.value
    folder = model["folder"]
    save(f"{folder}/pair-{shard}", keys)
    save(f"{folder}/times-{shard}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
    v = keys >> U64(32)
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    n, v = _classes(counts, at), v[at]
    spread = np.isin(v, model["hot"])
    save(f"{folder}/context-{shard}", v[~spread])
    save(f"{folder}/classes-{shard}", n[~spread].astype(np.uint32))
    if spread.any():
        a, b, c = n[spread].T.tolist()
        yield _rows(kind=["context"] * len(a), v=v[spread].astype(np.int64).tolist(), n1=a, n2=b, n3=c)
    few = np.bincount(np.minimum(counts, 5), minlength=6)
    yield _rows(kind=["pairs"], shard=[shard], n1=[int(few[1])], n2=[int(few[2])], n3=[int(few[3])], n4=[int(few[4])])
    followers, n = unique_counts(keys & U64(0xFFFFFFFF))
    order = np.argsort(mix(followers))
    for packed in pack(mix(followers)[order], n[order], model["shards"]):
        yield _rows(kind=["follower"] * packed.num_rows, shard=packed.column(0), keys=packed.column(1), counts=packed.column(2))


def _save_followers(folder: str, shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    save(f"{folder}/follower-{shard}", keys)
    save(f"{folder}/after-{shard}", counts.astype(np.int64))
    few = np.bincount(np.minimum(counts, 5), minlength=6)
    yield _rows(kind=["followers"], shard=[shard], n1=[int(few[1])], n2=[int(few[2])], n3=[int(few[3])], n4=[int(few[4])], v=[len(keys)], total=[int(counts.sum())])


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), i) for x, i in zip(d, (0.95, 1.95, 2.95), strict=True))])


def train(docs: DataFrame) -> dict:
    """Count the texts of ``docs`` and return what a worker needs to find and use the arrays."""
    spark = docs.sparkSession
    texts = docs.select("text")
    shards, folder = shard_count(texts), shared_folder(spark, "model")
    words = merge(texts.mapInArrow(functools.partial(_count_words, shards), PACKED), shards, functools.partial(_save_words, folder), MANY)
    meta = words.collect()
    sizes = {r.shard: r.v for r in meta if r.kind == "words"}
    model = {"folder": folder, "shards": shards, "word_shards": set(sizes), "V": sum(sizes.values())}
    model["N"] = sum(r.total for r in meta if r.kind == "words")
    if model["V"] >= (1 << 32) - 1:
        raise ValueError("more than 2^32 - 2 distinct words")
    before = offsets(np.array([sizes.get(s, 0) for s in range(shards)]))
    model["base"] = before[:-1]
    tops = [r for r in meta if r.kind == "top" and r.total * 8 * shards > model["N"]]
    model["hot"] = np.array(sorted([*(r.v + int(before[r.shard]) for r in tops), model["V"]]), U64)
    shared = spark.sparkContext.broadcast(dict(model))
    pairs = texts.mapInArrow(functools.partial(_count_pairs, shared), PACKED)
    rows = stage(merge(pairs, shards, functools.partial(_save_pairs, shared), MANY))
    sums = rows.where("kind = 'pairs'").agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(1, 5))).first()
    model["d2"] = discounts(list(sums))
    model["pair_shards"] = {r.shard for r in rows.where("kind = 'pairs'").select("shard").collect()}
    spread = rows.where("kind = 'context'").groupBy("v").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3))).collect()
    hot = {r.v: (r.n1, r.n2, r.n3) for r in spread}  # at most one per hot context
    model["hot_classes"] = np.array([hot.get(int(v), (0, 0, 0)) for v in model["hot"]], float)
    followers = rows.where("kind = 'follower'").select("shard", "keys", "counts")
    meta = merge(followers, shards, functools.partial(_save_followers, folder), MANY).collect()
    model["follower_shards"] = {r.shard for r in meta}
    few = [sum(r[f"n{i}"] for r in meta) for i in range(1, 5)]
    model["A"], kinds = sum(r.total for r in meta), sum(r.v for r in meta)
    model["d1"] = d = discounts(few)
    left = d[1] * few[0] + d[2] * few[1] + d[3] * (kinds - few[0] - few[1])
    model["uniform"] = left / (model["V"] + 1)
    model["texts"] = texts.count()
    return model


def lowest(model: dict, number: np.ndarray) -> np.ndarray:
    """Continuation probability of distinct words by number; -1 is the unknown word."""
    if not model["A"]:
        return np.full(len(number), 1 / (model["V"] + 1))
    after = np.zeros(len(number), np.int64)
    known = np.flatnonzero(number >= 0)
    keys = mix(number[known].astype(U64))
    order = np.argsort(keys)
    known, keys = known[order], keys[order]
    place, ranges = find(model["folder"], "follower", model["follower_shards"], keys, model["shards"])
    for s, i, j in ranges:
        ok = np.flatnonzero(place[i:j] >= 0) + i
        after[known[ok]] = mapped(f"{model['folder']}/after-{s}", np.int64)[place[ok]]
    return (after - model["d1"][np.minimum(after, 3)] + model["uniform"]) / model["A"]


def _search(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
    return np.where(have[place] == keys, place, -1) if len(have) else np.full(len(keys), -1)


def probabilities(model: dict, number: np.ndarray, count: np.ndarray, back: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of every token after what precedes it."""
    low = lowest(model, number)[back]
    token, seen = number[back], count[back]
    before = contexts(model, token, start)
    total = np.empty(len(token), np.int64)
    total[1:] = seen[:-1]
    total[start[:-1]] = model["texts"]
    out, v = low.copy(), np.flatnonzero((before >= 0) & (total > 0))
    if not len(v):
        return out
    folder, shards = model["folder"], model["shards"]
    # Mass that each context leaves to the lower order.
    some, at = np.unique(before[v], return_inverse=True)
    some = some.astype(U64)
    classes = np.zeros((len(some), 3))
    place = np.minimum(np.searchsorted(model["hot"], some), len(model["hot"]) - 1)
    hot = model["hot"][place] == some
    classes[hot] = model["hot_classes"][place[hot]]
    shard = np.where(hot, -1, (mix(some) % U64(shards)).astype(np.int64))
    for s in np.unique(shard[shard >= 0]).tolist():
        if s in model["pair_shards"]:
            own = np.flatnonzero(shard == s)
            p = _search(mapped(f"{folder}/context-{s}", U64), some[own])
            classes[own[p >= 0]] = mapped(f"{folder}/classes-{s}", np.uint32).reshape(-1, 3)[p[p >= 0]]
    left = (classes @ model["d2"][1:])[at]
    # Discounted counts of the pairs.
    pairs = np.flatnonzero(token[v] >= 0)
    keys, back2 = np.unique((before[v][pairs].astype(U64) << U64(32)) | token[v][pairs].astype(U64), return_inverse=True)
    times, shard = np.zeros(len(keys), np.int64), pair_shards(model, keys)
    order = np.argsort(shard, kind="stable")
    ends = offsets(np.bincount(shard, minlength=shards))
    for s in model["pair_shards"]:
        own = order[ends[s] : ends[s + 1]]
        if len(own):
            p = _search(mapped(f"{folder}/pair-{s}", U64), keys[own])
            times[own[p >= 0]] = mapped(f"{folder}/times-{s}", np.uint32)[p[p >= 0]]
    c = np.zeros(len(v))
    c[pairs] = (times - model["d2"][np.minimum(times, 3)])[back2]
    good = left > 0  # a context that was never counted leaves everything to the lower order
    out[v[good]] = ((c + left * low[v]) / total[v])[good]
    return out


def _score(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    model = shared.value
    names = ["n_tokens", "n_known", "base_score", "score"]
    kind = pa.struct([(names[0], pa.int64()), (names[1], pa.int64()), (names[2], pa.float64()), (names[3], pa.float64())])
    for column in columns:
        at, data = text_bytes(column)
        parts = [pa.array([], kind)]
        for i, j in blocks(at, READ):
            words, start = tokens(at[i : j + 1] - at[i], data[at[i] : at[j]])
            number, count, back = word_numbers(model, words)
            base = np.log10((count + 0.5) / (model["N"] + 0.5 * (model["V"] + 1)))[back]
            p = np.log10(probabilities(model, number, count, back, start))
            values = [np.diff(start), row_sums((count > 0)[back], start), row_sums(base, start), row_sums(p, start)]
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in values], fields=list(kind)))
        yield pa.concat_arrays(parts)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10 probabilities).

    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    c = free_name(docs.columns, "_lm")
    kind = "n_tokens long, n_known long, base_score double, score double"
    scored = docs.withColumn(c, scan(_score, kind, shared)("text"))
    names = ["n_tokens", "n_known", "base_score", "score"]
    columns: dict[str, Column] = {n: F.col(f"{c}.{n}") for n in names}
    return scored.withColumns(columns | {"train_tokens": F.lit(model["N"]).cast("long")}).drop(c)
