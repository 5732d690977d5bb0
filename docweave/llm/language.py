"""Language identification: multinomial naive Bayes over hashed character n-grams.

All labelled texts are counted in one pass (per task in numpy, summed in Spark); the matrix of
log probabilities, ``BUCKETS`` rows by one column per language, is broadcast, and batches are
scored as sparse sums of its rows.

Null text and text without a letter is ``und`` with score 0, as is everything when nothing was
learned.  Ties go to the language that sorts first.  Rows without a language teach nothing; repeated
rows teach and are answered each.  Texts of any length count whole.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import free_name, scan
from docweave.llm.words import blocks, offsets, row_sums, text_bytes

ORDERS = (1, 2, 3, 4)
BITS = 16
BUCKETS = 1 << BITS
U32 = np.uint32
MAX_LANGUAGES = 500  # bounds the broadcast matrix


def characters(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (A-Z lower-cased) and the texts' offsets in them."""
    points = np.frombuffer(bytes(data).decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(U32)
    return points, offsets(row_sums((data & 0xC0) != 0x80, at))


def grams(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: the bucket of the n-gram from each place, and whether it ends within its text."""
    size = np.diff(at)
    h, good = np.zeros(len(points), U32), np.ones(len(points), bool)
    for n in range(1, max(ORDERS) + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        h = (h[:m] * U32(0x01000193)) ^ (points[n - 1 :] * U32(0x85EBCA6B))
        if n > 1:
            good = good[:m].copy()
            ends = (at[1:] - (n - 1))[size >= n - 1]
            good[ends[ends < m]] = False
        if n in ORDERS:
            yield ((h ^ (h >> U32(15))) * U32(0x9E3779B1) ^ U32(n)) >> U32(32 - BITS), good


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        langs = batch.column(1).dictionary_encode() if not pa.types.is_dictionary(batch.column(1).type) else batch.column(1)
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for name, n in zip(names, np.bincount(code, minlength=len(names)).tolist(), strict=True):
            docs[name] = docs.get(name, 0) + n
            totals.setdefault(name, np.zeros(BUCKETS, np.int64))
        for i, j in blocks(at):
            points, within = characters(at[i : j + 1] - at[i], data[at[i] : at[j]])
            lang = np.repeat(code[i:j], np.diff(within)).astype(np.int64) << BITS
            for bucket, good in grams(points, within):
                keys = (lang[: len(bucket)] + bucket)[good]
                counts = np.bincount(keys, minlength=len(names) << BITS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    totals[name] += counts[k]
    for name, total in totals.items():
        some = np.flatnonzero(total)
        keys, n = np.r_[-1, some], np.r_[docs[name], total[some]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys)), pa.array(keys, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"]
        )


def train(docs: DataFrame, smoothing: float = 0.1) -> dict:
    """Log probabilities from all rows of ``docs`` (text, lang) with a language."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MAX_LANGUAGES}")
    number = {name: i for i, name in enumerate(langs)}
    column = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    counts, prior = np.full((BUCKETS, len(langs)), smoothing), np.zeros(len(langs))
    docs_of = bucket < 0
    prior[column[docs_of]] = n[docs_of]
    counts[bucket[~docs_of], column[~docs_of]] += n[~docs_of]
    return {
        "langs": np.array(langs, object),
        "prior": np.log(prior / max(prior.sum(), 1)) if len(langs) else prior,
        "weights": (np.log(counts) - np.log(counts.sum(0))).astype(np.float32),
    }


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _predict(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    model = shared.value
    langs, weights = model["langs"], model["weights"]
    for column in columns:
        at, data = text_bytes(column)
        letters = np.array([has_letter(t.as_py()) for t in column], bool)
        score = np.tile(model["prior"], (len(column), 1))
        for i, j in blocks(at) if len(langs) else ():
            points, within = characters(at[i : j + 1] - at[i], data[at[i] : at[j]])
            for bucket, good in grams(points, within):
                full = np.minimum(within, len(bucket))
                for k in range(len(langs)):
                    score[i:j, k] += row_sums(np.where(good, weights[bucket, k], 0).astype(np.float64), full)
        if len(langs):
            best = score.argmax(1)
            p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
            lang = np.where(letters, langs[best], "und")
            p = np.where(letters, p, 0.0)
        else:
            lang, p = np.full(len(column), "und", object), np.zeros(len(column))
        yield pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(p)], ["lang_pred", "score"])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior probability), from the text alone.

    Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    c = free_name(docs.columns, "_lang")
    scored = docs.withColumn(c, scan(_predict, "lang_pred string, score double", shared)("text"))
    return scored.withColumns({"lang_pred": F.col(f"{c}.lang_pred"), "score": F.col(f"{c}.score")}).drop(c)


def fold(doc_id: str, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
