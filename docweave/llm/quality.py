"""Document quality by co-training.

Two views of a document: its text (word, word-head and shape features) and its metadata
(source, language, size).  Each view has a logistic classifier, calibrated on held-out labels.
Over rounds, each view labels the pool documents it is sure of (and has shown to be right about
on held-out labels) for the other view.  In the end both calibrated views are combined, and all
documents are scored in one pass.  This is done for two targets, quality and toxicity; a
document is kept if it is more likely good than not and more likely not toxic.

Sample bounds: ``LABELLED`` labelled and ``POOL`` unlabelled documents, those with the smallest
hash of their id; whole texts.  Everything else covers all documents.  The labelled ones are drawn
per class (a combination of both labels): as many of each, or all if there are fewer.  Calibration
weighs them by what they stand for.  A fifth of each class, one at least, is held out.

Null text is empty, and texts of any length count whole.  Of labels that repeat, the worse counts; a
null label teaches nothing, and a label of one target teaches that one.  Ids of equal hash are drawn in
the order of the ids; rows that repeat are scored each.  An empty table gives no rows.  With
fewer than ``FEW`` labels of a class to fit, weights are held closer to zero.  A target is not
learned (quality 1, toxicity 0) only if no label, or a single one in each combination, of one of
its classes belongs to a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.columns import free_name, scan
from docweave.llm.words import ALNUM, SPACED, U64, blocks, mix, offsets, row_sums, text_bytes, word_hashes
from docweave.session import stage

LABELLED = 8_000
POOL = 8_000
FEW = 20
FEATURES = 1_500  # words and word heads per target
HEAD = 5
ROUNDS = 3
SURE = 0.97
BINS = 12
SOURCES, LANGS, SIZES = 64, 16, 20
TARGETS = ("quality", "toxic")
SHAPES = 11


def _words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of word heads, told apart, and words per text."""
    words, counts = word_hashes(at, data, ALNUM)
    heads, _ = word_hashes(at, data, ALNUM, HEAD)
    return words, mix(heads + U64(1)), counts


_CLASS = np.zeros((6, 256), bool)
for _b in range(256):
    _CLASS[0, _b] = 65 <= _b <= 90
    _CLASS[1, _b] = _b == 33
    _CLASS[2, _b] = 33 <= _b <= 126 and not chr(_b).isalnum() and chr(_b) not in "!.,"
    _CLASS[3, _b] = 48 <= _b <= 57
    _CLASS[4, _b] = _b == 10
    _CLASS[5, _b] = _b >= 128


def shapes(at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Numbers that describe how a text looks, one row per text."""
    size = np.maximum(np.diff(at), 1)
    out = np.zeros((len(size), SHAPES))
    for k in range(6):
        out[:, k] = row_sums(_CLASS[k][data].astype(np.int64), at) / size
    words, counts = word_hashes(at, data, SPACED)
    start, n = offsets(counts), np.maximum(counts, 1)
    same = np.r_[False, words[1:] == words[:-1]].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    same[start[:-1][counts > 0]] = 0
    out[:, 6] = np.log1p(counts)
    out[:, 7] = size / n
    out[:, 8] = row_sums(same, start) / n
    for i, c in enumerate(counts.tolist()):
        if c:
            w = np.sort(words[start[i] : start[i + 1]])
            at_ = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            out[i, 9] = len(at_) / c
            out[i, 10] = np.diff(np.r_[at_, c]).max() / c
    return out


def _features(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Distinct word and head hashes of each text."""
    for column in columns:
        at, data = text_bytes(column)
        out = []
        for i, j in blocks(at):
            words, heads, counts = _words(at[i : j + 1] - at[i], data[at[i] : at[j]])
            start = offsets(counts)
            for k in range(j - i):
                own = slice(start[k], start[k + 1])
                out.append(np.unique(np.concatenate([words[own], heads[own]])).view(np.int64))
        yield pa.array(out, pa.list_(pa.int64()))


def _found(model: dict, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the chosen features that occur, each once."""
    chosen, sieve = model["features"], model["sieve"]
    words, heads, counts = _words(at, data)
    doc = np.repeat(np.arange(len(counts)), counts)
    out = []
    for h in (words, heads):
        near = np.flatnonzero(sieve[(h >> U64(44)).astype(np.int64)])
        p = np.minimum(np.searchsorted(chosen, h[near]), max(len(chosen) - 1, 0))
        good = chosen[p] == h[near] if len(chosen) else np.zeros(len(near), bool)
        out.append(doc[near][good] * len(chosen) + p[good])
    both = np.unique(np.concatenate(out))
    return both // max(len(chosen), 1), both % max(len(chosen), 1)


def binned(model: dict, values: np.ndarray) -> np.ndarray:
    """The column of each shape's bin."""
    return np.stack([k * BINS + np.searchsorted(e, values[:, k]) for k, e in enumerate(model["edges"])], 1)


def text_rows(model: dict, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows of the text view: texts and columns, ordered by text."""
    n = len(at) - 1
    doc, feature = _found(model, at, data)
    rows = np.concatenate([np.repeat(np.arange(n), SHAPES), doc])
    columns = np.concatenate([binned(model, shapes(at, data)).ravel(), SHAPES * BINS + feature])
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order]


def metadata_columns(docs: DataFrame) -> list[Column]:
    """The three columns of the metadata view; a missing table column counts as null."""
    have = {c.lower() for c in docs.columns}
    source, lang, size = (F.col(c) if c in have else F.lit(None) for c in ("source", "lang", "n_chars"))
    bucket = F.coalesce(F.log2(F.greatest(size.cast("double"), F.lit(0.0)) + 1), F.lit(0.0)).cast("int")
    return [
        F.pmod(F.xxhash64(source.cast("string")), F.lit(SOURCES)).cast("int"),
        (F.pmod(F.xxhash64(lang.cast("string")), F.lit(LANGS)) + SOURCES).cast("int"),
        (F.least(bucket, F.lit(SIZES - 1)) + SOURCES + LANGS).cast("int"),
    ]


# --- fitting, on the bounded sample -----------------------------------------------------


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_sparse(rows, columns, y, use, width, weights=None, steps=120, ridge=2e-4) -> np.ndarray:
    """Logistic weights (the last is the constant) by Adam on the rows in ``use``."""
    n = len(y)
    w = np.zeros(width + 1) if weights is None else weights.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = use / max(use.sum(), 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + w[-1]
        e = (sigmoid(z) - y) * share
        g = np.r_[np.bincount(columns, e[rows], width), e.sum()] + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, stands: np.ndarray, ridge=1e-2) -> np.ndarray:
    """Logistic weights (the last is the constant) of few columns, by Newton steps."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = sigmoid(a @ w)
        h = (a * (stands * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (stands * (p - y)) + ridge * w)
    return w


def co_train(views: list[tuple], y: np.ndarray, known: np.ndarray, held: np.ndarray, stands: np.ndarray | None = None) -> dict | None:
    """Weights, calibration and combination of two views.

    ``views``: (rows, columns, width) of each; ``y``: labels where ``known``; ``held``: those
    labels that only calibrate; ``stands``: how many labels each stands for.
    """
    fit, n = known & ~held, len(y)
    stands = np.ones(n) if stands is None else stands
    least = min(y[fit].sum(), (1 - y[fit]).sum(), y[held].sum() * 6, (1 - y[held]).sum() * 6)
    if least == 0:
        return None
    few = max(1.0, FEW / least) ** 2
    labels, uses = [y.astype(float).copy() for _ in views], [fit.astype(float) for _ in views]
    weights: list = [None] * len(views)
    calibration: list = [None] * len(views)
    for r in range(ROUNDS + 1):
        sure = []
        for k, (rows, columns, width) in enumerate(views):
            weights[k] = fit_sparse(rows, columns, labels[k], uses[k], width, weights[k], ridge=2e-4 * few)
            z = np.bincount(rows, weights[k][columns], n) + weights[k][-1]
            calibration[k] = fit_dense(z[held, None], y[held], stands[held], 1e-2 * few)
            p = sigmoid(calibration[k][0] * z + calibration[k][1])
            sure.append((p, z))
        if r == ROUNDS:
            break
        for k, (p, _) in enumerate(sure):
            other = 1 - k
            for label, score in ((1.0, p), (0.0, 1 - p)):
                tried = held & (score >= SURE)
                usual = np.average(y[held] != label, weights=stands[held])
                if tried.sum() < 10 or np.average(y[tried] != label, weights=stands[tried]) > min(0.05, usual / 2):
                    continue  # not shown to be right when it is sure, or sure only as the other class is rare
                new = np.flatnonzero(~known & (uses[other] == 0) & (score >= SURE))
                share = max(1, int(0.1 * n * np.average(y[fit] == label, weights=stands[fit])))
                new = new[np.argsort(-score[new], kind="stable")[:share]]
                labels[other][new], uses[other][new] = label, 1.0
    logits = np.stack([c[0] * z + c[1] for c, (_, z) in zip(calibration, sure, strict=True)], 1)
    return {"weights": weights, "calibration": calibration, "combination": fit_dense(logits[held], y[held], stands[held], 1e-2 * few)}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled and pool documents: text, metadata columns, labels (null in the pool), fold."""
    fine = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    fine = fine.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").where("doc_id is not null")
    # Only ids with a document count.
    labelled = stage(fine.join(ids.distinct(), "doc_id", "left_semi"))
    labelled = per_class(labelled, {tuple(r[:2]): r[2] for r in labelled.groupBy(*TARGETS).count().collect()})
    pool = ids.distinct().join(fine, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(POOL)
    chosen = labelled.unionByName(pool, allowMissingColumns=True)
    meta = F.array(*metadata_columns(docs)).alias("meta")
    # A repeated id stands for its first text.
    rows = docs.select("doc_id", "text", meta).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(
        F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "meta", "quality", "toxic", "stands", "held")).alias("x")
    )
    return stage(one.select("doc_id", "x.*"))


def shares(counts: dict, most: int) -> dict:
    """As many of each class, or all if there are fewer; ``most`` together."""
    out, left = {}, most
    for i, c in enumerate(sorted(counts, key=lambda c: (counts[c], str(c)))):
        out[c] = min(counts[c], left // (len(counts) - i))
        left -= out[c]
    return out


def per_class(labelled: DataFrame, counts: dict) -> DataFrame:
    """The sample of the labelled ids, with what each stands for and whether it is held out."""
    out = labelled.where("false").select("*", F.lit(1.0).alias("stands"), F.lit(False).alias("held"))
    for (quality, toxic), take in shares(counts, LABELLED).items():
        own = labelled.where(F.col("quality").eqNullSafe(F.lit(quality)) & F.col("toxic").eqNullSafe(F.lit(toxic)))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(take)
        apart = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(min(max(1, take // 5), take - 1))
        own = own.join(F.broadcast(apart.withColumn("held", F.lit(True))), "doc_id", "left")
        stands = F.lit(counts[quality, toxic] / max(take, 1))
        out = out.unionByName(own.select("doc_id", *TARGETS, stands.alias("stands"), F.coalesce("held", F.lit(False)).alias("held")))
    return stage(out)


def choose_features(rows: DataFrame) -> np.ndarray:
    """The words and heads that tell the classes of a target apart best, on the fitting fold."""
    fit = rows.where("(quality is not null or toxic is not null) and not held")
    found = fit.select("quality", "toxic", F.explode(scan(_features, "array<long>")("text")).alias("f"))
    counted = [F.sum(t).cast("double").alias(t) for t in TARGETS] + [F.count(t).alias(f"n_{t}") for t in TARGETS]
    counts = stage(found.groupBy("f").agg(F.count("*").alias("n"), *counted).where("n >= 3"))
    total = fit.agg(*counted).first()
    chosen: set[int] = set()
    for t in TARGETS:  # each from the rows that have its label
        share = (total[t] or 0.0) / max(total[f"n_{t}"], 1)
        expected = F.col(f"n_{t}") * share
        score = (F.col(t) - expected) ** 2 / (expected * (1 - share) + 1e-9)
        chosen |= {r.f for r in counts.where(f"n_{t} > 0").orderBy(score.desc(), "f").limit(FEATURES).select("f").collect()}
    return np.sort(np.array(sorted(chosen), np.int64).view(U64))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The combined model, from the labelled sample and the pool."""
    rows = sample(docs, labels)
    model: dict = {"features": choose_features(rows), "edges": [np.zeros(0)] * SHAPES}
    model["sieve"] = np.zeros(1 << 20, bool)
    model["sieve"][(model["features"] >> U64(44)).astype(np.int64)] = True
    shaped = rows.select(F.explode(scan(_shape_lists, "array<array<double>>")("text")).alias("x")).select("x").toArrow()
    values = np.array(shaped.column("x").to_pylist(), float).reshape(-1, SHAPES)
    if len(values):
        model["edges"] = [np.unique(np.quantile(values[:, k], np.arange(1, BINS) / BINS)) for k in range(SHAPES)]
    shared = rows.sparkSession.sparkContext.broadcast(model)
    data = rows.select("doc_id", "quality", "toxic", "stands", "held", "meta", scan(_column_lists, "array<int>", shared)("text").alias("x"))
    data = data.orderBy("doc_id").toArrow()
    lists = data.column("x").combine_chunks()
    text_view = (np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy(), SHAPES * BINS + max(1, len(model["features"])))
    meta = np.array(data.column("meta").to_pylist(), np.int64).reshape(-1, 3)
    meta_view = (np.repeat(np.arange(len(meta)), 3), meta.ravel(), SOURCES + LANGS + SIZES)
    apart = np.array([bool(h) for h in data.column("held").to_pylist()], bool)
    stands = np.array([x or 1.0 for x in data.column("stands").to_pylist()], float)
    for t in TARGETS:
        known = np.array([x is not None for x in data.column(t).to_pylist()], bool)
        y = np.array([x or 0 for x in data.column(t).to_pylist()], float)
        model[t] = co_train([text_view, meta_view], y, known, apart & known, stands)
    return model


def _shape_lists(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        at, data = text_bytes(column)
        out = [[r] for i, j in blocks(at) for r in shapes(at[i : j + 1] - at[i], data[at[i] : at[j]]).tolist()]
        yield pa.array(out, pa.list_(pa.list_(pa.float64())))


def _column_lists(shared, columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        at, data = text_bytes(column)
        parts = [pa.array([], pa.list_(pa.int32()))]
        for i, j in blocks(at):
            rows, columns_ = text_rows(shared.value, at[i : j + 1] - at[i], data[at[i] : at[j]])
            ends = offsets(np.bincount(rows, minlength=j - i))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns_, pa.int32())))
        yield pa.concat_arrays(parts)


def _score(shared, columns) -> Iterator[pa.Array]:
    """Calibrated probability of each view, and the combination, per target."""
    model = shared.value
    names = [f"{t}_{v}" for t in TARGETS for v in ("text", "metadata", "score")]
    for texts, *meta in columns:
        at, data = text_bytes(texts)
        meta = np.stack([m.to_numpy(zero_copy_only=False) for m in meta], 1)
        out = np.zeros((len(texts), 6))
        out[:, :3] = 1.0
        for i, j in blocks(at):
            rows, cols = text_rows(model, at[i : j + 1] - at[i], data[at[i] : at[j]])
            for k, t in enumerate(TARGETS):
                if (m := model[t]) is not None:
                    z = [np.bincount(rows, m["weights"][0][cols], j - i), m["weights"][1][meta[i:j]].sum(1)]
                    logits = np.stack([c[0] * (x + w[-1]) + c[1] for x, w, c in zip(z, m["weights"], m["calibration"], strict=True)], 1)
                    out[i:j, 3 * k : 3 * k + 2] = sigmoid(logits)
                    out[i:j, 3 * k + 2] = sigmoid(logits @ m["combination"][:-1] + m["combination"][-1])
        yield pa.StructArray.from_arrays([pa.array(out[:, c]) for c in range(6)], names)


SCORES = ", ".join(f"{t}_{v} double" for t in TARGETS for v in ("text", "metadata", "score"))


def with_quality(docs: DataFrame, labels: DataFrame, into: str = "_quality") -> DataFrame:
    """``docs`` with a struct of the views' and the combined probabilities of both targets.

    A column named like ``into`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.withColumn(into, scan(_score, SCORES, shared)("text", *metadata_columns(docs)))


def kept(column: str) -> Column:
    return (F.col(f"{column}.quality_score") >= 0.5) & (F.col(f"{column}.toxic_score") < 0.5)


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Only the documents that are more likely good and not toxic; columns unchanged."""
    c = free_name(docs.columns, "_quality")
    return with_quality(docs, labels, c).where(kept(c)).drop(c)
