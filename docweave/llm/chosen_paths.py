"""Set similarity join by chosen paths: trees that branch on minwise tokens.

A text is the set of its distinct 4-word shingles; equal sets are one node.  A tree sends a set to
the branches of a few of its minwise tokens (its least shingles under fixed hashes), so two sets
with similarity s go the same way with probability s each time.  Branches of few sets are leaves
and compared exhaustively.  Larger ones branch again on further tokens, which the path chooses, as
long as they hold several components (``leaves.py``); sets that agree in all tokens of a path are
nearly alike, so what is left after ``DEPTH`` levels is small or one component, and the rest
meets in a grid of cells.  Of similar sets each branch loses a fifth at most, and at two branches
a node a tree loses at most 1 in 16 pairs at similarity 0.8; ``TREES`` independent trees, two in
100,000.  Links are confirmed on full sets.

Leaves rule a pair out by sizes, or if of 32 minwise tokens fewer than ``AGREE`` are equal, which
two sets of similarity 0.8 do once in 10^6.

Null and wordless text has an empty set and links with nothing; a text of fewer than four words is
one shingle.  Rows that repeat an id or a text are rows of one node.  Rows get the smallest id of
all rows linked to theirs; null ids name nothing, and a row without an id that is linked to none
keeps null.  Of texts of any length all shingles count.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.leaves import linked, pieces
from docweave.llm.words import U64, blocks, mix, ngrams, offsets, text_bytes, word_hashes
from docweave.session import stage

SHINGLE = 4
TREES, BRANCHES, DEPTH = 4, 2, 4
TOKENS = 32  # minwise tokens: eight a level
AGREE = 14
ODD = mix(np.arange(1, TOKENS + 1, dtype=U64)) | U64(1)


def shingle_sets(at: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all texts in a row, and where each text's begin."""
    words, counts = word_hashes(at, data)
    grams, start = ngrams(words, width), offsets(counts)
    sets = []
    for i, n in enumerate(counts.tolist()):
        if n >= width:
            s = np.sort(grams[start[i] : start[i + 1] - width + 1])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            sets.append(mix(ngrams(words[start[i] : start[i + 1]], n) + U64(n)))
        else:
            sets.append(words[:0])
    return np.concatenate([words[:0], *sets]), offsets(np.array([len(s) for s in sets], np.int64))


def set_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name per set; equal sets have equal names."""
    sums = np.zeros(len(flat) + 1, U64)
    np.cumsum(mix(flat), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64)).view(np.int64)


def tokens(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set and hash the least value, which names a shingle."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, TOKENS), U64)
    if len(full):
        for t in range(TOKENS):
            out[full, t] = np.minimum.reduceat(flat * ODD[t], at[:-1][full])
    return out


def _rows(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set's size and name per text, the keys of the trees' roots and the tokens."""
    for batch in batches:
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at):
            flat, start = shingle_sets(at[i : j + 1] - at[i], data[at[i] : at[j]], width)
            low = tokens(flat, start)
            roots = mix(low[:, : TREES * BRANCHES] + np.arange(TREES * BRANCHES, dtype=U64)[None, :] * ODD[0])
            columns = [
                *(c.slice(i, j - i) for c in batch.columns[1:]),
                pa.array(np.diff(start)),
                pa.array(set_ids(flat, start)),
                pa.FixedSizeListArray.from_arrays(pa.array(roots.view(np.int64).ravel()), TREES * BRANCHES).cast(pa.list_(pa.int64())),
                pa.FixedSizeListArray.from_arrays(pa.array(mix(low).astype(np.uint32).view(np.int32).ravel()), TOKENS).cast(pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "n", "node", "keys", "tokens"])


def _pieces(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sets, in rows of bounded size."""
    for batch in batches:
        ids = batch.column(1).to_numpy()
        at, data = text_bytes(batch.column(0))
        for i, j in blocks(at):
            flat, start = shingle_sets(at[i : j + 1] - at[i], data[at[i] : at[j]], width)
            names = set_ids(flat, start)
            parts = [pieces(flat[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
            number = [len(p) for p in parts]
            columns = [
                pa.array(np.repeat(names, number)),
                pa.array(np.repeat(ids[i:j], number)),
                pa.array([k for m in number for k in range(m)], pa.int32()),
                pa.array([s.tobytes() for p in parts for s in p], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["node", "row_id", "piece", "shingles"])


def pieces_of(texts: DataFrame, width: int) -> DataFrame:
    """The sets of all texts, named as their rows are: node, row_id, piece, shingles."""
    return texts.select("text", "row_id").mapInArrow(functools.partial(_pieces, width), "node long, row_id long, piece int, shingles binary")


def may_link(percent: int, n: np.ndarray, sketches: pa.Array) -> np.ndarray:
    """Pairs whose sizes allow it and whose tokens agree often enough."""
    t = sketches.flatten().to_numpy().reshape(len(n), TOKENS)
    agree = np.zeros((len(t), len(t)), np.int8)
    for k in range(TOKENS):
        agree += t[:, k, None] == t[None, :, k]
    near = (agree >= AGREE) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
    np.fill_diagonal(near, False)
    return near


def similar_components(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("text", "doc_id", F.xxhash64("doc_id").alias("row_id"))
    made = texts.mapInArrow(functools.partial(_rows, width), f"doc_id {kind}, row_id long, n long, node long, keys array<long>, tokens array<int>")
    rows = stage(made)
    some = rows.where("n > 0")
    # One row stands for all with the same set; which one makes no difference.
    nodes = stage(some.groupBy("node").agg(*(F.min(c).alias(c) for c in ("n", "row_id", "keys", "tokens"))))
    found = linked(
        nodes.select(F.explode("keys").alias("key"), "node"),
        functools.partial(_branch, nodes.select("node", "tokens")),
        DEPTH,
        nodes.select("node", "n", F.col("tokens").alias("sketch"), "row_id"),
        pieces_of(texts, width),
        percent,
        functools.partial(may_link, percent),
    )
    return named(rows, found)


def _branch(nodes: DataFrame, members: DataFrame, level: int) -> DataFrame:
    """The next keys of the members of a group: its path chooses two of the level's tokens."""
    at = TREES * BRANCHES * level + BRANCHES * F.pmod(F.xxhash64("key"), F.lit(TREES)).cast("int")
    further = members.join(nodes, "node").withColumn("at", at).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(BRANCHES))))
    token = F.element_at("tokens", (F.col("at") + F.col("b")).cast("int"))
    return further.select(F.xxhash64("key", F.col("at") + F.col("b"), token).alias("key"), "node", "c")


def named(rows: DataFrame, found: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (and ``more``): the smallest id of all rows whose sets are linked to a row's."""
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"))
    both = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = both.groupBy("component").agg(F.min("doc").alias("id"))
    ids = both.join(smallest, "component").select("node", "id")
    component = F.when(F.col("n") > 0, F.col("id")).otherwise(F.col("doc_id"))
    return rows.join(ids, "node", "left").select("doc_id", *more, F.col("n").alias("n_shingles"), component.alias("component_id"))
