"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

One more dimension makes all vectors equally long, so the largest inner product is the
smallest distance.  Vectors are rotated at random and assigned to the nearest of the lists
fitted on a bounded sample, about as many as the square root of their number; every vector is
indexed.  A query visits the lists nearest to it, and goes on until they hold enough candidates.
In a list, distances grow by blocks of rotated columns, and after each block a hypothesis test
abandons the candidates whose partial distance says that they are beyond the best so far.
What survives is scored exactly, in double precision, on the original vectors.

Equal vectors are searched once, and of their rows only those with the smallest ids can be an
answer, so a vector that a third of all rows share is a few rows.  Lists (and the queries of a
list) are split into cells of bounded size.  How many lists a query visits is the least share that
reaches ``recall`` on the sample.

No part is taken by vectors that are null, zero, hold null or non-finite components, or have no
id.  Vectors of different lengths are no candidates for each other: each length is searched by
itself.  Rows that share an id are rows of their own, and each is asked if its id is.  Queries
with fewer candidates than ``k`` return all of them; ties go to the smaller id.  An empty table
gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import stage

SAMPLE = 20_000  # vectors that lists are fitted on
CELL = 8_192  # vectors and queries of a cell
LENGTHS = 64  # lengths of vectors, each of which is searched by itself
SALTS = 16  # tasks over which rows that ask the same are spread
BLOCK = 16  # rotated columns between tests
BATCH = 2_048
CERTAINTY = 2.1  # of the test, as multiples of 1 / sqrt(columns seen)


def usable(vectors: DataFrame, asked: Column) -> DataFrame:
    """vec_id, v (doubles), whether it is asked, and its length, of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & some)
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros, so equal vectors are equal
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"), F.size("embedding").alias("d"))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def fit(sample: np.ndarray, longest: float, lists: int, k: int, recall: float, seed: int = 0) -> dict:
    """Rotation, lists and the number of lists to visit."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    model = {"rotation": rotation, "longest": longest}
    x = raised(model, sample)
    lists = max(1, min(lists, len(x)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = nearest_lists(centres, x, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    model["centres"] = centres
    # The lists that hold the true neighbours of sampled queries, among the sample.
    asked = sample[: min(300, len(sample))]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, max(1, len(sample) - 1))
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    order = nearest_lists(centres, asked_rotated(model, asked), lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), 0), 1)
    own = nearest_lists(centres, x, 1)[:, 0]
    needed = np.sort(place[np.arange(len(asked))[:, None], own[true]].ravel())
    model["visits"] = int(min(lists, needed[min(len(needed) - 1, int(recall * len(needed)))] + 1))
    return model


def raised(model: dict, v: np.ndarray) -> np.ndarray:
    """Candidates: made equally long by one more dimension, then rotated."""
    rest = np.sqrt(np.maximum(model["longest"] ** 2 - (v * v).sum(1), 0))
    return (np.c_[v, rest] @ model["rotation"]).astype(np.float32)


def asked_rotated(model: dict, v: np.ndarray) -> np.ndarray:
    """Queries: nothing in the further dimension."""
    return (np.c_[v, np.zeros(len(v))] @ model["rotation"]).astype(np.float32)


def nearest_lists(centres: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    size, step = (centres * centres).sum(1)[None, :], max(1, (1 << 22) // len(centres))
    out = []
    for i in range(0, len(x), step):
        d = size - 2 * (x[i : i + step] @ centres.T)
        out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def _assign(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        if batch.num_rows:
            x = raised(model, matrix(batch.column(2)))
            near = nearest_lists(model["centres"], x, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], ["row", "vec_id", "v", "list"])


def visited(order: np.ndarray, sizes: np.ndarray, visits: int, k: int) -> list[np.ndarray]:
    """The nearest lists of each query: as many as fitted, and on until they hold ``k`` vectors."""
    out = []
    for lists in order:
        lists = lists[sizes[lists] > 0]
        enough = int(np.searchsorted(np.cumsum(sizes[lists]), k)) + 1
        out.append(lists[: max(visits, enough)])
    return out


def _visits(shared, sizes: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        if batch.num_rows:
            centres = model["centres"]
            order = nearest_lists(centres, asked_rotated(model, matrix(batch.column(1))), len(centres))
            lists = visited(order, sizes, model["visits"], k)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            there = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, there], ["asking", "q", "lists"])


def scan_cell(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that may be among the ``k`` nearest of a rotated query."""
    d = x.shape[1]
    first = min(len(x), 2 * k)
    known = ((x[:first] - q) ** 2).sum(1)
    places = np.arange(first)
    best = np.partition(known, k - 1)[k - 1] if first >= k else np.inf
    for start in range(first, len(x), BATCH):
        here = np.arange(start, min(start + BATCH, len(x)))
        part = np.zeros(len(here), np.float32)
        for a in range(0, d, BLOCK):
            b = min(a + BLOCK, d)
            part += ((x[here, a:b] - q[a:b]) ** 2).sum(1)
            bound = best * b / d * (1 + CERTAINTY / np.sqrt(b)) ** 2 if b < d else best * (1 + 1e-5)
            near = part <= bound
            here, part = here[near], part[near]
            if not len(here):
                break
        if len(here):
            known, places = np.r_[known, part], np.r_[places, here]
            if len(known) >= k:
                best = np.partition(known, k - 1)[k - 1]
                near = known <= best * (1 + 1e-5)
                known, places = known[near], places[near]
    return places[known <= best * (1 + 1e-5)]


def _search(shared, k: int, asked: pa.Table, cell: pa.Table) -> pa.Table:
    """The best ``k`` of a cell for each of its queries."""
    out: list[list] = [[], [], [], []]
    if asked.num_rows and cell.num_rows:
        model = shared.value
        order = np.lexsort((cell.column("row").to_numpy(), cell.column("vec_id").to_numpy()))
        ids, rows, v = cell.column("vec_id").to_numpy()[order], cell.column("row").to_numpy()[order], matrix(cell.column("v"))[order]
        x = raised(model, v)
        q = matrix(asked.column("q"))
        rotated = asked_rotated(model, q)
        for i, own in enumerate(asked.column("asking").to_pylist()):
            places = scan_cell(rotated[i], x, k)
            score = (v[places] * q[i]).sum(1)
            top = np.lexsort((rows[places], ids[places], -score))[:k]
            out[0] += [own] * len(top)
            out[1] += rows[places][top].tolist()
            out[2] += ids[places][top].tolist()
            out[3] += score[top].tolist()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["asking", "row", "vec_id", "score"])


def nearest(vectors: DataFrame, asked: Column, k: int = 20, recall: float = 0.97, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each row that ``asked`` selects.

    ``lists``: how many; the square root of the number of vectors unless given, ``SAMPLE`` at most.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, asked).withColumn("row", F.monotonically_increasing_id()))
    lengths = sorted(r.d for r in rows.select("d").distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    each = [_nearest_of_length(rows.where(F.col("d") == d).drop("d"), k, recall, lists) for d in lengths]
    if not each:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return functools.reduce(DataFrame.union, each)


def _nearest_of_length(rows: DataFrame, k: int, recall: float, lists: int | None) -> DataFrame:
    spark = rows.sparkSession
    # Of equal vectors the k + 1 of smallest id: one may be the query itself.
    same = Window.partitionBy("v").orderBy("vec_id", "row")
    able = stage(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).select("row", "vec_id", "v"))
    length = F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    sizes = able.agg(length.alias("m"), F.count("*").alias("n")).first()
    sample = able.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("v").toArrow()
    wanted = lists or max(1, round(sizes.n**0.5))
    model = spark.sparkContext.broadcast(fit(matrix(sample.column("v")), sizes.m, min(wanted, SAMPLE), k, recall))
    cells = stage(able.mapInArrow(functools.partial(_assign, model), "row long, vec_id long, v array<double>, list int"))
    held = np.zeros(len(model.value["centres"]), np.int64)
    for r in cells.groupBy("list").count().collect():  # at most SAMPLE rows
        held[r["list"]] = r["count"]
    questions = stage(rows.where("asked").groupBy("v").agg(F.min("row").alias("asking")).select("asking", F.col("v").alias("q")))
    visits = questions.mapInArrow(functools.partial(_visits, model, held, k + 1), "asking long, q array<double>, lists array<int>")
    visits = stage(visits).select("asking", "q", F.explode("lists").alias("list"))

    def parts(df: DataFrame, name: str) -> DataFrame:  # a row per list
        return df.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))

    split = parts(cells, "n_cells").join(parts(visits, "n_blocks"), "list")
    each = F.sequence(F.lit(0), F.col("n") - 1)

    def dealt(df: DataFrame, own: str, other: str, key: str, names: tuple[str, str]) -> DataFrame:
        """Own part by hash, and a copy for every part of the other side."""
        there = df.join(F.broadcast(split), "list").withColumn(names[0], F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        return there.withColumn("n", F.col(other)).withColumn(names[1], F.explode(each)).drop("n", "n_cells", "n_blocks")

    left = dealt(visits, "n_blocks", "n_cells", "asking", ("block", "cell"))
    right = dealt(cells, "n_cells", "n_blocks", "row", ("cell", "block"))
    search = functools.partial(_search, model, k + 1)

    def in_cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a, b)

    result = "asking long, row long, vec_id long, score double"
    found = left.groupBy("list", "cell", "block").cogroup(right.groupBy("list", "cell", "block")).applyInArrow(in_cell, result)
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    answer = F.struct("place", "row", "vec_id", "score")
    best = ranked.groupBy("asking").agg(F.array_sort(F.collect_list(answer)).alias("best"))  # k + 1 of them
    best = best.join(questions, "asking").select(F.col("q").alias("v"), "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asking = rows.where("asked").select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    others = F.slice(F.filter("best", lambda x: x["row"] != F.col("own")), 1, k)
    answers = asking.join(best, ["v", "salt"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
