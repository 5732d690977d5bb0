"""Links between sets that share a key, found inside groups of bounded size.

Keys come level by level from an operator's own way to choose them.  A group of at most ``LEAF``
sets is compared whole in one task.  A larger one is cut into cells, each of which also gets the
same few of its sets as pivots; links within cells and to pivots then tell its components.  If all
but a few stragglers are one component, the stragglers meet every cell, and the group is done.
If not, it goes on to the next level of keys, and beyond the last one to a grid of cells in which
every two sets meet.  So no pair of sets that share a key and lie in different components is left
out, and a large group of near copies costs what its rows cost.

In a task, sketches of bounded size rule pairs out first; what they leave moves once more with the
whole sets, and links are reduced to a forest while pairs are compared.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.components import components
from docweave.llm.words import U64, expand
from docweave.session import stage

LEAF = 2048
PIVOTS = 16  # expected per large group
STRAGGLERS = 512  # sets outside the largest component that every cell can take
BYTES = 6 << 20  # of the sets of a part; two parts meet in a task
PIECE = 1024  # shingles in a row of a set
OFTEN = 1.5  # candidate groups that a set is in, on average, from which groups are merged
FEW = 400_000  # rows of at most 40 bytes up to which the sets asked for are broadcast

#: n and sketches of a group's sets to the matrix of pairs that may link
MayLink = Callable[[np.ndarray, pa.Array], np.ndarray]


def pieces(shingles: np.ndarray) -> list[np.ndarray]:
    return [shingles[i : i + PIECE] for i in range(0, len(shingles), PIECE)]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each group; they come sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = [0, *changed.tolist(), batch.num_rows]
        for i, j in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[i].item() for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield last, pa.Table.from_batches(held)


def _labels(near: np.ndarray) -> np.ndarray:
    """The least member of each one's component of a symmetric matrix."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _parts(near: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """The connected sets, whole where their bytes allow it, and otherwise part by part against each other."""
    label, some = _labels(near), near.any(1)
    for lab in np.unique(label[some]).tolist():
        members = np.flatnonzero(some & (label == lab))
        part = np.cumsum(8 * n[members]) // BYTES
        parts = [members[part == k] for k in np.unique(part)]
        if len(parts) == 1:
            yield members
            continue
        for i, a in enumerate(parts):
            for b in parts[i:]:
                if near[np.ix_(a, b)].any():
                    yield np.union1d(a, b)


def _candidates(may_link: MayLink, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups within groups: sets that pairs which may link connect, numbered by the first of them."""
    out: list[list] = [[], [], [], [], []]

    def sent() -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 5, strict=True)]
        for c in out:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, ["key", "cell", "sub", "node", "c"])

    for (key, cell), rows in _groups(batches, 2):
        node, n, c = (rows.column(k).to_numpy() for k in ("node", "n", "c"))
        if len(node) < 2 or (c == c[0]).all():
            continue
        near = may_link(n, rows.column("sketch").combine_chunks())
        near &= c[:, None] != c[None, :]
        if not near.any():
            continue
        sub = 0
        for members in _parts(near, n):
            out[0] += [key] * len(members)
            out[1] += [cell] * len(members)
            out[2] += [sub] * len(members)
            out[3] += node[members].tolist()
            out[4] += c[members].tolist()
            sub += 1
        if len(out[0]) > 10_000:
            yield sent()
    if out[0]:
        yield sent()


def compared(sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different components that connect the same sets as all links do."""
    _, root = np.unique(known, return_inverse=True)
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, root = [sets[i] for i in order], root[order]
    n = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(n)])
    names, of = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int64)
    links = []
    for i in range(len(sets) - 1):
        # Sizes grow, so those that may be alike are a range.
        end = int(np.searchsorted(n, 100 * n[i] // percent, side="right"))
        others = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
        if not len(others):
            continue
        mark[of[at[i] : at[i + 1]]] = 1
        common = np.add.reduceat(mark[of[expand(at[others], n[others])]], np.cumsum(n[others]) - n[others])
        mark[of[at[i] : at[i + 1]]] = 0
        near = 100 * common >= percent * (n[i] + n[others] - common)
        for j in others[near].tolist():
            if root[i] != root[j]:
                links.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return links


def _links(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _groups(batches, 3):
        node, piece, c = (rows.column(k).to_numpy() for k in ("node", "piece", "c"))
        first = np.r_[True, (node[1:] != node[:-1]) | (piece[1:] != piece[:-1])]  # rows may be repeated
        parts = [np.frombuffer(s.as_buffer(), U64) for chunk in rows.column("shingles").chunks for s in chunk]
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ends = np.r_[at[1:], len(node)]
        sets = [np.concatenate([parts[k] for k in range(i, j) if first[k]]) for i, j in zip(at, ends, strict=True)]
        links = compared(sets, c[at], percent)
        if links:
            a, b = (node[at][[link[k] for link in links]] for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _merged(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate groups that have sets in common as one group, where a task takes it; a set moves once with it.

    ``members`` key, cell, sub, lo (the group's least node), node, c.  Groups whose union is larger stay as they are.
    """
    columns = ["key", "cell", "sub", "node", "c"]
    seen = members.agg(F.count("*").alias("m"), F.approx_count_distinct("node").alias("n")).first()
    if seen.m < OFTEN * seen.n:
        return members.select(*columns)
    of = stage(components(members.select(F.col("lo").alias("a"), F.col("node").alias("b"))))
    own = stage(members.select("node", "c").distinct().join(of, "node").join(nodes.select("node", "n"), "node"))
    fits = stage(own.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") * 8 <= BYTES).select("component"))
    fits = F.broadcast(fits) if fits.count() <= FEW else fits
    zero = F.lit(0).cast("long")
    whole = own.join(fits, "component").select(F.col("component").alias("key"), (zero - 1).alias("cell"), zero.alias("sub"), "node", "c")
    large = own.join(fits, "component", "left_anti").select("node")
    return stage(whole.union(members.join(large, "node").select(*columns)))


def _verified(candidates: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) of candidate groups, by whole sets."""
    # The same sets meet under many keys; once is enough.
    prints = candidates.groupBy("key", "cell", "sub").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")
    )
    once = prints.groupBy("m", "x", "lo", "hi").agg(F.min(F.struct("key", "cell", "sub")).alias("g")).select("g.*", "lo")
    members = _merged(stage(candidates.join(once, ["key", "cell", "sub"])), nodes)
    members = F.broadcast(members) if members.count() <= FEW else members  # then only the sets move, once
    order = ["key", "cell", "sub", "node", "piece"]
    rows = members.join(sets, "node").select(*order, "c", "shingles")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "key", "cell", "sub").sortWithinPartitions(*order)
    return rows.mapInArrow(functools.partial(_links, percent), "a long, b long")


def linked(
    first: DataFrame, branch: Callable[[DataFrame, int], DataFrame], levels: int, nodes: DataFrame, sets: DataFrame, percent: int, may_link: MayLink,
    many: bool = False, grid: int = 0,
) -> DataFrame:
    """(node, component) of all nodes that links connect.

    ``first`` holds (key, node), ``branch(members, level)`` (key, node, c) for the members (key, node, c)
    of groups that go on; a group of at most ``grid`` parts meets in the grid of its cells instead.
    ``nodes`` node, n, sketch, row_id; ``sets`` node, row_id, piece, shingles.
    ``many``: similar sets share many first keys, so each set is first compared in its largest and
    smallest group only, and then in all groups that still hold several components.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known, found, rest = nodes.withColumn("c", F.col("node")), None, None
    groups = _groups_of(first.withColumn("c", F.col("node")))
    if not many:  # Later groups are parts of these, so no other set is needed.
        sets = stage(_sets_of(groups, nodes, sets))

    def compare(cells: DataFrame, known: DataFrame, found: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """The components, and nodes with their own, after all pairs of each cell."""
        rows = cells.join(known.select("node", "n", "c", "sketch"), "node").select("key", "cell", "node", "n", "c", "sketch")
        rows = rows.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "node")
        candidates = stage(rows.mapInArrow(functools.partial(_candidates, may_link), "key long, cell long, sub long, node long, c long"))
        if not candidates.isEmpty():
            # With many groups, sets that are really asked for are far fewer than those in groups.
            new = _verified(candidates, nodes, _sets_of(candidates, nodes, sets) if many else sets, percent)
            found = stage(components(new if found is None else new.union(found.select("node", "component"))))
            known = nodes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
            known = stage(known)
        return known, found

    if many:
        known, found = compare(_cells(_own_groups(groups)), known, found)
        if found is not None:
            groups = _groups_of(groups.select("key", "node").join(known.select("node", "c"), "node"))
    for level in range(1, levels + 2):
        cells = _grid(groups) if level > levels else _cells(groups)
        cells = cells if rest is None else cells.union(rest)
        known, found = compare(cells, known, found)
        if level > levels:
            break
        large = _unsettled(groups.where(F.col("m") > LEAF), known)
        rest = _to_every_cell(large.where(F.col("m") - F.col("most") <= STRAGGLERS))
        large = large.where(F.col("m") - F.col("most") > STRAGGLERS).select("key", "node", "c", "m")
        if grid:
            rest = rest.union(_grid(large.where(_parts_of("m") <= grid)))
            large = large.where(_parts_of("m") > grid)
        if rest.isEmpty():
            rest = None
        if large.isEmpty():
            if rest is None:
                break
            groups = large
        elif level < levels:
            groups = _groups_of(stage(branch(large, level)))
        else:
            groups = large
    return nodes.select("node", F.col("node").alias("component")).where("false") if found is None else found


def _sets_of(members: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, piece, shingles of the members, each from the one row of ``sets`` that stands for it."""
    asked = stage(members.select("node").distinct().join(nodes.select("node", "row_id"), "node").select("node", "row_id"))
    asked = F.broadcast(asked) if asked.count() <= FEW else asked
    return sets.join(asked, ["node", "row_id"], "left_semi").select("node", "piece", "shingles")


def _own_groups(groups: DataFrame) -> DataFrame:
    """(key, node, m): of each node its largest and its smallest group, with how many chose it as well."""
    size = F.struct("m", "key")
    ends = groups.groupBy("node").agg(F.array_distinct(F.array(F.max(size), F.min(size))).alias("own"))
    chosen = ends.select("node", F.explode("own").alias("g")).select(F.col("g.key").alias("key"), "node")
    sizes = chosen.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return stage(chosen.join(sizes, "key"))


def _groups_of(members: DataFrame) -> DataFrame:
    """(key, node, c, m): groups of several components; of keys with the same sets one is kept."""
    sizes = members.groupBy("key").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), (F.min("c") < F.max("c")).alias("several")
    )
    once = sizes.where("several").groupBy("m", "x", "lo").agg(F.min("key").alias("key")).select("key", "m")
    return stage(members.join(once, "key").select("key", "node", "c", "m"))


def _unsettled(large: DataFrame, known: DataFrame) -> DataFrame:
    """(key, node, c, m, main, most): large groups that still hold several components, and the largest."""
    now = stage(large.select("key", "node", "m").join(known.select("node", "c"), "node"))
    parts = now.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = parts.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top")).select("key", F.col("top.c").alias("main"), F.col("top.k").alias("most"))
    return stage(now.join(main, "key").where(F.col("m") > F.col("most")))


def _to_every_cell(settled: DataFrame) -> DataFrame:
    """(key, node, cell): the largest component dealt over cells, and all others in each of them."""
    cells = F.ceil(F.col("m") / (LEAF - STRAGGLERS)).cast("long")
    own = F.array(F.pmod(F.xxhash64("node", "key"), cells))
    everywhere = F.sequence(F.lit(0).cast("long"), cells - 1)
    return settled.select("key", "node", F.explode(F.when(F.col("c") == F.col("main"), own).otherwise(everywhere)).alias("cell"))


def _cells(groups: DataFrame) -> DataFrame:
    """(key, node, cell): small groups whole, large ones cut up, with the same pivots everywhere."""
    cells = F.when(F.col("m") <= LEAF, F.lit(1).cast("long")).otherwise(F.ceil(F.col("m") / (LEAF - 4 * PIVOTS)).cast("long"))
    own = F.array(F.pmod(F.xxhash64("node", "key"), cells))
    pivot = F.pmod(F.xxhash64("key", "node", F.lit(1)), F.col("m")) < PIVOTS
    everywhere = F.sequence(F.lit(0).cast("long"), cells - 1)
    return groups.select("key", "node", F.explode(F.when(pivot, everywhere).otherwise(own)).alias("cell"))


def _parts_of(m: str) -> Column:
    """How many parts of half a leaf a group of ``m`` has."""
    return F.ceil(2 * F.col(m) / LEAF).cast("long")


def _grid(groups: DataFrame) -> DataFrame:
    """(key, node, cell): every two parts of half a leaf meet in a cell."""
    parts = _parts_of("m")
    own = F.pmod(F.xxhash64("node", "key"), parts)
    met = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda y: F.least(own, y) * parts + F.greatest(own, y))
    return groups.select("key", "node", F.explode(met).alias("cell"))
