"""Chosen paths and leaves against all pairs of shingle sets."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import chosen_paths, components, leaves, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, width: int) -> frozenset:
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_components(rows, width: int, percent: int = 80) -> list[tuple]:
    """(doc_id, size, component) per row from the definition."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        common: dict[int, int] = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j > i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(docs) -> list[tuple]:
    return sorted(map(tuple, chosen_paths.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def clusters(n: int, seed: int = 1) -> list[tuple[int, str]]:
    """Near copies of a few texts, chains of drift, and texts that share a passage but are not alike."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    bases, passage = [fresh(70) for _ in range(3)], fresh(50)
    rows = []
    for i in range(n):
        words = list(bases[i % 3])
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"v{i}"
        rows.append(words)
    drift = list(fresh(60))
    for i in range(n // 4):
        drift[(7 * i) % 60] = f"d{i}"
        rows.append(list(drift))
    rows += [passage + fresh(12 + i % 9) for i in range(n // 2)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(d, " ".join(rows[i])) for d, i in enumerate(order)]


def test_special_rows(spark, docs, rows, none):
    assert found(docs) == brute_components(rows, 4)
    assert found(none) == []
    assert found(docs.where("text is null")) == [(4, 0, 4)]


@pytest.mark.parametrize("leaf", [leaves.LEAF, 12, 4])
def test_brute_force(spark, monkeypatch, leaf):
    """Also with leaves so small that levels, pivots and the grid have to do it."""
    monkeypatch.setattr(leaves, "LEAF", leaf)
    monkeypatch.setattr(leaves, "PIVOTS", min(leaves.PIVOTS, leaf // 8))
    monkeypatch.setattr(leaves, "STRAGGLERS", min(leaves.STRAGGLERS, leaf // 4))
    rows = clusters(90)
    got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == brute_components(rows, 4)
    assert len({c for _, _, c in got}) > 40


def test_grid_alone_finds_all(spark, monkeypatch):
    """No level to branch on: what is large meets in pairs of cells."""
    monkeypatch.setattr(chosen_paths, "DEPTH", 1)
    monkeypatch.setattr(leaves, "LEAF", 6)
    monkeypatch.setattr(leaves, "PIVOTS", 0)
    monkeypatch.setattr(leaves, "STRAGGLERS", 0)
    rows = clusters(60, 2)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows, 4)


def test_borderline_pairs_are_found():
    """Pairs just above the threshold, by one tree's roots alone, and no pair lost by its tokens."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(2000):
        both = rng.integers(0, 2**63, 82).astype(np.uint64)
        own = rng.integers(0, 2**63, 18).astype(np.uint64)
        a, b = np.sort(np.r_[both, own[:9]]), np.sort(np.r_[both, own[9:]])
        low = chosen_paths.tokens(np.r_[a, b], np.array([0, 91, 182]))
        same = low[0] == low[1]
        assert same.sum() >= chosen_paths.AGREE
        missed += not same[:2].any()
    assert missed < 120  # 1 in 25 for the two branches of a root


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_chosen_path_dedup"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and not all(r.kept for r in got)


def test_forest_connects_the_same():
    rng = np.random.default_rng(6)
    for n in (1, 10, 200):
        a, b = rng.integers(0, 100, n), rng.integers(0, 100, n)
        x, y = components.forest(a, b)
        assert len(x) < 100 and set(map(tuple, np.c_[y, y])) | set(map(tuple, np.c_[x, y])) >= {(i, i) for i in y}

        def groups(p, q):
            label = {i: i for i in range(100)}
            for i, j in zip(p.tolist(), q.tolist(), strict=True):
                u, v = label[i], label[j]
                label = {k: v if w == u else w for k, w in label.items()}
            return {frozenset(k for k in label if label[k] == w) for w in label.values()}

        assert groups(a, b) == groups(x, y)


def test_branches_and_candidates_know_their_component(spark):
    """So neither is joined with all components again."""
    nodes = spark.createDataFrame([(5, list(range(chosen_paths.TOKENS)))], "node long, tokens array<int>")
    members = spark.createDataFrame([(1, 5, 3)], "key long, node long, c long")
    assert [(r.node, r.c) for r in chosen_paths._branch(nodes, members, 1).collect()] == [(5, 3)] * chosen_paths.BRANCHES
    columns = [pa.array([1, 1]), pa.array([0, 0]), pa.array([5, 6]), pa.array([10, 10]), pa.array([5, 6]), pa.array([b"", b""])]
    rows = pa.RecordBatch.from_arrays(columns, ["key", "cell", "node", "n", "c", "sketch"])
    got = next(leaves._candidates(lambda n, sketches: ~np.eye(len(n), dtype=bool), iter([rows])))
    assert got.column("c").to_pylist() == [5, 6]
