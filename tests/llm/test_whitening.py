"""Whitening against exact integers and a library's eigenvectors."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from docweave.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, n long, d int, x string, component int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], KIND).repartition(3)


def scaled(v) -> list[int]:
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check(got, rows, most=32):
    """Every figure of a result from its definition."""
    fit = [(i, scaled(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(fit), len(fit[0][1])
    x = np.array([v for _, v in fit], dtype=object)
    s = x.sum(0)
    deviations = defaultdict(list)
    for i, v in fit:
        deviations[i].append(sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)))
    c = (n * x - s).astype(float) / n
    cov = c.T @ c / n
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1].T
    k = min(most, d)
    assert len(got) == n * k
    rowwise = defaultdict(list)
    for r in got:
        assert r.n == n and r.deviation in deviations[r.vec_id]
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) <= 1e-9 * r.explained
        assert r.identity_error <= 1e-9
        rowwise[r.component].append(r)
    assert sorted(rowwise) == list(range(1, k + 1))
    gaps = np.abs(np.diff(values)) > 1e-6 * values[0]
    for j in range(1, k + 1):
        if (j == 1 or gaps[j - 2]) and (j == d or gaps[j - 1]):  # only where the direction is determined
            want = sorted((c @ vectors_[j - 1] / np.sqrt(values[j - 1])).tolist())
            have = sorted(r.whitened for r in rowwise[j])
            flipped = sorted(-w for w in want)
            assert np.allclose(have, want, atol=1e-7) or np.allclose(have, flipped, atol=1e-7)
    whitened = np.array([[r.whitened for r in sorted(rowwise[j], key=lambda r: (r.vec_id or 0, r.deviation))] for j in rowwise])
    if len({i for i, _ in fit}) == n:
        assert np.abs(whitened @ whitened.T / n - np.eye(k)).max() < 1e-8


def test_against_definition(spark):
    rng = np.random.default_rng(1)
    basis = rng.standard_normal((40, 40)) * np.linspace(3, 0.2, 40)[:, None]
    rows = [(i, [float(v) for v in rng.standard_normal(40) @ basis]) for i in range(300)]
    bad = [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [1.0] * 39 + [float("inf")])]
    check(whitening.whiten(vectors(spark, rows + bad)).collect(), rows)


def test_ties_repeats_and_null_ids(spark):
    """Equal eigenvalues: any basis of their space, but orthonormal; repeated rows count twice."""
    axes = [(i, [(4.0 if i % 12 == 2 * j else -4.0 if i % 12 == 2 * j + 1 else 0.0) for j in range(6)]) for i in range(48)]
    check(whitening.whiten(vectors(spark, axes)).collect(), axes)
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(5)]) for i in range(20)]
    twice = [*rows, *rows[:7], *rows[:7], (None, rows[3][1])]
    check(whitening.whiten(vectors(spark, twice)).collect(), twice)


def test_no_variance_other_lengths_and_large_entries(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {
        (i, j, 2, 0, None, 0.0, 0.0) for i in (1, 2) for j in (1, 2)
    }
    rng = np.random.default_rng(3)
    long, short = ([(i + 100 * d, [float(v) for v in rng.standard_normal(d)]) for i in range(30)] for d in (7, 3))
    got = whitening.whiten(vectors(spark, [*long, *short, (9, [])])).collect()
    check([r for r in got if r.vec_id >= 700], long)
    check([r for r in got if 300 <= r.vec_id < 400], short)
    assert len(got) == 30 * 7 + 30 * 3
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one direction only
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in got)
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1.0, -1.0])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id != 3} == {None}


def test_empty(spark):
    assert whitening.whiten(vectors(spark, [(1, None)]).where("false")).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("kind", ["random", "diagonal", "clustered", "one", "two"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    values = {"random": rng.random(64) * 10, "clustered": np.r_[[5.0] * 20, 5.0 + 1e-9 * rng.random(20), rng.random(24)]}
    v = {
        "diagonal": np.diag(np.arange(64.0)), "one": np.array([[3.0]]), "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
    }.get(kind)
    v = q * values[kind] @ q.T if v is None else v
    v = (v + v.T) / 2
    k = min(32, len(v))
    got, vectors_ = whitening.leading_components(v, k)
    assert np.allclose(got, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-12 * got[0])
    assert np.abs(vectors_ @ vectors_.T - np.eye(k)).max() < 1e-10
    assert np.abs(vectors_ @ v - got[:, None] * vectors_).max() < 1e-9 * got[0]


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op12_embedding_whitening"](spark, sf).collect(), rows)
