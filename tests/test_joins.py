"""Every strategy gives the couples of the definition."""

from __future__ import annotations

import random

import pytest
from helpers import as_set, brute_couples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import values as V
from docweave.operators import joins as J
from docweave.operators.routing import route
from docweave.plans.core_attributes import Core, choose_core, hot_core, universal_core
from docweave.plans.partitioning import Options, build_table

ATTRS = ["a", "b", "c", "d", "e", "f", "g"]
WINDOW = st.lists(st.dictionaries(st.sampled_from(ATTRS), st.sampled_from("xyz"), max_size=5), max_size=9)


def rows_of(windows) -> list:
    return [(w, 100 * w + i, m) for w, docs in enumerate(windows) for i, m in enumerate(docs)]


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WINDOW, min_size=15, max_size=30))
def test_every_core_gives_the_definition(make_documents, windows):
    rows = rows_of(windows)
    docs, want = make_documents(rows), brute_couples(rows)
    cores = [
        Core(()),
        Core(("a", "b")),
        Core(("g", "zzz")),
        Core(tuple(ATTRS), rest=False, index=False),
        Core(tuple(ATTRS), rest=False, index=False, hot=False),
    ]
    for core in cores:
        assert as_set(J.natural_join(docs, core, cell=2), "w", "a", "b") == want, core


@pytest.fixture(scope="module")
def random_rows():
    rnd = random.Random(7)
    windows = [
        [{a: rnd.choice("xyz") for a in rnd.sample(ATTRS, rnd.randint(0, 4))} for _ in range(60)] for _ in range(4)
    ]
    for m in windows[0]:  # one window with a universal attribute
        m["a"] = rnd.choice("xyz")
    return rows_of(windows)


@pytest.fixture(scope="module")
def random_docs(make_documents, random_rows):
    return make_documents(random_rows).cache()


@pytest.fixture(scope="module")
def want(random_rows):
    return brute_couples(random_rows)


def test_strategies_agree(random_docs, want):
    for join in (
        lambda d: J.natural_join(d),
        lambda d: J.natural_join(d, max_core=3, cell=4),
        lambda d: J.natural_join_index(d),
        lambda d: J.natural_join_index(d, frequent=5, cell=3),
        lambda d: J.natural_join_universal(d),
    ):
        assert as_set(join(random_docs), "w", "a", "b") == want


def test_shared_counts(random_docs, random_rows, want):
    maps = {d: m for _, d, m in random_rows}
    got = J.natural_join(random_docs, Core(("a", "b")), shared=True).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["n_shared"] == len(maps[r["a"]].items() & maps[r["b"]].items())


@pytest.mark.parametrize(("k", "unseen"), [(1, "broadcast"), (8, "broadcast"), (2, "hash"), (8, "hash")])
def test_partitioned_join(random_docs, want, k, unseen):
    options = Options(k=k, shards=3)
    routes = route(random_docs, build_table(random_docs, options), k, unseen)
    got = J.natural_join_partitioned(random_docs, routes, Core(("a", "b", "c")))
    assert as_set(got, "w", "a", "b") == want


def test_invariance(make_documents, random_rows, want):
    """Order of documents and pairs does not matter, nor an attribute nobody shares."""
    rnd = random.Random(3)
    changed = []
    for w, d, m in random_rows:
        items = list(m.items())
        rnd.shuffle(items)
        # An attribute of one document only; documents without pairs stay without.
        changed.append((w, d, dict(items) | ({f"own{d}": "1"} if items else {})))
    rnd.shuffle(changed)
    assert as_set(J.natural_join(make_documents(changed)), "w", "a", "b") == want


def test_wide_schema_uses_part_of_the_attributes(make_documents):
    """Many sparse attributes: a bounded core, the rest through the index."""
    rnd = random.Random(11)
    rows = [
        (0, i, {"kind": rnd.choice("pq")} | {f"s{rnd.randint(0, 40)}": rnd.choice("xy") for _ in range(4)})
        for i in range(150)
    ]
    docs = make_documents(rows)
    core = choose_core(docs, max_core=4)
    assert core.rest and len(core.attrs) <= 4 and not core.index  # 'kind' is in every document
    assert as_set(J.natural_join(docs, core), "w", "a", "b") == brute_couples(rows)
    rows = [(w, d, {k: v for k, v in m.items() if k != "kind"}) for w, d, m in rows]
    assert as_set(J.natural_join(make_documents(rows), max_core=4), "w", "a", "b") == brute_couples(rows)


def test_cores(golden):
    assert choose_core(golden) == Core(("a", "b", "c", "d"), rest=False, index=False, hot=False)
    assert hot_core(golden, hot=2).attrs == ("b",)
    assert universal_core(golden).attrs == ()


def test_string_ids_and_windows_are_separate(make_documents):
    rows = [(0, "x", {"a": "1"}), (1, "y", {"a": "1"}), (1, "z", {"a": "1"})]
    assert as_set(J.natural_join(make_documents(rows, "string")), "w", "a", "b") == {(1, "y", "z")}


def test_no_documents(make_documents):
    docs = make_documents([])
    for join in (J.natural_join, J.natural_join_index, J.natural_join_universal):
        assert join(docs).count() == 0
    assert J.joinable_sets(J.natural_join(docs), docs).count() == 0


def test_probe(make_documents, random_docs, random_rows, want):
    probe = random_docs.where("doc % 7 = 0")
    both = want | {(w, b, a) for w, a, b in want}
    got = as_set(J.joinable_with(probe, random_docs), "w", "doc", "partner")
    assert got == {(w, a, b) for w, a, b in both if a % 7 == 0}


def test_partner_lists_split_but_stay_whole(random_docs, want):
    sets = J.joinable_sets(J.natural_join(random_docs), random_docs, parts=3).collect()
    assert max(r["part"] for r in sets) == 2
    got = {}
    for r in sets:
        got.setdefault((r["w"], r["doc"]), []).extend(r["partners"])
    assert len(got) == 240  # every document, with or without partners
    assert all(len(p) == len(set(p)) for p in got.values())
    assert {(w, d, p) for (w, d), ps in got.items() for p in ps if d < p} == want


def test_predicates(make_documents, random_rows):
    x = make_documents(random_rows[:60]).withColumnRenamed("m", "x")
    y = make_documents([(w, d - 1, m) for w, d, m in random_rows[:60]]).withColumnRenamed("m", "y")
    cx, cy = F.col("x"), F.col("y")
    for r in x.join(y, ["w", "doc"]).select(
        "x", "y", V.shares(cx, cy).alias("s"), V.conflicts(cx, cy).alias("c"), F.size(V.pair_overlap(cx, cy)).alias("n")
    ).collect():
        common = r["x"].keys() & r["y"].keys()
        assert r["s"] == bool(r["x"].items() & r["y"].items())
        assert r["c"] == any(r["x"][k] != r["y"][k] for k in common)
        assert r["n"] == len(r["x"].items() & r["y"].items())
