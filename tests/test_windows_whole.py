"""Small windows go whole to tasks: a document is sent once, and its copies meet there."""

from __future__ import annotations

import pytest
from helpers import as_set, brute_couples

from docweave.operators import joins as J
from docweave.operators.routing import route
from docweave.plans.core_attributes import Core, choose_core, hot_core
from docweave.plans.partitioning import Options, build_table

ROWS = [
    (w, 100 * w + i, {"a": str(i % 3), "b": str(i % 4)} | ({"c": str(i % 5)} if i % 2 else {}) | ({f"own{w}": str(i % 2)} if i % 3 else {}))
    for w in range(6)
    for i in range(16)
]
EMPTY = [(0, 90, {}), (5, 590, {})]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(make_documents):
    return make_documents(ROWS + EMPTY).cache()


def whole(core: Core) -> Core:
    return Core(core.attrs, core.rest, core.index, hot=False, emits=core.emits, postings=core.postings, window=17)


def test_largest_window_is_counted(docs):
    assert choose_core(docs).window == 16 and not choose_core(docs).hot


@pytest.mark.parametrize("core", [Core(("a", "b", "c")), Core(("a",)), Core(()), Core(("c", "own1", "own2"))])
def test_couples_of_whole_windows(docs, core):
    got = J.natural_join(docs, whole(core), shared=True)
    assert as_set(got, "w", "a", "b") == brute_couples(ROWS)
    assert as_set(got, "w", "a", "b", "n_shared") == as_set(J.natural_join(docs, core, shared=True), "w", "a", "b", "n_shared")


@pytest.mark.parametrize("core", [Core(("a", "b", "c")), Core(("a",)), Core(())])
def test_two_sides_of_whole_windows(docs, core):
    left, right = docs.where("doc % 3 = 0"), docs.where("doc % 3 != 0")
    cols = ["w", "doc_a", "doc_b", "n_shared"]
    assert as_set(J.couples(left, right, whole(core)), *cols) == as_set(J.couples(left, right, core), *cols)


@pytest.mark.parametrize("core", [Core(("a", "b")), Core(("a",)), Core(())])
def test_null_windows_and_values_and_repeated_ids(make_documents, core):
    rows = [(0, 1, {"a": None, "b": "1"}), (0, 2, {"a": None}), (0, 3, {"a": "-"}), (0, 1, {"b": "1"}), (0, None, {"b": "1"})]
    docs = make_documents(rows + [(None, 4, {"a": "1"}), (None, 5, {"a": "1"})])
    cols = ["w", "doc_a", "doc_b", "n_shared"]
    got, want = (sorted(map(str, J.couples(docs, None, c).select(*cols).collect())) for c in (whole(core), core))
    assert got == want


def test_partitioned_join_sends_each_copy_once(docs):
    routes = route(docs, build_table(docs, Options(k=3)), 3)
    got = J.natural_join_partitioned(docs, routes)
    text = plan(got)
    assert "SortMergeJoin" not in text
    sent = [x for x in text.splitlines() if "Exchange" in x]
    assert len(sent) <= 2 and all("hashpartitioning(w#" in x and "key#" not in x for x in sent)
    assert as_set(got, "w", "a", "b") == brute_couples(ROWS)


def test_large_windows_are_spread_by_key(docs):
    """A window of more documents than a cell holds does not go to one task."""
    core = choose_core(docs, hot=4)
    assert core.window == 16 and core.hot
    got = J.natural_join(docs, core, cell=4)
    assert "key#" in plan(got) and "SortMergeJoin" in plan(got)
    assert as_set(got, "w", "a", "b") == brute_couples(ROWS)
    assert hot_core(docs).window == 0 and J.joinable_with(docs, docs).count() == 2 * len(brute_couples(ROWS))


def test_pairs_that_are_not_hot_need_no_cells(make_documents):
    """A frequent attribute whose pairs are rare: no cells, and both sides of the index are sent once."""
    rows = [(i, {c: str(i % 29) for c in "abcdefg" if i % (ord(c) - 90)}) for i in range(120)]
    docs = make_documents(rows)
    core = choose_core(docs, hot=40)
    assert core.window == 119 and not core.hot and choose_core(docs, hot=4).hot
    assert as_set(J.natural_join(docs, core, cell=40), "w", "a", "b") == brute_couples(rows)


def test_hot_keys_are_met_without_moving_all_rows(docs):
    sides = J._sides(docs, Core(("a",)), ["w"], [])
    left, right, _ = J._split_hot_keys(sides, sides, ["w", "mask"], 10)
    for side in (left, right):
        assert "SortMergeJoin" not in plan(side) and "BroadcastHashJoin" in plan(side)
