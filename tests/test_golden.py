"""Six documents with every intermediate result worked out by hand."""

from __future__ import annotations

from helpers import as_set
from pyspark.sql import functions as F

from docweave.operators import expansion as E
from docweave.operators import groups as G
from docweave.operators import joins as J
from docweave.operators import partitions as PT
from docweave.operators import stats as S
from docweave.operators.routing import route, routing_stats

COUPLES = {(1, 2), (1, 4), (2, 4), (3, 4)}
GROUPS = {("b", "2"): {("a", "2"), ("b", "2")}, ("a", "1"): {("a", "1")}, ("c", "3"): {("c", "3")}, ("d", "9"): {("d", "9")}}


def test_couples_by_every_strategy(golden):
    for join in (J.natural_join, J.natural_join_index, J.natural_join_universal):
        assert as_set(join(golden), "a", "b") == COUPLES


def test_partner_sets(golden):
    sets = J.joinable_sets(J.natural_join(golden), golden)
    assert {r["doc"]: r["partners"] for r in sets.collect()} == {
        1: [2, 4], 2: [1, 4], 3: [4], 4: [1, 2, 3], 5: [], 6: [],
    }


def test_attribute_order_and_universal(golden):
    ranked = S.rank_attrs(S.attr_stats(golden)).orderBy("rank").collect()
    assert [(r["attr"], r["n_docs"], r["n_vals"]) for r in ranked] == [
        ("b", 3, 1), ("a", 3, 2), ("c", 2, 1), ("d", 1, 1),
    ]
    assert S.universal_attrs(golden).count() == 0


def test_expansion(golden):
    lists = E.expansion_attrs(E.choose_expansion(S.rank_attrs(S.attr_stats(golden)), 3))
    assert lists.first()["attrs"] == ["b", "a"]
    wide = {r["doc"]: r for r in E.expand(golden, lists).collect()}
    assert wide[1]["m"] == {'["b","a"]': '["2","1"]'} and not wide[1]["route_all"]
    assert wide[3]["m"] == {'["b","a"]': '["2","2"]'}
    assert wide[2]["m"] == {"a": "1", "c": "3"} and wide[2]["route_all"]
    back = E.contract(E.expand(golden, lists), lists)
    assert {r["doc"]: r["m"] for r in back.collect()} == {r["doc"]: r["m"] for r in golden.collect()}


def test_groups(golden):
    eq = G.equivalence_groups(golden).collect()
    assert {(r["attr"], r["n_docs"]) for r in eq} == {("b", 3), ("a", 2), ("a", 1), ("c", 2), ("d", 1)}
    found: dict = {}
    for r in G.association_groups(golden).collect():
        found.setdefault((r["g_attr"], r["g_val"]), set()).add((r["attr"], r["val"]))
    # Groups are named by the absorber's first pair.
    assert found == GROUPS


def test_partitions_route_and_measure(golden, make_documents):
    rows = [("b", "2", 0), ("a", "2", 0), ("a", "1", 1), ("c", "3", 1), ("d", "9", 1)]
    table = golden.sparkSession.createDataFrame([(0, *r) for r in rows], "w long, attr string, val string, pid int")
    routes = route(golden, table, 2)
    assert {r["doc"]: r["pids"] for r in routes.collect()} == {1: [0, 1], 2: [1], 3: [0], 4: [0, 1], 5: [1]}
    q = PT.partition_quality(routes).first()
    assert (q["n_docs"], q["max_load"], q["avg_comm"]) == (5, 4, 1.4)
    s = routing_stats(routes).first()
    assert (s["copies"], s["min_copies"], s["max_copies"]) == (7, 1, 2)


def test_idle_partitions_have_load_zero(golden, make_documents):
    table = golden.sparkSession.createDataFrame(
        [(0, "a", "1", 0), (0, "z", "1", 1)], "w long, attr string, val string, pid int"
    )
    loads = PT.partition_loads(route(make_documents([(1, {"a": "1"}), (2, {"a": "1"})]), table, 2), table)
    assert as_set(loads, "pid", "n_docs") == {(0, 2), (1, 0)}
    assert PT.least_loaded(loads).first()["pid"] == 1
    new = make_documents([(3, {"z": "1"}), (4, {"q": "1"})])
    assert as_set(PT.choose_partition(table, new, loads), "doc", "pid") == {(3, 1), (4, 1)}
    assert as_set(PT.update_partitions(table, new, loads)[1], "pid", "n_docs") == {(0, 2), (1, 2)}


def test_csv_has_none_only_for_documents_without_partners(golden):
    from docweave.sources.sinks import joinable_lines

    lines = joinable_lines(J.joinable_sets(J.natural_join(golden), golden, parts=3)).collect()
    none = [r["DocumentID"] for r in lines if r["JoinableDocuments"] == "None"]
    assert sorted(none) == ["5", "6"]
    assert not {r["DocumentID"] for r in lines if r["JoinableDocuments"] != "None"} & set(none)


def test_partitions_with_additive_load(golden):
    """Sizes 3, 2, 2, 1: the last group finds loads 3 and 4."""
    groups = G.association_groups(golden)
    got = {r["g_attr"]: r["pid"] for r in PT.assign_partitions(groups, 2).collect()}
    assert got == {"b": 0, "a": 1, "c": 1, "d": 0}


def test_fewer_groups_than_partitions(golden):
    groups = G.association_groups(golden)
    for load in ("additive", "snake"):
        got = PT.assign_partitions(groups, 9, load)
        assert sorted(r["pid"] for r in got.collect()) == [0, 1, 2, 3]


def test_merged_documents(golden):
    merged = J.merged_documents(J.natural_join(golden), golden)
    assert {(r["a"], r["b"]): r["m"] for r in merged.collect()}[(1, 4)] == {"a": "1", "b": "2", "c": "3"}


def test_joinable_with_probe(golden, make_documents):
    probe = make_documents([(100, {"b": "2", "unheard": "x"}), (101, {"unheard": "x"})])
    assert as_set(J.joinable_with(probe, golden), "doc", "partner") == {(100, 1), (100, 3), (100, 4)}


def test_top_groups_and_posting_lists(golden):
    top = G.top_k_groups(G.association_groups(golden), 2).orderBy("rank").collect()
    assert [(r["g_attr"], r["n_docs"]) for r in top] == [("b", 3), ("a", 2)]
    lists = S.pair_index(golden).where("attr = 'b'").first()
    assert (lists["n_docs"], lists["docs"]) == (3, [1, 3, 4])
    pairs = S.sorted_pairs(golden).where("doc = 1").first()["pairs"]
    assert [(p["rank"], p["attr"]) for p in pairs] == [(1, "b"), (2, "a")]
    assert S.approx_attr_stats(golden).where(F.col("attr") == "a").first()["n_vals"] == 2
