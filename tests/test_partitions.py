"""Groups, packing, tables, updates and drift against step-by-step versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import as_set, joinable
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.operators import expansion as E
from docweave.operators import groups as G
from docweave.operators import partitions as PT
from docweave.operators import quality as Q
from docweave.operators import routing as R
from docweave.operators import stats as S
from docweave.plans.partitioning import Options, TableState, build_table, repartition_plan, serve_windows, with_expansion


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.integers(1, 60), min_size=1, max_size=9),
    st.lists(st.tuples(st.integers(1, 40), st.integers(1, 50)), max_size=8),
)
def test_runs_equal_one_by_one_packing(loads, runs):
    """The closed form of a run against giving its items out one at a time."""
    fast, slow = np.array(loads, dtype=np.int64), list(loads)
    for size, count in sorted(runs, reverse=True):
        segs = PT._run_segments(fast, size, count)
        for j in range(count):
            least = min(slow)
            pid = max(p for p, v in enumerate(slow) if v == least)
            slow[pid] += size
            seg = [s for s in segs if s["from"] <= j][-1]
            assert seg["pids"][(j - seg["from"]) % len(seg["pids"])] == pid
        assert list(fast) == slow


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for w in range(3):
        for i in range(50):
            m = {a: str(rnd.randint(0, n)) for a, n in (("a", 1), ("b", 3), ("c", 9), ("d", 40)) if rnd.random() < 0.7}
            out.append((w, 100 * w + i, m))
    return out


@pytest.fixture(scope="module")
def docs(make_documents, rows):
    return make_documents(rows).cache()


def slow_groups(rows, w):
    """Visit groups largest first; each absorbs the smaller ones it contains."""
    carriers: dict = {}
    for ww, d, m in rows:
        if ww == w:
            for p in m.items():
                carriers.setdefault(p, set()).add(d)
    sets: dict = {}
    for p, ds in carriers.items():
        sets.setdefault(frozenset(ds), []).append(p)
    order = sorted(((ds, sorted(ps)) for ds, ps in sets.items()), key=lambda g: (-len(g[0]), g[1][0]))
    found = []
    while order:
        ds, ps = order.pop(0)
        inside = [g for g in order if g[0] < ds]
        order = [g for g in order if not g[0] < ds]
        found.append((len(ds), ps[0], frozenset(ps) | {p for g in inside for p in g[1]}))
    return found


def test_association_groups(docs, rows):
    got: dict = {}
    for r in G.association_groups(docs).collect():
        got.setdefault((r["w"], r["n_docs"], (r["g_attr"], r["g_val"])), set()).add((r["attr"], r["val"]))
    want = {(w, n, name): set(ps) for w in range(3) for n, name, ps in slow_groups(rows, w)}
    assert got == want


def test_each_pair_in_one_group(docs):
    pairs = S.pair_counts(docs).count()
    got = G.association_groups(docs)
    assert got.count() == got.select("w", "attr", "val").distinct().count() == pairs


def test_local_groups_by_hash_cover_all_pairs(docs):
    local = G.local_association_groups(docs, 4)
    assert local.select("w", "attr", "val").distinct().count() == S.pair_counts(docs).count()
    merged = G.regroup_global(G.dedupe_group_pairs(local), docs)
    assert merged.count() == S.pair_counts(docs).count()


@pytest.mark.parametrize("load", ["additive", "snake"])
def test_tables_own_every_pair_and_routes_are_complete(docs, rows, load):
    table = build_table(docs, Options(k=4, load=load))
    assert table.count() == S.pair_counts(docs).count()
    pids = {r["doc"]: set(r["pids"]) for r in R.route(docs, table, 4).collect()}
    for w, a, x in rows:
        for v, b, y in rows:
            if w == v and a < b and joinable(x, y):
                assert pids[a] & pids[b]


def test_unseen_pairs_go_everywhere_or_by_hash(docs):
    table = build_table(docs.where("doc % 100 < 20"), Options(k=4))
    everywhere = R.route(docs, table, 4)
    unseen = R.unseen_counts(docs, table, threshold=2)
    carriers = docs.join(R.update_candidates(docs, unseen.withColumn("candidate", F.lit(True))), ["w", "doc"], "left_semi")
    some = everywhere.join(carriers.select("w", "doc"), ["w", "doc"])
    assert some.count() > 0 and some.where(F.size("pids") != 4).count() == 0
    by_hash = R.route(docs, table, 4, "hash")
    assert by_hash.agg(F.sum(F.size("pids"))).first()[0] < everywhere.agg(F.sum(F.size("pids"))).first()[0]
    with pytest.raises(ValueError):
        R.route(docs, table, 4, "drop")


def test_updates_prefer_overlap_then_load_then_id(make_documents, spark):
    table = spark.createDataFrame(
        [(0, "a", "1", 0), (0, "b", "1", 1), (0, "c", "1", 1), (0, "d", "1", 2)], "w long, attr string, val string, pid int"
    )
    loads = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (0, 2, 5)], "w long, pid int, n_docs long")
    new = make_documents([
        (1, {"a": "1", "b": "1", "c": "1", "n": "1"}),  # overlap 2 in partition 1 wins despite its load
        (2, {"a": "1", "d": "1", "n": "2"}),  # equal overlap and load: lowest id
        (3, {"b": "1", "d": "1", "n": "3"}),  # equal overlap: least load
        (4, {"x": "1"}),  # nothing in common: least loaded
    ])
    assert as_set(PT.choose_partition(table, new, loads), "doc", "pid", "overlap") == {
        (1, 1, 2), (2, 0, 1), (3, 2, 1), (4, 0, 0),
    }
    grown, counted = PT.update_partitions(table, new, loads)
    assert as_set(counted, "pid", "n_docs") == {(0, 7), (1, 10), (2, 6)}
    assert ("a", "1", 1) in as_set(grown, "attr", "val", "pid")
    assert as_set(PT.least_loaded(counted), "pid", "n_docs") == {(2, 6)}


def test_least_loaded_ties_go_to_the_highest_id(spark):
    loads = spark.createDataFrame([(0, 0, 5), (0, 1, 9), (0, 2, 5)], "w long, pid int, n_docs long")
    assert as_set(PT.least_loaded(loads), "pid") == {(2,)}


def test_quality_flags_are_strict(spark):
    schema = "w long, n_docs long, max_load long, avg_comm double"
    base = spark.createDataFrame([(1, 10, 5, 2.0), (2, 10, 5, 2.0), (3, 10, 5, 2.0), (4, 10, 0, 0.0)], schema)
    now = spark.createDataFrame([(1, 20, 12, 2.4), (2, 10, 6, 3.0), (3, 10, 7, 3.0), (4, 10, 5, 2.0)], schema)
    got = Q.repartition_cause(Q.quality_check(base, now))
    # 20 % exactly is no flag; load is per document; a zero base gives none.
    assert as_set(got, "w", "cause") == {(1, "none"), (2, "communication"), (3, "load"), (4, "none")}
    assert as_set(Q.repartition_counts(got), "cause", "n_windows") == {("none", 2), ("communication", 1), ("load", 1)}


def test_expansion_keeps_routing_complete(docs, rows):
    options = Options(k=3, expansion=True)
    wide = with_expansion(docs, options)
    assert wide.where("composite IS NOT NULL").count() > 0 and wide.where("route_all").count() > 0
    routes = R.route(wide, build_table(wide, options), 3, composite_only=True)
    pids = {r["doc"]: set(r["pids"]) for r in routes.collect()}
    for w, a, x in rows:
        for v, b, y in rows:
            if w == v and a < b and joinable(x, y):
                assert pids[a] & pids[b]


def test_composite_pairs_are_not_update_candidates(docs, spark):
    wide = with_expansion(docs, Options(k=3, expansion=True))
    empty = spark.createDataFrame([], "w long, attr string, val string, pid int")
    assert R.unseen_counts(wide, empty).where("attr LIKE '[%'").count() == 0


def test_expansion_takes_all_when_values_never_suffice(golden):
    chosen = E.choose_expansion(S.rank_attrs(S.attr_stats(golden)), 100)
    assert {r["attr"] for r in chosen.collect()} == {"a", "b", "c", "d"}


def test_plan_rebuilds_after_drift(make_documents):
    """Windows 0 and 1 look alike; window 2 brings other pairs, so window 3 gets a new table."""
    def window(w, tag):
        return [(w, 100 * w + i, {"g": f"{tag}{i % 4}", "u": f"{tag}{i % 8}"}) for i in range(40)]

    docs = make_documents(window(0, "p") + window(1, "p") + window(2, "q") + window(3, "q"))
    got = {r["w"]: r for r in repartition_plan(docs, Options(k=4)).collect()}
    assert [got[w]["version"] for w in range(4)] == [1, 1, 1, 2]
    assert [got[w]["rebuilt"] for w in range(4)] == [True, False, False, True]
    assert [got[w]["cause"] for w in range(4)] == ["none", "none", "load", "none"]


def test_plan_adds_recurring_unseen_pairs(make_documents):
    """A little drift stays under the limit; the new pairs are in the table one window later."""
    base = [{"g": str(i % 4)} for i in range(40)]
    fresh = base + [{"n": "new"}] * 3
    rows = [(w, 100 * w + i, m) for w, ms in enumerate([base, fresh, fresh]) for i, m in enumerate(ms)]
    got = {r["w"]: r for r in repartition_plan(make_documents(rows), Options(k=4, comm=1.0, load_limit=1.0)).collect()}
    assert [got[w]["version"] for w in range(3)] == [1, 1, 1]
    assert got[1]["avg_comm"] > 1.0 and got[2]["avg_comm"] == 1.0


def drifting(n: int) -> list:
    """Windows whose pairs change now and then, and bring new ones in between."""
    rows = []
    for w in range(n):
        tag, extra = "pqr"[w // 2 % 3], [{"n": f"new{w}"}] * (3 if w == 1 else 0)
        ms = [{"g": f"{tag}{i % 4}", "u": f"{tag}{i % 8}"} for i in range(24)] + extra
        rows += [(w, 100 * w + i, m) for i, m in enumerate(ms)]
    return rows


@pytest.mark.parametrize("options", [Options(k=4), Options(k=3, expansion=True, load="snake")])
def test_windows_in_common_jobs_equal_one_after_another(spark, make_documents, options):
    """However windows are cut into batches, each is served as if it came alone."""
    docs = make_documents(drifting(5))
    got = {}
    for cut in (1, 5):
        state, rows, routes = TableState(), [], set()
        for at in range(0, 5, cut):
            batch = docs.where(F.col("w").between(at, at + cut - 1))
            state, there, more = serve_windows(state, batch, options)
            rows += more
            routes |= {(r["w"], r["doc"], tuple(r["pids"])) for r in there.collect()}
        got[cut] = (rows, routes)
    assert got[1] == got[5]
    assert [r[0] for r in got[5][0]] == list(range(5))
    assert len({r[1] for r in got[5][0]}) > 1 and {r[6] for r in got[5][0]} != {"none"}


def test_jobs_do_not_grow_with_windows(spark, make_documents):
    """No change after the first table: as many jobs for twelve windows as for four."""
    jobs = {}
    for n in (4, 12):
        rows = [(w, 100 * w + i, {"g": str(i % 4)}) for w in range(n) for i in range(12)]
        spark.sparkContext.setJobGroup(f"serve-{n}", "")
        state, routes, plan = serve_windows(TableState(), make_documents(rows), Options(k=4))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"serve-{n}"))
        assert len(plan) == n and state.version == 1
    spark.sparkContext.setJobGroup("", "")
    assert jobs[4] and jobs[12] <= jobs[4] + 2


def test_runs_side_by_side_equal_one_after_another(make_documents):
    """Frequent rebuilds, and tables that grow before they are given up: the same as windows that come alone."""
    rows = []
    for w in range(9):
        tag, extra = "pq"[w // 3 % 2] + str(w // 3), [{"n": f"new{w}"}] * (3 if w % 3 == 1 else 0)
        rows += [(w, 100 * w + i, m) for i, m in enumerate([{"g": f"{tag}{i % 4}"} for i in range(24)] + extra)]
    docs, got = make_documents(rows), {}
    for cut in (1, 9):
        state, plan, routes = TableState(), [], set()
        for at in range(0, 9, cut):
            state, there, more = serve_windows(state, docs.where(F.col("w").between(at, at + cut - 1)), Options(k=4))
            plan += more
            routes |= {(r["w"], r["doc"], tuple(r["pids"])) for r in there.collect()}
        got[cut] = (plan, routes, state.version, state.rebuild, as_set(state.table, "attr", "val", "pid"))
    assert got[1] == got[9] and got[9][2] > 2


def test_jobs_do_not_grow_with_rebuilds(spark, make_documents):
    """Every second window fails its check: as many jobs for twelve windows as for six."""
    jobs = {}
    for n in (6, 12):
        rows = [(w, 100 * w + i, {"g": f"{w // 2}-{i % 4}", "u": f"{w}-{i % 8}"}) for w in range(n) for i in range(16)]
        spark.sparkContext.setJobGroup(f"rebuild-{n}", "")
        state, _, plan = serve_windows(TableState(), make_documents(rows), Options(k=4, update=False))
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rebuild-{n}"))
        assert len(plan) == n and state.version >= n // 2
    spark.sparkContext.setJobGroup("", "")
    assert jobs[12] <= jobs[6] + 2
