"""One pair, document, source or group of copies holding a third of all rows."""

from __future__ import annotations

import pytest
from helpers import as_set, brute_couples
from pyspark.sql import functions as F

from docweave.operators import groups as G
from docweave.operators import joins as J
from docweave.operators import stats as S
from docweave.operators.positions import with_position
from docweave.operators.windows import count_window, window_counts
from docweave.plans.core_attributes import Core, hot_core

N = 90


@pytest.fixture(scope="module")
def rows():
    """A third are copies of one document; another third share one of its pairs."""
    out = [(0, i, {"a": "hot", "b": "hot"}) for i in range(N // 3)]
    out += [(0, N // 3 + i, {"a": "hot", "c": str(i)}) for i in range(N // 3)]
    out += [(0, 2 * N // 3 + i, {"a": str(i % 5), "c": str(i)}) for i in range(N // 3)]
    return out


@pytest.fixture(scope="module")
def docs(make_documents, rows):
    return make_documents(rows).cache()


@pytest.mark.parametrize("core", [Core(("a", "b", "c"), False, False), Core(("a",)), Core(())])
def test_split_keys_give_every_couple_once(docs, rows, core):
    assert as_set(J.natural_join(docs, core, cell=7), "w", "a", "b") == brute_couples(rows)


def test_split_keys_bound_each_cell(docs):
    """No (key, cell) keeps more than about ``cell`` rows of a side."""
    sides = J._sides(docs, Core(("a",)), ["w"], []).withColumn("key", F.get("vals", F.lit(0)))
    left, right, keys = J._split_hot_keys(sides, sides, ["w", "key"], 10)
    for side in (left, right):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 20
    # Each pair of rows with equal keys meets in exactly one cell.
    met = J._side(left, keys, "a").join(J._side(right, keys, "b"), keys)
    assert met.count() == met.select("doc_a", "doc_b").distinct().count()
    assert met.count() == sides.groupBy("key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]


def test_posting_lists_are_bounded_and_whole(docs):
    lists = S.pair_index(docs, parts=6)
    hot = lists.where("attr = 'a' AND val = 'hot'").collect()
    assert len(hot) > 1 and {r["n_docs"] for r in hot} == {60}
    assert sorted(d for r in hot for d in r["docs"]) == list(range(60))
    assert max(len(r["docs"]) for r in hot) < 30
    by_attr = S.posting_lists(docs, parts=6).where("attr = 'a'").first()
    assert (by_attr["n_occurrences"], by_attr["n_vals"]) == (90, 6)


def test_groups_with_a_hot_pair(docs):
    got = {(r["attr"], r["val"]): (r["g_attr"], r["g_val"], r["n_docs"]) for r in G.association_groups(docs).collect()}
    assert got["a", "hot"] == got["b", "hot"] == ("a", "hot", 60)
    # Each c occurs in one document of the hot group and one of a smaller one.
    assert got["c", "7"] == ("c", "7", 2)


def test_positions_within_a_hot_source(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("src"),
        (F.hash("id")).alias("k"),
        "id",
    )
    placed = with_position(df, ["src"], [F.col("k"), F.col("id")])
    per = placed.groupBy("src").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count_distinct("pos").alias("d"), F.count("*").alias("n")
    )
    assert per.where("lo != 0 OR hi != n - 1 OR d != n").count() == 0
    hot = [r["k"] for r in placed.where("src = 'hot'").orderBy("pos").collect()]
    assert hot == sorted(hot) and len(hot) == 1000


def test_count_windows_and_leftovers(spark):
    df = spark.range(2305).select("id", F.hash("id").alias("k"))
    sizes = {r["w"]: r["n_docs"] for r in window_counts(count_window(df, ["k", "id"], 500)).collect()}
    assert sizes == {0: 500, 1: 500, 2: 500, 3: 500, 4: 305}


def test_index_join_does_not_enumerate_a_frequent_key(make_documents):
    """One attribute is frequent in every value; a rarer one joins the key, and the couples are the same."""
    rows = [(i, {"flag": str(i % 2), "item": str(i % 150)} | ({"order": str(i)} if i % 4 else {})) for i in range(600)]
    docs = make_documents(rows)
    core = hot_core(docs, hot=20)
    assert core.attrs[0] == "flag" and "item" in core.attrs
    assert as_set(J.natural_join_index(docs, frequent=20), "w", "a", "b") == brute_couples(rows)


def test_rows_are_copied_to_shapes_where_they_are_read(make_documents):
    """All documents of a window have one of two shapes: no join on the shape brings half of them into one task."""
    rows = [(i, {"flag": str(i % 3), "item": str(i % 7)} | ({"order": str(i)} if i % 4 else {})) for i in range(90)]
    docs, core = make_documents(rows), Core(("flag", "item", "order"), rest=False, index=False, hot=False)
    sides = J._sides(docs, core, ["w"], [])
    assert J._all_shapes(sides, sides, ["w"]) == [3, 7]
    for side in J._met_shapes(sides, sides, ["w"], True):
        assert "Join" not in side._jdf.queryExecution().executedPlan().toString()
    assert as_set(J.natural_join(docs, core), "w", "a", "b") == brute_couples(rows)


def test_windows_of_different_shapes_meet_their_own_only(make_documents):
    rows = [(w, 10 * w + i, {"a": "1", f"own{w}": str(i % 2)}) for w in range(8) for i in range(4)]
    docs = make_documents(rows)
    core = Core(("a", *[f"own{w}" for w in range(8)]), rest=False, index=False, hot=False)
    sides = J._sides(docs, core, ["w"], [])
    assert J._all_shapes(sides, sides, ["w"]) is None
    assert as_set(J.natural_join(docs, core), "w", "a", "b") == brute_couples(rows)
