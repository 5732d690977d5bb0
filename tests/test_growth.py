"""What grows with the input is made once, and rows that move are small."""

from __future__ import annotations

import datetime

from helpers import GOLDEN, as_set, brute_couples
from pyspark.sql import functions as F

from docweave.operators import groups as G
from docweave.operators import joins as J
from docweave.plans.core_attributes import Core, choose_core, hot_core, key_text
from registry import fixtures, queries

HOUR = datetime.timedelta(hours=1)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def marked(df):
    """The same rows; the plan shows where they are made."""
    return df.where(F.rand(7) >= 0)


def events(spark, folder) -> str:
    start = datetime.datetime(2024, 1, 1)
    kinds = ["view", "click", "error"]
    rows = [(i, start + i * HOUR, i % 9 + (i >= 500) * (i % 4), kinds[i % 3], 1.0, f'{{"k": {i % 6}}}') for i in range(480, 560)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_key_text_tells_values_apart(spark):
    rows = [["1", "1:2"], ["1:1", "2"], ["", "12"], ["12", ""], [None, "1"], ["-", "1"], ["1", None]]
    vals = spark.createDataFrame([(v,) for v in rows], "vals array<string>").withColumns({"s": F.lit(3), "t": F.lit(3)})
    texts = [r[0] for r in vals.select(key_text(2)).collect()]
    assert None not in texts and len(set(texts)) == len(rows)


def test_null_and_odd_values_join_as_before(make_documents):
    rows = [(1, {"a": "1", "b": "1:2"}), (2, {"a": "1:1", "b": "2"}), (3, {"a": "1", "b": "1:2"}), (4, {"a": None}), (5, {"a": None}), (6, {"a": "-"})]
    got = J.natural_join(make_documents(rows), Core(("a", "b"), rest=False, index=False, hot=False))
    assert as_set(got, "a", "b") == {(1, 3), (4, 5)}


def test_copies_in_partitions_carry_smaller_partitions_only(spark, golden):
    routes = spark.createDataFrame([(0, i, p) for i, p in enumerate([[2, 0, 1], [1, 2], [3, 2, 1], [2, 3], [0], []], 1)], "w long, doc long, pids array<int>")
    got = J.natural_join_partitioned(golden, routes)
    assert as_set(got, "w", "a", "b") == {c for c in brute_couples(GOLDEN) if 6 not in c}
    assert "below" in plan(got) and "array_intersect" not in plan(got)


def test_kept_columns_follow_their_documents(make_documents):
    docs = make_documents([(1, {"a": "1"}), (3, {"a": "1", "b": "2"}), (2, {"b": "2"})]).withColumn("x", F.col("doc") * 10)
    got = J.natural_join(docs, keep=("x",))
    assert as_set(got, "a", "b", "x_a", "x_b") == {(1, 3, 10, 30), (2, 3, 20, 30)}


def test_tasks_of_the_join_follow_its_rows(spark, golden, monkeypatch):
    few = as_set(J.natural_join(golden), "a", "b")
    monkeypatch.setattr(J, "TASK", 2)
    core = Core(("a",), emits=21, postings=41)
    many = J.natural_join(golden, core)
    assert choose_core(golden).emits > 0 and hot_core(golden).postings > 0
    assert "hashpartitioning" in plan(many) and ", 11), REPARTITION_BY_NUM" in plan(many) and ", 21), REPARTITION_BY_NUM" in plan(many)
    assert as_set(many, "a", "b") == few


def test_partner_sets_join_once(golden):
    assert "rand(7" not in plan(J.joinable_sets(marked(J.natural_join(golden)), golden, 2))


def test_groups_shred_once(golden):
    assert "rand(7" not in plan(G.association_groups(marked(golden)))


def test_update_builds_one_table(spark, tmp_path, monkeypatch):
    calls, made = [], G.association_groups
    monkeypatch.setattr(queries.G, "association_groups", lambda docs: calls.append(1) or made(docs))
    got = queries.partition_updated_loads(spark, events(spark, tmp_path))
    assert len(calls) == 1 and got.count() > 0


def test_hash_routes_look_nothing_up_per_couple(spark, tmp_path):
    got = queries.routes_hash_complete(spark, events(spark, tmp_path))
    assert "pids_a" in plan(got)
    row = got.first()
    assert row["n_couples"] == row["n_together"] > 0


def test_lines_become_documents_once(spark, tmp_path):
    rows = [(1, 1, 2, 3, "A", "F"), (1, 1, 1, 3, "N", "F"), (2, 1, 2, 4, "R", "O")]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = fixtures.wide_lines(spark, str(tmp_path))
    assert "Aggregate" not in plan(docs)
    assert {r["doc"] for r in docs.collect()} == {11, 21}
