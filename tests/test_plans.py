"""What the physical plans must and must not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docweave.operators import joins as J
from docweave.operators import stats as S
from docweave.operators.groups import top_k_groups
from docweave.operators.pairs import shred
from docweave.plans.core_attributes import Core
from registry.fixtures import mixed_events
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
CORE = Core(("event_type", "user", "grp", "k"), rest=False, index=False, hot=False)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "attr_profile", "attr_universal", "doc_sorted_pairs", "eq_groups", "expanded_pairs", "expansion_plan",
        "join_exact", "join_index", "join_merged", "join_partitioned", "join_probe", "join_sets", "join_turns",
        "join_universal", "pair_postings", "routes",
    ],
)
def test_no_nested_loops_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_shredding_needs_no_shuffle_and_reads_what_it_uses(spark):
    text = plan(shred(mixed_events(spark, SF)))
    assert "Exchange" not in text
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in text


def test_window_filter_reaches_the_scan(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(shred(mixed_events(spark, SF).where("doc < 100")))
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in text
    assert events.count() == 1000


def test_pair_counts_combine_before_the_shuffle(spark):
    text = plan(S.attr_stats(mixed_events(spark, SF)))
    assert "partial_count(1)" in text and "partial_sum" in text


def test_shape_join_shuffles_on_the_whole_key(spark):
    text = plan(J.natural_join(mixed_events(spark, SF), CORE))
    assert "SortMergeJoin" in text  # output may be large: spread by key even when inputs are small
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert all("key#" in line for line in joins)


def test_map_is_built_once_per_row(spark):
    """Exploding pairs must not add a filter that builds the map again."""
    text = plan(shred(mixed_events(spark, SF)))
    assert text.count("map_from_entries") == 1


def test_top_groups_are_limited_before_the_shuffle(spark):
    groups = spark.createDataFrame(
        [(0, "a", "1", 3, "a", "1")], "w long, g_attr string, g_val string, n_docs long, attr string, val string"
    )
    assert "WindowGroupLimit" in plan(top_k_groups(groups, 2))


def test_hot_keys_add_cells_to_the_join_key(spark):
    hot = Core(CORE.attrs, rest=False, index=False, hot=True)
    text = plan(J.natural_join(mixed_events(spark, SF), hot).where(F.col("a") > 0))
    line = next(x for x in text.splitlines() if "SortMergeJoin" in x and "key#" in x)
    assert "_gl#" in line and "_gr#" in line


def test_nested_json_is_parsed_once(spark):
    """Neither the explode nor the check of the depth parses the levels again."""
    text = QUERIES["json_nested_deep"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 2 * 7  # as text and as variants, the document and six levels
