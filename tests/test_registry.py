"""Every registered query against its SQL twin at the smallest scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import check
from registry.oracles import ORACLES
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
# The rest is covered by ``check.py``; DOCWEAVE_TESTS=all runs every query here as well.
QUICK = """
    attr_join_order attr_postings contracted_pairs doc_identity doc_latest doc_maps doc_neighbours
    doc_pairs_encoded doc_values_canonical expansion_lists group_order groups_merged join_csv join_customers
    join_merged join_orders join_parts join_places join_sets join_table json_nested_flatten json_nested_whole
    partition_load_idle partition_idle_least json_nested_deep doc_trimmed_pairs join_wide join_wide_index join_wide_sets
    join_hot join_hot_sets repartition_plan partition_assign partition_update quality_drift routes_unseen set_ops
    window_sizes_by_source window_sizes_time
""".split()
NAMES = sorted(QUERIES) if os.environ.get("DOCWEAVE_TESTS") == "all" else QUICK


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = check.compare(spark, con, SF, name)
    assert not result.startswith("FAIL"), result


def test_entry(spark):
    assert entry.entry(spark).count() == 6772
