"""Physical plans: what is pushed down, what is not shuffled, what never appears."""

import re
from pathlib import Path

import pytest

from lakeloom.plans import QUERIES
from lakeloom.plans.registry import MODULE_OF

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")

BATCH = [n for n, m in MODULE_OF.items() if m in ("tpch", "wideweb", "relational", "history", "events", "maintenance")]


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", [n for n in BATCH if MODULE_OF[n] in ("history", "maintenance", "events")])
def test_no_window_over_all_rows(spark, name):
    assert not re.search(r"Window .*\n.*Sort .*\n.*Exchange SinglePartition", plan(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "tpch_q6")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}


def test_bucketed_join_does_not_shuffle(spark):
    text = plan(spark, "bucketed_join")
    below = text[text.index("SortMergeJoin"):]
    assert "Exchange" not in below


def test_partition_filter_prunes(spark):
    assert re.search(r"PartitionFilters: \[isnotnull\(l_returnflag.*= R\)", plan(spark, "partition_pruned_scan"))


def test_history_needs_one_shuffle(spark):
    assert plan(spark, "scd2_history").count("Exchange hashpartitioning") == 1


def test_lookup_does_not_shuffle_the_facts(spark):
    text = plan(spark, "period_lookup")
    assert text.count("BroadcastHashJoin") == 2 and "Exchange hashpartitioning" not in text


def test_last_rows_are_limited_before_the_shuffle(spark):
    text = plan(spark, "last_n_per_key")
    assert text.count("WindowGroupLimit") == 2


def test_messages_are_parsed_once(spark):
    text = plan(spark, "notification_filter")
    assert text.count("from_json") == 1


def test_knn_ships_only_the_best(spark):
    text = plan(spark, "knn_l2")
    assert text.index("Exchange") < text.index("MapInArrow") and text.count("Exchange hashpartitioning") == 1
