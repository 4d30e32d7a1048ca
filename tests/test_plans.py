"""Plan shape: no cartesian products or nested-loop joins in the join
statistics, filters reach the Parquet scan, columns are pruned."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
NO_CROSS = [
    "category_post_counts", "category_view_counts", "category_comment_counts", "most_active_categories",
    "most_active_categories_literal", "most_active_users", "most_active_users_literal", "user_engagement",
    "user_engagement_literal", "author_stats", "new_users_daily", "user_timeline", "user_timeline_literal",
    "category_growth", "category_growth_literal", "post_overview", "category_overview", "invalid_likes",
    "like_events_final_state", "comment_like_counter_replay",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_products(spark, name):
    p = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, p


def test_filter_pushdown_and_pruning(spark):
    p = plan(queries()["comments_by_author"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in p, p
    p = plan(queries()["user_counts_by_role"](spark, SF))
    assert "ReadSchema: struct<c_custkey:bigint>" in p, p


def test_top_k_is_take_ordered(spark):
    p = plan(queries()["most_viewed"](spark, SF))
    assert "TakeOrderedAndProject" in p and "Sort " not in p


def test_preaggregation_before_join(spark):
    # comments reach the category join only as a per-post partial aggregate
    p = plan(queries()["most_active_categories"](spark, SF))
    assert p.count("HashAggregate") >= 4, p
