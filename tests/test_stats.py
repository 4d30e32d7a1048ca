"""Statistics on literal frames: fan-out, zero-filling, NULL groups, rounding."""

import datetime as dt

from conftest import rows
from frames import D, comment, fanout, post, tables, user

from contentlens.functions.columns import elapsed_days, round_ratio_half_up
from contentlens.operators import categories as cat
from contentlens.operators import comments as com
from contentlens.operators import posts as pst
from contentlens.operators import users as usr


def test_most_active_users_true_and_literal(spark):
    t = fanout(spark)
    true = {r["id"]: r for r in usr.user_activity(t.users, t.posts, t.comments).collect()}
    lit = {r["id"]: r for r in usr.user_activity(t.users, t.posts, t.comments, "literal").collect()}
    assert (true[1]["likes_given"], true[1]["likes_received"]) == (6, 30)
    assert (lit[1]["likes_given"], lit[1]["likes_received"]) == (12, 90)
    assert (true[1]["posts"], true[1]["comments"]) == (2, 3)
    # user without posts or comments: zeros, not NULL
    assert (true[2]["posts"], true[2]["comments"], true[2]["likes_given"], true[2]["likes_received"]) == (0, 0, 0, 0)
    top = usr.most_active_users(t.users, t.posts, t.comments, 1)
    assert [r["id"] for r in top.collect()] == [1]


def test_category_stats_fanout(spark):
    t = fanout(spark)
    true = {r["id"]: r.asDict() for r in cat.category_stats(t.categories, t.posts, t.comments).collect()}
    lit = {r["id"]: r.asDict() for r in cat.category_stats(t.categories, t.posts, t.comments, "literal").collect()}
    assert (true[10]["posts"], true[10]["views"], true[10]["comments"], true[10]["likes"]) == (2, 12, 3, 30)
    assert (lit[10]["views"], lit[10]["likes"]) == (5 * 3 + 7, 10 * 3 + 20)
    assert (true[11]["posts"], true[11]["views"], true[11]["comments"], true[11]["likes"]) == (0, 0, 0, 0)


def test_post_counts_null_category_is_a_group(spark):
    t = tables(spark, users=[user(1)], posts=[post(1, 1, cat=None), post(2, 1, cat=None), post(3, 1, cat=5)])
    assert rows(pst.post_counts_by_category(t.posts)) == [(None, 2), (5, 1)]


def test_a10_plus_null_group_equals_post_count(spark):
    t = tables(
        spark,
        users=[user(1)],
        cats=[(1, "a", "a", None, 0), (2, "b", "b", 1, 0)],
        posts=[post(1, 1, cat=1), post(2, 1, cat=None), post(3, 1, cat=2), post(4, 1, cat=1)],
    )
    a10 = sum(r["post_count"] for r in cat.category_post_counts(t.categories, t.posts).collect())
    null_group = [r["post_count"] for r in pst.post_counts_by_category(t.posts).collect() if r["category_id"] is None]
    assert a10 + sum(null_group) == t.posts.count()


def test_popular_tags_empty_and_duplicates(spark):
    t = tables(spark, users=[user(1)], posts=[post(1, 1, tags=["x", "x", "y"]), post(2, 1, tags=[]), post(3, 1, tags=["y"])])
    assert rows(pst.tag_counts(t.posts)) == [("x", 2), ("y", 2)]
    assert [r["tag"] for r in pst.popular_tags(t.posts, 1).collect()] == ["x"]  # ties by tag


def test_author_stats_counts_comments_on_own_posts(spark):
    t = fanout(spark)
    r = {x["author_id"]: x for x in pst.author_stats(t.users, t.posts, t.comments).collect()}
    assert (r[1]["total_posts"], r[1]["total_views"], r[1]["total_likes"], r[1]["total_comments"]) == (2, 12, 30, 3)
    assert (r[1]["published"], r[1]["drafts"], r[1]["archived"]) == (2, 0, 0)
    assert r[2]["total_posts"] == 0 and r[2]["total_comments"] == 0


def test_comment_stats_rounding_half_up(spark):
    # likes 1 and 2 -> avg 1.5; likes 0,0,1 -> 0.333.. -> 0.33; 1,1,1,2 (1.25) -> 1.25
    t = tables(
        spark,
        users=[user(1), user(2), user(3), user(4)],
        comments=[comment(1, 1, 1, likes=1), comment(2, 1, 1, likes=2),
                  comment(3, 2, 1, likes=0), comment(4, 2, 1, likes=0), comment(5, 2, 1, likes=1, parent=3)],
    )
    r = {x["author_id"]: x for x in com.comment_stats_by_author(t.users, t.comments).collect()}
    assert r[1]["average_likes_per_comment"] == 1.5
    assert r[2]["average_likes_per_comment"] == 0.33
    assert r[2]["total_replies"] == 1
    assert r[3]["average_likes_per_comment"] == 0.0 and r[3]["total_comments"] == 0


def test_round_ratio_half_up_exact(spark):
    df = spark.createDataFrame([(1, 8), (5, 1000), (-5, 1000), (2, 3), (1, 0)], "n long, d long")
    got = [r[0] for r in df.select(round_ratio_half_up("n", "d", 2)).collect()]
    assert got == [0.13, 0.01, -0.01, 0.67, None]


def test_elapsed_days_47_hours_is_one_day(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 23), D(2024, 1, 3, 22))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(elapsed_days("a", "b")).first()[0] == 1


def test_user_engagement_unknown_user_zero_row(spark):
    t = fanout(spark)
    out = usr.user_engagement(t.users, t.posts, t.comments, dt.datetime(2024, 1, 31), user_id=999).collect()
    assert len(out) == 1 and out[0]["user_id"] == 999 and out[0]["total_posts"] == 0


def test_user_engagement_last_activity_uses_updates(spark):
    t = tables(
        spark,
        users=[user(1, created=D(2024, 1, 1)), user(2, created=D(2024, 1, 10))],
        posts=[post(1, 1, updated=D(2024, 1, 20, 12))],
        comments=[comment(1, 1, 1, updated=D(2024, 1, 25)), comment(2, 2, 1)],
    )
    r = {x["user_id"]: x for x in usr.user_engagement(t.users, t.posts, t.comments, "2024-01-31 00:00:00").collect()}
    assert (r[1]["days_since_join"], r[1]["days_since_last_activity"]) == (30, 6)
    # a never-edited comment does not count as activity
    assert (r[2]["days_since_join"], r[2]["days_since_last_activity"]) == (21, 21)


def test_empty_tables(spark):
    t = tables(spark)
    assert cat.category_post_counts(t.categories, t.posts).count() == 0
    assert usr.most_active_users(t.users, t.posts, t.comments).count() == 0
    assert pst.popular_tags(t.posts).count() == 0
    assert com.comments_by_hour(t.comments).count() == 0


def test_top_k_ties_by_key(spark):
    t = tables(spark, users=[user(1)], posts=[post(i, 1, likes=5) for i in (3, 1, 2)])
    assert [r["id"] for r in pst.most_liked_posts(t.posts, 2).collect()] == [1, 2]


def test_most_replied_roots_only(spark):
    t = tables(
        spark,
        users=[user(1)],
        comments=[comment(1, 1, 1), comment(2, 1, 1, parent=1), comment(3, 1, 1, parent=2), comment(4, 1, 1, parent=2),
                  comment(5, 1, 1)],
    )
    got = [(r["id"], r["reply_count"]) for r in com.most_replied_comments(t.comments).collect()]
    assert got == [(1, 1)]  # comment 2 has 2 replies but is not a root; 5 has none


def test_single_author_stats_unknown_is_zero_row(spark):
    t = fanout(spark)
    a = pst.author_stats(t.users, t.posts, t.comments, author_id=999).collect()
    assert len(a) == 1 and a[0]["author_id"] == 999 and a[0]["total_posts"] == 0
    b = com.comment_stats_by_author(t.users, t.comments, author_id=999).collect()
    assert len(b) == 1 and b[0]["average_likes_per_comment"] == 0.0
    k = pst.author_stats(t.users, t.posts, t.comments, author_id=1).collect()
    assert len(k) == 1 and k[0]["total_posts"] == 2


def test_series_to_long(spark):
    from contentlens.operators.timeseries import to_long

    wide = spark.createDataFrame([("2024-01-01", 1, 2), ("2024-01-02", 3, 4)], "date string, a bigint, b bigint")
    got = rows(to_long(wide, ["date"], ["a", "b"]))
    assert got == [("2024-01-01", "a", 1), ("2024-01-01", "b", 2), ("2024-01-02", "a", 3), ("2024-01-02", "b", 4)]
