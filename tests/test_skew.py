"""Hot keys: one key holding a large share of the rows.

The checks look at what a task receives, not only at results: a hot pair's
like log is split over several ordered segments, and a hot post's comments
reach the join only as partial aggregates.
"""

import datetime as dt

from frames import D, comment, post, tables, user

from contentlens.operators import categories as cat
from contentlens.operators import changes as chg

EVENTS = "event_id long, ts timestamp_ntz, user_id long, comment_id long, action string"


def test_hot_pair_is_split_into_ordered_segments(spark):
    hot = [(i, D(2024, 1, 1) + dt.timedelta(seconds=i), 1, 1, "like" if i % 3 else "unlike") for i in range(600)]
    cold = [(1000 + i, D(2024, 1, 1), 2 + i, 9, "like") for i in range(300)]
    ev = spark.createDataFrame(hot + cold, EVENTS)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    # tiny test data: keep AQE from merging the ranges so the split is visible
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seg = chg._ordered_segments(ev, ["user_id", "comment_id"], ["ts", "event_id"])
        per_seg = seg.where("user_id = 1").groupBy("__seg").count().collect()
        assert len(per_seg) >= 3  # the hot pair's history is spread over several tasks
        assert max(r["count"] for r in per_seg) < 600
        likes = spark.createDataFrame([], "user_id long, comment_id long, created_at timestamp_ntz")
        out = {(r["user_id"], r["comment_id"]): (r["liked"], r["accepted"], r["rejected"])
               for r in chg.like_event_outcomes(likes, ev).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state, acc = False, 0
    for _, _, _, _, a in hot:
        want = a == "like"
        acc += want != state
        state = want
    assert out[(1, 1)] == (state, acc, 600 - acc)


def test_hot_post_is_pre_aggregated(spark):
    # post 1 holds 90% of the comments
    comments = [comment(i, 1, 1 if i % 10 else 2) for i in range(2000)]
    t = tables(spark, users=[user(1)], cats=[(7, "c", "c", None, 0)],
               posts=[post(1, 1, cat=7, views=3, likes=2), post(2, 1, cat=7, views=5, likes=1)], comments=comments)
    df = cat.category_stats(t.categories, t.posts, t.comments, "literal")
    r = df.first()
    assert (r["posts"], r["comments"], r["views"], r["likes"]) == (2, 2000, 3 * 1800 + 5 * 200, 2 * 1800 + 1 * 200)
    p = df._jdf.queryExecution().executedPlan().toString()
    # the comments side is reduced per post before it is shuffled
    assert "partial_count(1)" in p
