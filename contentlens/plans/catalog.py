"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry reads the driver tables through the fixture views (whole
tables, no sampling) and runs one library operator with fixed parameters.
Outputs are flat (array columns joined to text) so they can be compared
with the DuckDB oracle of :mod:`contentlens.plans.oracle`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.functions.visibility import Viewer
from contentlens.operators import categories as cat
from contentlens.operators import changes as chg
from contentlens.operators import comments as com
from contentlens.operators import filters as flt
from contentlens.operators import hierarchy as hier
from contentlens.operators import intervals as itv
from contentlens.operators import maintained as mt
from contentlens.operators import posts as pst
from contentlens.operators import quality as qa
from contentlens.operators import timeseries as ts
from contentlens.operators import users as usr
from contentlens.plans import reports as rep
from contentlens.session import ensure_checkpoint_dir, stored
from contentlens.sources import clustered as clu
from contentlens.sources.fixtures import AS_OF, content_tables, likes_raw_view, like_log_view
from contentlens.sources.tables import load_tables, save_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def flat(df: DataFrame) -> DataFrame:
    """Replace array columns by comma-joined text."""
    return df.select(
        *[
            F.array_join(F.col(f.name), ",").alias(f.name)
            if f.dataType.typeName() == "array"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _t(spark, d):
    return content_tables(spark, d)


# ------------------------------------------------------------ F / P (listings)


@query("posts_by_author")
def _q(spark, d):
    return flat(flt.posts_by_author(_t(spark, d).posts, 7))


@query("posts_by_category")
def _q(spark, d):
    return flat(flt.page(flt.posts_by_category(_t(spark, d).posts, 1001), 2, 10))


@query("posts_by_status")
def _q(spark, d):
    return flat(flt.page(flt.posts_by_status(_t(spark, d).posts, "draft"), 1, 10))


@query("featured_posts")
def _q(spark, d):
    return flat(flt.page(flt.featured_posts(_t(spark, d).posts), 1, 10))


@query("search_title")
def _q(spark, d):
    return flat(flt.search_title(_t(spark, d).posts, "WIDGET"))


@query("search_tag")
def _q(spark, d):
    return flat(flt.search_tag(_t(spark, d).posts, "urgent"))


@query("comments_by_post")
def _q(spark, d):
    return flt.comments_by_post(_t(spark, d).comments, 7)


@query("comments_by_author")
def _q(spark, d):
    return flt.comments_by_author(_t(spark, d).comments, 3)


@query("replies")
def _q(spark, d):
    return flt.replies(_t(spark, d).comments, 500)


@query("root_comments")
def _q(spark, d):
    return flt.root_comments(_t(spark, d).comments, 7)


@query("likes_by_comment")
def _q(spark, d):
    return flt.likes_by_comment(_t(spark, d).comment_likes, 5)


@query("likes_by_user")
def _q(spark, d):
    return flt.likes_by_user(_t(spark, d).comment_likes, 9)


@query("list_posts_anonymous")
def _q(spark, d):
    items, _ = flt.list_posts(_t(spark, d).posts, None, 1, 10)
    return flat(items)


@query("list_posts_owner")
def _q(spark, d):
    items, _ = flt.list_posts(_t(spark, d).posts, Viewer(7, "user"), 1, 10)
    return flat(items)


@query("list_posts_admin_tag_search")
def _q(spark, d):
    items, _ = flt.list_posts(_t(spark, d).posts, Viewer(50, "admin"), 2, 20, tag="urgent", search="red")
    return flat(items)


@query("posts_page_info")
def _q(spark, d):
    _, info = flt.list_posts(_t(spark, d).posts, None, 1, 10)
    return info


# ------------------------------------------------------------ A (statistics)


@query("post_counts_by_status")
def _q(spark, d):
    return pst.post_counts_by_status(_t(spark, d).posts)


@query("post_counts_by_category")
def _q(spark, d):
    return pst.post_counts_by_category(_t(spark, d).posts)


@query("popular_tags")
def _q(spark, d):
    return pst.popular_tags(_t(spark, d).posts, 10)


@query("author_stats")
def _q(spark, d):
    t = _t(spark, d)
    return pst.author_stats(t.users, t.posts, t.comments)


@query("comment_counts_by_post")
def _q(spark, d):
    t = _t(spark, d)
    return pst.comment_counts_by_post(t.posts, t.comments)


@query("comments_with_reply_count")
def _q(spark, d):
    return com.with_reply_count(_t(spark, d).comments)


@query("comment_stats_by_author")
def _q(spark, d):
    t = _t(spark, d)
    return com.comment_stats_by_author(t.users, t.comments)


@query("comments_by_hour")
def _q(spark, d):
    return com.comments_by_hour(_t(spark, d).comments)


@query("user_counts_by_role")
def _q(spark, d):
    return usr.user_counts_by_role(_t(spark, d).users)


@query("category_post_counts")
def _q(spark, d):
    t = _t(spark, d)
    return cat.category_post_counts(t.categories, t.posts)


@query("category_view_counts")
def _q(spark, d):
    t = _t(spark, d)
    return cat.category_view_counts(t.categories, t.posts)


@query("category_comment_counts")
def _q(spark, d):
    t = _t(spark, d)
    return cat.category_comment_counts(t.categories, t.posts, t.comments)


@query("categories_with_post_count")
def _q(spark, d):
    t = _t(spark, d)
    return cat.with_post_count(t.categories, t.posts)


@query("most_active_categories")
def _q(spark, d):
    t = _t(spark, d)
    return cat.most_active_categories(t.categories, t.posts, t.comments, 10)


@query("most_active_categories_literal")
def _q(spark, d):
    t = _t(spark, d)
    return cat.most_active_categories(t.categories, t.posts, t.comments, 10, "literal")


@query("most_active_users")
def _q(spark, d):
    t = _t(spark, d)
    return usr.most_active_users(t.users, t.posts, t.comments, 10)


@query("most_active_users_literal")
def _q(spark, d):
    t = _t(spark, d)
    return usr.most_active_users(t.users, t.posts, t.comments, 10, "literal")


@query("user_engagement")
def _q(spark, d):
    t = _t(spark, d)
    return usr.user_engagement(t.users, t.posts, t.comments, AS_OF)


@query("user_engagement_literal")
def _q(spark, d):
    t = _t(spark, d)
    return usr.user_engagement(t.users, t.posts, t.comments, AS_OF, "literal")


@query("most_commented_posts_full")
def _q(spark, d):
    t = _t(spark, d)
    return flat(pst.most_commented_posts(t.posts, t.comments, 10))


@query("likes_per_comment")
def _q(spark, d):
    return com.likes_count_by_comment(_t(spark, d).comment_likes)


# ------------------------------------------------------------ D (series)


@query("new_users_daily")
def _q(spark, d):
    return ts.new_users_daily(_t(spark, d).users, AS_OF, 30)


@query("user_timeline")
def _q(spark, d):
    t = _t(spark, d)
    return ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, user_id=3)


@query("user_timeline_literal")
def _q(spark, d):
    t = _t(spark, d)
    return ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, user_id=3, semantics="literal")


@query("category_growth")
def _q(spark, d):
    t = _t(spark, d)
    return ts.category_growth(t.categories, t.posts, t.comments, AS_OF, 30)


@query("category_growth_literal")
def _q(spark, d):
    t = _t(spark, d)
    return ts.category_growth(t.categories, t.posts, t.comments, AS_OF, 30, "literal")


# ------------------------------------------------------------ H (hierarchies)


@query("category_ancestors")
def _q(spark, d):
    return hier.ancestors(_t(spark, d).categories, 3005)


@query("category_descendants")
def _q(spark, d):
    return hier.descendants(_t(spark, d).categories, 1001)


@query("category_depths")
def _q(spark, d):
    return hier.depth_stats(_t(spark, d).categories)


@query("comment_thread_depths")
def _q(spark, d):
    return hier.depths(_t(spark, d).comments.select("id", "parent_id")).groupBy("depth").agg(
        F.count(F.lit(1)).alias("comment_count")
    )


# ------------------------------------------------------------ T (top-k)


@query("most_viewed")
def _q(spark, d):
    return flat(pst.most_viewed_posts(_t(spark, d).posts, 10))


@query("most_liked")
def _q(spark, d):
    return flat(pst.most_liked_posts(_t(spark, d).posts, 10))


@query("top_commenters")
def _q(spark, d):
    return com.top_commenters(_t(spark, d).comments, 10)


@query("top_commented")
def _q(spark, d):
    return com.top_commented_posts(_t(spark, d).comments, 10)


@query("most_liked_comments")
def _q(spark, d):
    return com.most_liked_comments(_t(spark, d).comments, 10)


@query("most_replied_comments")
def _q(spark, d):
    return com.most_replied_comments(_t(spark, d).comments, 10)


# ------------------------------------------------------------ R (reports)


@query("post_overview")
def _q(spark, d):
    t = _t(spark, d)
    return rep.post_overview(t)["totals"]


@query("category_overview")
def _q(spark, d):
    t = _t(spark, d)
    return rep.category_overview(t)["totals"]


@query("comment_overview")
def _q(spark, d):
    return rep.comment_overview(_t(spark, d))["totals"]


@query("list_categories_roots")
def _q(spark, d):
    t = _t(spark, d)
    return rep.list_categories(t.categories, t.posts, None, 1, 10)["items"]


@query("list_categories_children")
def _q(spark, d):
    t = _t(spark, d)
    return rep.list_categories(t.categories, t.posts, 2007, 1, 10)["items"]


@query("list_comments_roots")
def _q(spark, d):
    return rep.list_comments(_t(spark, d).comments, 7, None, 1, 10)["items"]


# ------------------------------------------------------------ V / W (changes)


@query("like_count_drift")
def _q(spark, d):
    t = _t(spark, d)
    return com.like_count_drift(t.comments, t.comment_likes)


@query("invalid_likes")
def _q(spark, d):
    t = _t(spark, d)
    v = qa.validate_like_requests(likes_raw_view(spark, d), t.users, t.comments)
    return flat(v)


@query("user_audit")
def _q(spark, d):
    """V1 with planted violations of every rule, against stored users."""
    t = _t(spark, d)
    k = F.col("id")
    batch = t.users.select(
        "id",
        F.floor(k / 2).alias("seq"),
        F.when(k % 7 == 1, "no-address").otherwise(F.concat(F.lit("user"), (k - k % 5).cast("string"), F.lit("@example.org"))).alias("email"),
        F.when(k % 11 == 2, "ab").otherwise(F.concat(F.lit("name-"), (k - k % 3).cast("string"))).alias("username"),
        F.when(k % 13 == 3, F.repeat(F.lit("x"), 300)).alias("full_name"),
    )
    stored = t.users.where(F.col("id") % 10 == 0)
    return flat(qa.validate_users(batch, stored, order=("seq", "id")).select("id", "reasons"))


@query("signup_chain_audit")
def _q(spark, d):
    """V1 where each row shares its email or its username with the row before:
    one chain of conflicts, broken only by rows that are refused anyway."""
    t = _t(spark, d)
    k = F.col("id")
    batch = t.users.select(
        "id",
        F.concat(F.lit("pair"), F.floor(k / 2).cast("string"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("link-"), F.floor((k + 1) / 2).cast("string")).alias("username"),
        F.when(k % 997 == 0, F.repeat(F.lit("x"), 300)).alias("full_name"),
    )
    return flat(qa.validate_users(batch, t.users.limit(0), order="id").select("id", "reasons"))


@query("category_audit")
def _q(spark, d):
    """V2 with planted violations of every rule, against a third of the categories."""
    t = _t(spark, d)
    k = F.col("id")
    batch = t.categories.select(
        "id",
        F.floor(k / 2).alias("seq"),
        F.when(k % 17 == 4, "").otherwise(F.col("name")).alias("name"),
        F.when(k % 13 == 5, "Not A Slug").when(k >= 2000, F.concat(F.lit("topic-"), (k - k % 4).cast("string"))).otherwise(F.col("slug")).alias("slug"),
        F.when(k % 19 == 6, 999999).when(k == 1001, 2006).when(k == 1002, 1002).otherwise(F.col("parent_id")).alias("parent_id"),
    )
    v = qa.validate_categories(batch, t.categories.where(F.col("id") % 3 == 0))
    return flat(v.select("id", "reasons"))


@query("post_audit")
def _q(spark, d):
    """V3 with planted violations of every rule."""
    t = _t(spark, d)
    k = F.col("id")
    batch = t.posts.select(
        "id",
        F.when(k % 23 == 1, "").when(k % 23 == 2, F.repeat(F.lit("t"), 256)).otherwise(F.col("title")).alias("title"),
        F.when(k % 29 == 3, "").when(k % 29 == 4, F.lit(None)).otherwise(F.col("content")).alias("content"),
        F.when(k % 31 == 5, F.repeat(F.lit("e"), 501)).when(k % 31 == 6, "short").alias("excerpt"),
        F.when(k % 37 == 7, "hidden").otherwise(F.col("status")).alias("status"),
        F.when(k % 41 == 8, -1).otherwise(F.col("author_id")).alias("author_id"),
        F.when(k % 43 == 9, -1).otherwise(F.col("category_id")).alias("category_id"),
    )
    return flat(qa.validate_posts(batch, t.users, t.categories).select("id", "reasons"))


@query("comment_audit")
def _q(spark, d):
    """V4 with planted violations of every rule."""
    t = _t(spark, d)
    k = F.col("id")
    batch = t.comments.select(
        "id",
        F.when(k % 23 == 1, "").when(k % 23 == 2, F.repeat(F.lit("c"), 1001)).otherwise(F.col("content")).alias("content"),
        F.when(k % 29 == 3, -5).otherwise(F.col("post_id")).alias("post_id"),
        F.when(k % 31 == 4, -9).when(k % 31 == 5, 1).otherwise(F.col("parent_id")).alias("parent_id"),
    )
    return flat(qa.validate_comments(batch, t.posts, t.comments).select("id", "reasons"))


@query("like_events_final_state")
def _q(spark, d):
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    return chg.like_event_outcomes(t.comment_likes, log).drop("liked_since")


@query("comment_like_counter_replay")
def _q(spark, d):
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    return chg.counter_after_deltas(t.comments, _deltas(log), "like_count", ("ts", "event_id", "user_id"))


def _deltas(log):
    return log.select(
        F.col("comment_id").alias("id"), "ts", "event_id", "user_id",
        F.when(F.col("action") == "like", 1).otherwise(-1).alias("delta"),
    )


@query("comments_after_counter_replay")
def _q(spark, d):
    """The comments with the replayed counters."""
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    return chg.apply_counter_deltas(t.comments, _deltas(log), "like_count", ("ts", "event_id", "user_id"))


@query("cascade_delete_counts")
def _q(spark, d):
    t = _t(spark, d)
    ids = t.users.where(F.col("id") == 3).select("id")
    return chg.delete_counts(t, "users", ids)


# ------------------------------------------------------------ more lookups


@query("posts_lookup_bulk")
def _q(spark, d):
    t = _t(spark, d)
    return flat(flt.lookup(t.posts, t.comments.select(F.col("post_id").alias("id"))))


@query("category_by_slug")
def _q(spark, d):
    return flt.by_slug(_t(spark, d).categories, "nation-7")


@query("user_by_email")
def _q(spark, d):
    return flt.by_email(_t(spark, d).users, "user42@example.org")


@query("user_by_username")
def _q(spark, d):
    return flt.by_username(_t(spark, d).users, "Customer#000000042")


@query("like_by_pair")
def _q(spark, d):
    return flt.like_by_user_and_comment(_t(spark, d).comment_likes, 459, 0)


@query("category_children")
def _q(spark, d):
    return flt.children(_t(spark, d).categories, 1001)


@query("root_categories")
def _q(spark, d):
    return flt.root_categories(_t(spark, d).categories)


@query("list_comments_replies")
def _q(spark, d):
    return rep.list_comments(_t(spark, d).comments, 7, 8, 1, 10)["items"]


@query("post_visibility_bulk")
def _q(spark, d):
    """F22 in bulk: may each commenter see the post they commented on?"""
    t = _t(spark, d)
    req = t.comments.select(
        F.col("id").alias("request_id"), F.col("author_id").alias("viewer_id"), "post_id"
    ).join(t.users.select(F.col("id").alias("viewer_id"), F.col("role").alias("viewer_role")), "viewer_id", "left")
    return flt.visibility_of_requests(t.posts, req)


@query("post_visibility_split")
def _q(spark, d):
    """F22 in bulk with hot posts kept out of the shuffle: may each liker see the
    post of the comment they liked?"""
    t = _t(spark, d)
    on = t.comments.select(F.col("id").alias("comment_id"), "post_id")
    req = t.comment_likes.join(on, "comment_id").select(
        F.col("user_id").alias("viewer_id"), "comment_id", "post_id", F.lit("user").alias("viewer_role")
    )
    return flt.visibility_of_requests(t.posts, req, split_hot=True)


# ------------------------------------------------------------ full tables


@query("tag_counts")
def _q(spark, d):
    return pst.tag_counts(_t(spark, d).posts)


@query("category_stats_literal")
def _q(spark, d):
    t = _t(spark, d)
    return cat.category_stats(t.categories, t.posts, t.comments, "literal")


@query("user_activity_literal")
def _q(spark, d):
    t = _t(spark, d)
    return usr.user_activity(t.users, t.posts, t.comments, "literal")


# ------------------------------------------------------------ more rules


@query("comment_subtree")
def _q(spark, d):
    t = _t(spark, d)
    seeds = t.comments.where(F.col("id") == 8).select("id")
    return hier.subtree(t.comments, seeds, within="post_id")


@query("category_intervals")
def _q(spark, d):
    """H1, H2, H5: the number range of every category's subtree."""
    return itv.interval_labels(_t(spark, d).categories)


@query("comment_intervals")
def _q(spark, d):
    return itv.interval_labels(_t(spark, d).comments)


@query("comments_under_edited")
def _q(spark, d):
    """H5 in bulk by intervals: every edited comment with its whole subtree."""
    t = _t(spark, d)
    return itv.subtrees_by_interval(stored(itv.interval_labels(t.comments), "labels"), t.comments.where("is_edited").select("id"))


@query("reparent_regions_under_nations")
def _q(spark, d):
    """H4: moving each region under its first nation must be refused."""
    t = _t(spark, d)
    changes = (
        t.categories.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.min("id").alias("parent_id"))
        .where(F.col("id") < 2000)
    )
    return hier.reparent_conflicts(t.categories, changes)


@query("category_delete_rejects")
def _q(spark, d):
    t = _t(spark, d)
    return chg.category_delete_rejects(t.categories, t.categories.select("id"))


@query("unlike_requests")
def _q(spark, d):
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    pairs = log.where(F.col("action") == "unlike").select("user_id", "comment_id").distinct()
    _, report = chg.delete_likes(t.comment_likes, pairs)
    return report


@query("publish_drafts_of_author")
def _q(spark, d):
    t = _t(spark, d)
    drafts = t.posts.where((F.col("author_id") == 7) & (F.col("status") == "draft")).select("id")
    out = chg.set_status(t.posts, drafts, "published", "2024-02-01 00:00:00")
    return flat(out)


@query("reconcile_like_counts")
def _q(spark, d):
    t = _t(spark, d)
    return com.reconcile_like_counts(t.comments, t.comment_likes).select("id", "like_count")


@query("insert_comment_replies")
def _q(spark, d):
    """Every root comment on post 7 gets an auto reply; defaults fill the rest."""
    t = _t(spark, d)
    new = t.comments.where((F.col("post_id") == 7) & F.col("parent_id").isNull()).select(
        (F.col("id") + 1_000_000_000).alias("id"),
        F.lit("thanks").alias("content"),
        F.lit(0).cast("bigint").alias("author_id"),
        "post_id",
        F.col("id").alias("parent_id"),
    )
    return chg.insert_rows(t.comments, new, "comments", "2024-02-01 00:00:00")


@query("likes_after_log")
def _q(spark, d):
    """The like table after replaying the like/unlike log."""
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    return chg.apply_like_events(t.comment_likes, log)


@query("edit_comments_of_author")
def _q(spark, d):
    """Author 3 rewrites every comment (content upper-cased)."""
    t = _t(spark, d)
    edits = t.comments.where(F.col("author_id") == 3).select("id", F.upper("content").alias("content"))
    return chg.edit_comments(t.comments, edits, "2024-02-01 00:00:00")


@query("merge_nation_updates")
def _q(spark, d):
    """Nations move 100 places down; NULL fields keep their values."""
    t = _t(spark, d)
    changes = t.categories.where(F.col("id").between(2000, 2999)).select(
        "id", F.lit(None).cast("string").alias("name"), (F.col("order") + 100).alias("order"),
        F.lit(None).cast("int").alias("parent_id"),
    )
    return chg.update_merge(t.categories, changes, "2024-02-01 00:00:00")


# ------------------------------------------------------------ whole results


@query("user_timeline_all")
def _q(spark, d):
    """D2 for every user."""
    t = _t(spark, d)
    return ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30)


@query("user_timeline_literal_all")
def _q(spark, d):
    t = _t(spark, d)
    return ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, semantics="literal")


@query("likes_after_unlikes")
def _q(spark, d):
    """The likes that remain after every unlike request of the log."""
    t = _t(spark, d)
    log = like_log_view(spark, d, t.users, t.comments)
    pairs = log.where(F.col("action") == "unlike").select("user_id", "comment_id").distinct()
    left, _ = chg.delete_likes(t.comment_likes, pairs)
    return left


def _after(spark, d, table, ids):
    t = _t(spark, d)
    rows = getattr(t, table)
    return chg.tables_after_delete(t, table, rows.where(F.col("id").isin(ids)).select("id"))


@query("posts_after_user_delete")
def _q(spark, d):
    """W5 from users: the posts left."""
    return flat(_after(spark, d, "users", [3]).posts)


@query("comments_after_user_delete")
def _q(spark, d):
    return _after(spark, d, "users", [3]).comments


@query("likes_after_user_delete")
def _q(spark, d):
    return _after(spark, d, "users", [3]).comment_likes


@query("inactive_users_delete_counts")
def _q(spark, d):
    """W5 in bulk: what goes with all inactive users."""
    t = _t(spark, d)
    return chg.delete_counts(t, "users", t.users.where(~F.col("is_active")).select("id"))


def _after_inactive(spark, d):
    t = _t(spark, d)
    return chg.tables_after_delete(t, "users", t.users.where(~F.col("is_active")).select("id"))


@query("comments_after_inactive_users_delete")
def _q(spark, d):
    return _after_inactive(spark, d).comments


@query("likes_after_inactive_users_delete")
def _q(spark, d):
    return _after_inactive(spark, d).comment_likes


@query("likes_after_edited_comments_delete")
def _q(spark, d):
    """W5 from comments, in bulk: edited comments go with all their replies."""
    t = _t(spark, d)
    return chg.tables_after_delete(t, "comments", t.comments.where("is_edited").select("id")).comment_likes


@query("comments_after_post_delete")
def _q(spark, d):
    """W5 from posts."""
    return _after(spark, d, "posts", [7]).comments


@query("likes_after_comment_delete")
def _q(spark, d):
    """W5 from comments."""
    return _after(spark, d, "comments", [8, 9]).comment_likes


@query("posts_after_category_delete")
def _q(spark, d):
    """W5 from categories: posts lose the category, children their parent."""
    return flat(_after(spark, d, "categories", [2007]).posts)


@query("categories_after_category_delete")
def _q(spark, d):
    return _after(spark, d, "categories", [2007]).categories


@query("post_overview_rows")
def _q(spark, d):
    """R1 with its breakdowns."""
    return rep.post_overview(_t(spark, d)).rows()


@query("category_overview_rows")
def _q(spark, d):
    return rep.category_overview(_t(spark, d)).rows()


@query("comment_overview_rows")
def _q(spark, d):
    return rep.comment_overview(_t(spark, d)).rows()


@query("comments_page_after")
def _q(spark, d):
    """P1 by key: the 20 comments that follow comment 500 in page order."""
    t = _t(spark, d)
    at = t.comments.where(F.col("id") == 500).select("created_at", "id").first()
    return flt.page_after(t.comments, (at["created_at"], at["id"]), 20)


@query("comment_responses")
def _q(spark, d):
    """P3 for every comment."""
    return flt.respond(_t(spark, d).comments, "comment")


@query("snapshot_posts")
def _q(spark, d):
    """The posts of a snapshot that was written and loaded again."""
    t = _t(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    save_tables(t, path)
    return flat(load_tables(spark, path).posts.select(*t.posts.columns))


# ------------------------------------------------------------ maintained statistics


def _after_batch(spark, d):
    """The statistics of the tables before a batch, refreshed by the batch alone:
    drafts of inactive authors are published, edited comments go, and every
    featured post gets a comment of its author."""
    t = _t(spark, d)
    at = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    idle = t.users.where(~F.col("is_active")).select(F.col("id").alias("author_id"))
    drafts = t.posts.where("status = 'draft'").join(idle, "author_id", "left_semi").select(*t.posts.columns)
    published = drafts.withColumns({"status": F.lit("published"), "view_count": F.col("view_count") + 5, "updated_at": at})
    written = t.posts.where("is_featured").select(
        (F.col("id") + 1_000_000_000).alias("id"), F.col("id").alias("post_id"), "author_id",
        F.lit(None).cast("bigint").alias("parent_id"), F.lit(3).alias("like_count"), at.alias("updated_at"),
    )
    kept = t.comments.where(~F.col("is_edited")).select(*mt.COMMENT_COLUMNS).unionByName(written)
    before = mt.build(t.posts, t.comments).stored()
    posts, comments = mt.Change(drafts, published), mt.Change(t.comments.where("is_edited"), written)
    return t, mt.refresh(before, posts, comments, kept)


@query("author_stats_after_batch")
def _q(spark, d):
    """A4 from maintained sums."""
    t, s = _after_batch(spark, d)
    return mt.author_stats(s, t.users)


@query("category_stats_after_batch")
def _q(spark, d):
    """A10-A13 from maintained sums."""
    t, s = _after_batch(spark, d)
    return mt.category_stats(s, t.categories)


@query("user_engagement_after_batch")
def _q(spark, d):
    """A14, A15 from maintained sums and latest updates."""
    t, s = _after_batch(spark, d)
    return mt.user_engagement(s, t.users, AS_OF)


# ------------------------------------------------------------ clustered tables


def _clustered(spark, df, key):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clustered-{uuid.uuid4().hex}"
    return clu.create(df, path, key, rows_per_range=20_000)


@query("comments_deep_page")
def _q(spark, d):
    """P1 by counted fences: the page in the middle of all comments."""
    t = _clustered(spark, _t(spark, d).comments, ["created_at", "id"])
    pages = -(-clu.count(t, spark) // 10)
    return clu.page(t, spark, max(1, pages // 2), 10)


@query("posts_lookup_clustered")
def _q(spark, d):
    """F1 on a clustered table: the posts that have comments."""
    t = _t(spark, d)
    return flat(clu.lookup(_clustered(spark, t.posts, ["id"]), t.comments.select(F.col("post_id").alias("id"))))


@query("posts_after_merges")
def _q(spark, d):
    """S3 in steps: featured posts are archived, then those of inactive authors go."""
    t = _t(spark, d)
    first = _clustered(spark, t.posts, ["id"])
    second = clu.merge(first, t.posts.where("is_featured").withColumn("status", F.lit("archived")))
    idle = t.users.where(~F.col("is_active")).select(F.col("id").alias("author_id"))
    third = clu.merge(second, deletes=t.posts.join(idle, "author_id", "left_semi").select("id"))
    return flat(clu.read(third, spark))
