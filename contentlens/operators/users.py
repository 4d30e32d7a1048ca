"""User statistics.

The reference joins users to posts *and* comments in one query, which
multiplies rows per user (|posts| x |comments|).  Here posts and comments are
each reduced to one row per author first and then joined 1:1 to users; the
reference's inflated sums (``semantics="literal"``) follow in closed form
from the same two pre-aggregates, so no cross product is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import elapsed_days
from contentlens.operators.categories import check_semantics
from contentlens.operators.preagg import comments_per_author, fetch_top, posts_per_author
from contentlens.schema import TOP_K_DEFAULT
from contentlens.sources.spine import as_of_literal

EPOCH = "1970-01-01 00:00:00"


def user_counts_by_role(users: DataFrame) -> DataFrame:
    """Role, user_count."""
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("user_count"))


def _activity(users: DataFrame, posts: DataFrame, comments: DataFrame, user_id=None) -> DataFrame:
    if user_id is not None:
        users = users.where(F.col("id") == F.lit(user_id))
        posts = posts.where(F.col("author_id") == F.lit(user_id))
        comments = comments.where(F.col("author_id") == F.lit(user_id))
    return (
        users.join(posts_per_author(posts), "id", "left")
        .join(comments_per_author(comments), "id", "left")
        .na.fill(0, ["p_n", "p_likes", "p_views", "c_n", "c_likes"])
    )


def _sums(semantics: str):
    """likes_given, likes_received, views_received for either semantics."""
    if semantics == "true":
        return F.col("c_likes"), F.col("p_likes"), F.col("p_views")
    wp = F.greatest(F.col("p_n"), F.lit(1).cast("bigint"))
    wc = F.greatest(F.col("c_n"), F.lit(1).cast("bigint"))
    return F.col("c_likes") * wp, F.col("p_likes") * wc, F.col("p_views") * wc


def user_activity(
    users: DataFrame, posts: DataFrame, comments: DataFrame, semantics: str = "true"
) -> DataFrame:
    """A14 before the cut: users.* with posts, comments, likes_given,
    likes_received.  ``likes_given`` keeps the reference's name but is the
    sum of like counters on the user's own comments."""
    check_semantics(semantics)
    given, received, _ = _sums(semantics)
    return _activity(users, posts, comments).select(
        *[F.col(f"`{c}`") for c in users.columns],
        F.col("p_n").alias("posts"),
        F.col("c_n").alias("comments"),
        given.alias("likes_given"),
        received.alias("likes_received"),
    )


def most_active_users(
    users: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    limit: int = TOP_K_DEFAULT,
    semantics: str = "true",
) -> DataFrame:
    """ORDER BY posts DESC, comments DESC (ties by id), top ``limit``.

    Ranked on the user key and the four numbers only; the user rows of the
    winners are fetched afterwards."""
    order = (F.desc("posts"), F.desc("comments"), F.col("id"))
    top = (
        user_activity(users.select("id"), posts, comments, semantics)
        .orderBy(*order)
        .limit(limit)
    )
    return fetch_top(users, top, order, limit).select(
        *[F.col(f"`{c}`") for c in users.columns], "posts", "comments", "likes_given", "likes_received"
    )


def user_engagement(
    users: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    as_of,
    semantics: str = "true",
    user_id=None,
) -> DataFrame:
    """A15 for every user (or one).

    days_since_last_activity measures from the latest *update* of the
    user's posts or comments, or from joining when nothing was updated.
    An unknown ``user_id`` yields one all-zero row, like the reference.
    """
    check_semantics(semantics)
    now = as_of_literal(as_of)
    epoch = F.to_timestamp_ntz(F.lit(EPOCH))
    given, received, views = _sums(semantics)
    last = F.greatest(
        F.coalesce("p_last_update", epoch), F.coalesce("c_last_update", epoch), F.col("created_at")
    )
    out = _activity(users, posts, comments, user_id).select(
        F.col("id").alias("user_id"),
        F.col("p_n").alias("total_posts"),
        F.col("c_n").alias("total_comments"),
        given.alias("total_likes_given"),
        received.alias("total_likes_received"),
        views.alias("total_views_received"),
        elapsed_days("created_at", now).alias("days_since_join"),
        elapsed_days(last, now).alias("days_since_last_activity"),
    )
    if user_id is None:
        return out
    # Unknown user: one zero row.  The single-row default is a literal, and
    # the anti join keeps it only when the lookup found nothing.
    spark = users.sparkSession
    zero = spark.range(1).select(*[
        F.lit(user_id if c == "user_id" else 0).cast(f.dataType).alias(c) for c, f in zip(out.columns, out.schema.fields)
    ])
    return out.unionByName(zero.join(out.select("user_id"), "user_id", "left_anti"))
