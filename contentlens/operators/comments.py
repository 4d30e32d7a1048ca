"""Comment statistics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import coalesce0, round_ratio_half_up
from contentlens.operators.posts import with_zero_row
from contentlens.operators.preagg import fetch_top, likes_per_comment, replies_per_comment
from contentlens.schema import TOP_K_DEFAULT


def with_reply_count(comments: DataFrame) -> DataFrame:
    """Every comment with its number of direct replies (0 if none).

    One grouped count and one left join replace the per-comment query loop.
    """
    return comments.join(replies_per_comment(comments), "id", "left").withColumn(
        "reply_count", coalesce0("reply_count")
    )


def comment_stats_by_author(users: DataFrame, comments: DataFrame, author_id=None) -> DataFrame:
    """A7 for every user (or one): total_comments, total_replies,
    total_likes_received, average_likes_per_comment (half-up, 2 places)."""
    if author_id is not None:
        users = users.where(F.col("id") == F.lit(author_id))
        comments = comments.where(F.col("author_id") == F.lit(author_id))
    agg = comments.groupBy(F.col("author_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("parent_id").isNotNull()).alias("total_replies"),
        F.sum(F.col("like_count").cast("bigint")).alias("likes"),
        F.count("like_count").alias("n_likes"),
    )
    out = users.select("id").join(agg, "id", "left")
    out = out.select(
        F.col("id").alias("author_id"),
        coalesce0("n").alias("total_comments"),
        coalesce0("total_replies").alias("total_replies"),
        coalesce0("likes").alias("total_likes_received"),
        F.coalesce(round_ratio_half_up("likes", "n_likes", 2), F.lit(0.0)).alias(
            "average_likes_per_comment"
        ),
    )
    if author_id is None:
        return out
    return with_zero_row(
        out, "author_id", author_id,
        ("total_comments", "total_replies", "total_likes_received", "average_likes_per_comment"),
    )


def comments_by_hour(comments: DataFrame) -> DataFrame:
    """Hour of day (session time zone) -> comment_count, by hour; empty hours absent."""
    return comments.groupBy(F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("comment_count")
    ).orderBy("hour")


def likes_count_by_comment(likes: DataFrame) -> DataFrame:
    """comment_id, like_count from the bridge table."""
    return likes_per_comment(likes).withColumnRenamed("like_rows", "like_count")


def top_commenters(comments: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """T4: author_id, comment_count (ties by author_id)."""
    return (
        comments.groupBy("author_id")
        .agg(F.count(F.lit(1)).alias("comment_count"))
        .orderBy(F.desc("comment_count"), "author_id")
        .limit(limit)
    )


def top_commented_posts(comments: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """T5: post_id, comment_count from the comments side (ties by post_id)."""
    return (
        comments.groupBy("post_id")
        .agg(F.count(F.lit(1)).alias("comment_count"))
        .orderBy(F.desc("comment_count"), "post_id")
        .limit(limit)
    )


def most_liked_comments(comments: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """Order like_count desc, then created_at, id."""
    return comments.orderBy(F.desc("like_count"), "created_at", "id").limit(limit)


def most_replied_comments(comments: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """Root comments with at least one reply, most replies first (ties by id)."""
    roots = comments.where(F.col("parent_id").isNull())
    order = (F.desc("reply_count"), F.col("id"))
    top = (
        roots.select("id")
        .join(replies_per_comment(comments), "id", "inner")
        .orderBy(*order)
        .limit(limit)
    )
    return fetch_top(roots, top, order, limit)


def like_count_drift(comments: DataFrame, likes: DataFrame) -> DataFrame:
    """W4 check: comments whose stored like_count differs from the rows in
    the like table: id, like_count, actual_likes, drift."""
    actual = likes_per_comment(likes).withColumnRenamed("comment_id", "id")
    return (
        comments.select("id", "like_count")
        .join(actual, "id", "left")
        .select(
            "id",
            "like_count",
            coalesce0("like_rows").alias("actual_likes"),
            (F.col("like_count").cast("bigint") - coalesce0("like_rows")).alias("drift"),
        )
        .where(F.col("drift") != 0)
    )


def reconcile_like_counts(comments: DataFrame, likes: DataFrame) -> DataFrame:
    """W4 repair: comments with like_count set to the rows in the like table."""
    actual = likes_per_comment(likes).withColumnRenamed("comment_id", "id")
    cols = [
        coalesce0("like_rows", "int").alias("like_count") if c == "like_count" else F.col(c)
        for c in comments.columns
    ]
    return comments.join(actual, "id", "left").select(*cols)
