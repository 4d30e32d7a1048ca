"""Shared pre-aggregates.

Every statistic that combines two child tables of one parent (posts and
comments of a user, comments of a category's posts) first reduces each child
to one row per join key.  Spark runs these group-bys with a map-side partial
aggregate, so a hot key (one post holding a third of all comments) is
combined inside every map task before the shuffle, and the joins that follow
see at most one row per key on each side: no fan-out, no skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comments_per_post(comments: DataFrame) -> DataFrame:
    """post_id, n_comments."""
    return comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_comments"))


def replies_per_comment(comments: DataFrame) -> DataFrame:
    """comment id (as ``id``), reply_count: direct replies."""
    return (
        comments.where(F.col("parent_id").isNotNull())
        .groupBy(F.col("parent_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("reply_count"))
    )


def likes_per_comment(likes: DataFrame) -> DataFrame:
    """comment_id, like_rows: rows of the like bridge table per comment."""
    return likes.groupBy("comment_id").agg(F.count(F.lit(1)).alias("like_rows"))


def posts_per_author(posts: DataFrame) -> DataFrame:
    """author_id (as ``id``) with post counts and counter sums."""
    return posts.groupBy(F.col("author_id").alias("id")).agg(
        F.count(F.lit(1)).alias("p_n"),
        F.sum(F.col("like_count").cast("bigint")).alias("p_likes"),
        F.sum(F.col("view_count").cast("bigint")).alias("p_views"),
        F.max("updated_at").alias("p_last_update"),
    )


def comments_per_author(comments: DataFrame) -> DataFrame:
    """author_id (as ``id``) with comment counts and like sums."""
    return comments.groupBy(F.col("author_id").alias("id")).agg(
        F.count(F.lit(1)).alias("c_n"),
        F.sum(F.col("like_count").cast("bigint")).alias("c_likes"),
        F.max("updated_at").alias("c_last_update"),
    )


def posts_with_comment_counts(posts: DataFrame, comments: DataFrame, *cols: str) -> DataFrame:
    """Posts (selected columns) with ``n_comments`` (0 when none).

    The right side is already one row per post, so the join is 1:1 and
    AQE can split a skewed partition without multiplying rows.
    """
    keep = ["id", *[c for c in cols if c != "id"]]
    per_post = comments_per_post(comments).withColumnRenamed("post_id", "id")
    return posts.select(*keep).join(per_post, "id", "left").withColumn(
        "n_comments", F.coalesce("n_comments", F.lit(0).cast("bigint"))
    )


def fetch_top(table: DataFrame, top: DataFrame, order, limit: int, key: str = "id") -> DataFrame:
    """Late materialisation for top-k: ``top`` is the ranked key list (at
    most ``limit`` rows); the wide rows of ``table`` are fetched by a join on
    the key instead of being shuffled through the ranking, and put in order
    by a top-``limit``, which needs no range exchange."""
    return table.join(top, key).orderBy(*order).limit(limit)
