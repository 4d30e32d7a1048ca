"""Post statistics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import coalesce0
from contentlens.operators.preagg import fetch_top, posts_with_comment_counts
from contentlens.schema import STATUS_ARCHIVED, STATUS_DRAFT, STATUS_PUBLISHED, TOP_K_DEFAULT


def post_counts_by_status(posts: DataFrame) -> DataFrame:
    """A1: status, post_count (statuses without posts have no row)."""
    return posts.groupBy("status").agg(F.count(F.lit(1)).alias("post_count"))


def post_counts_by_category(posts: DataFrame) -> DataFrame:
    """A2: category_id, post_count, from the posts side: NULL is a group."""
    return posts.groupBy("category_id").agg(F.count(F.lit(1)).alias("post_count"))


def tag_counts(posts: DataFrame) -> DataFrame:
    """A3 without the cut: tag, count over exploded tags.

    A tag repeated inside one post counts twice; posts with no tags add
    nothing.  The explode feeds a partial aggregate, so only distinct tags
    per map task cross the shuffle.
    """
    return (
        posts.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def popular_tags(posts: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """A3 + T3: the ``limit`` most used tags (ties by tag)."""
    return tag_counts(posts).orderBy(F.desc("count"), "tag").limit(limit)


def author_stats(users: DataFrame, posts: DataFrame, comments: DataFrame, author_id=None) -> DataFrame:
    """A4 for every user (or one): post counts by status, counter sums and
    the number of comments on the author's posts; zeros for no posts."""
    per_post = posts_with_comment_counts(posts, comments, "author_id", "status", "view_count", "like_count")
    if author_id is not None:
        users = users.where(F.col("id") == F.lit(author_id))
        per_post = per_post.where(F.col("author_id") == F.lit(author_id))
    st = F.col("status")
    agg = per_post.groupBy(F.col("author_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.sum(F.col("view_count").cast("bigint")).alias("total_views"),
        F.sum(F.col("like_count").cast("bigint")).alias("total_likes"),
        F.sum("n_comments").alias("total_comments"),
        F.count_if(st == STATUS_DRAFT).alias("drafts"),
        F.count_if(st == STATUS_PUBLISHED).alias("published"),
        F.count_if(st == STATUS_ARCHIVED).alias("archived"),
    )
    out = users.select("id").join(agg, "id", "left")
    out = out.select(
        F.col("id").alias("author_id"),
        *[coalesce0(c).alias(c) for c in _A4_COLS],
    )
    if author_id is None:
        return out
    return with_zero_row(out, "author_id", author_id, _A4_COLS)


_A4_COLS = ("total_posts", "total_views", "total_likes", "total_comments", "drafts", "published", "archived")


def with_zero_row(stats: DataFrame, key: str, key_value, cols) -> DataFrame:
    """Single-key statistics: an unknown key yields one all-zero row (the
    reference aggregates over no rows), other keys their computed row."""
    spark = stats.sparkSession
    zero = spark.range(1).select(
        F.lit(key_value).cast(stats.schema[key].dataType).alias(key),
        *[F.lit(0).cast(stats.schema[c].dataType).alias(c) for c in cols],
    )
    return stats.unionByName(zero.join(stats.select(key), key, "left_anti"))


def comment_counts_by_post(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """A5 for every post: post_id, comment_count (0 if none)."""
    return posts_with_comment_counts(posts, comments).select(
        F.col("id").alias("post_id"), F.col("n_comments").alias("comment_count")
    )


def most_commented_posts(posts: DataFrame, comments: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """Posts with their comment_count, top ``limit`` (ties by id)."""
    per_post = comments.groupBy(F.col("post_id").alias("id")).agg(
        F.count(F.lit(1)).alias("comment_count")
    )
    order = (F.desc("comment_count"), F.col("id"))
    top = (
        posts.select("id")
        .join(per_post, "id", "left")
        .withColumn("comment_count", coalesce0("comment_count"))
        .orderBy(*order)
        .limit(limit)
    )
    return fetch_top(posts, top, order, limit)


def most_viewed_posts(posts: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """T1 (ties by id)."""
    return posts.orderBy(F.desc("view_count"), "id").limit(limit)


def most_liked_posts(posts: DataFrame, limit: int = TOP_K_DEFAULT) -> DataFrame:
    """T2 (ties by id)."""
    return posts.orderBy(F.desc("like_count"), "id").limit(limit)
