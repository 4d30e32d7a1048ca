"""Category statistics.

One per-category aggregate is built from posts and per-post comment counts
and shared by the four statistics; the categories table is then left-joined
to it so empty categories get zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import coalesce0
from contentlens.operators.preagg import posts_with_comment_counts
from contentlens.schema import TOP_K_DEFAULT

SEMANTICS = ("true", "literal")


def check_semantics(semantics: str) -> None:
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")


def category_activity(posts: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """category_id -> posts, views, likes[, comments, views_literal, likes_literal].

    ``*_literal`` are the sums the reference's posts-x-comments join returns:
    each post's counter counted once per comment of the post (at least once).
    """
    if comments is None:
        return (
            posts.where(F.col("category_id").isNotNull())
            .groupBy(F.col("category_id").alias("id"))
            .agg(
                F.count(F.lit(1)).alias("posts"),
                F.sum(F.col("view_count").cast("bigint")).alias("views"),
                F.sum(F.col("like_count").cast("bigint")).alias("likes"),
            )
        )
    per_post = posts_with_comment_counts(
        posts.where(F.col("category_id").isNotNull()),
        comments,
        "category_id",
        "view_count",
        "like_count",
    )
    weight = F.greatest(F.col("n_comments"), F.lit(1).cast("bigint"))
    views = F.col("view_count").cast("bigint")
    likes = F.col("like_count").cast("bigint")
    return per_post.groupBy(F.col("category_id").alias("id")).agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum(views).alias("views"),
        F.sum(likes).alias("likes"),
        F.sum("n_comments").alias("comments"),
        F.sum(views * weight).alias("views_literal"),
        F.sum(likes * weight).alias("likes_literal"),
    )


def category_post_counts(categories: DataFrame, posts: DataFrame) -> DataFrame:
    """A10: every category, direct posts (0 if none)."""
    act = category_activity(posts)
    return categories.select("id").join(act, "id", "left").select(
        "id", coalesce0("posts").alias("post_count")
    )


def with_post_count(categories: DataFrame, posts: DataFrame) -> DataFrame:
    """Categories with a ``post_count`` column."""
    act = category_activity(posts).select("id", "posts")
    return categories.join(act, "id", "left").withColumn("post_count", coalesce0("posts")).drop("posts")


def category_view_counts(categories: DataFrame, posts: DataFrame) -> DataFrame:
    """Every category, sum of its posts' views (0 if none)."""
    act = category_activity(posts)
    return categories.select("id").join(act, "id", "left").select(
        "id", coalesce0("views").alias("view_count")
    )


def category_comment_counts(categories: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Every category, comments on its posts (0 if none)."""
    act = category_activity(posts, comments)
    return categories.select("id").join(act, "id", "left").select(
        "id", coalesce0("comments").alias("comment_count")
    )


def category_stats(
    categories: DataFrame, posts: DataFrame, comments: DataFrame, semantics: str = "true"
) -> DataFrame:
    """A13 before the cut: categories.* with posts, views, comments, likes."""
    check_semantics(semantics)
    act = category_activity(posts, comments)
    v, lk = ("views", "likes") if semantics == "true" else ("views_literal", "likes_literal")
    return categories.join(act.select("id", "posts", "comments", v, lk), "id", "left").select(
        *[F.col(f"`{c}`") for c in categories.columns],
        coalesce0("posts").alias("posts"),
        coalesce0(v).alias("views"),
        coalesce0("comments").alias("comments"),
        coalesce0(lk).alias("likes"),
    )


def most_active_categories(
    categories: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    limit: int = TOP_K_DEFAULT,
    semantics: str = "true",
) -> DataFrame:
    """ORDER BY posts DESC, views DESC (ties by id), top ``limit``."""
    return (
        category_stats(categories, posts, comments, semantics)
        .orderBy(F.desc("posts"), F.desc("views"), "id")
        .limit(limit)
    )
