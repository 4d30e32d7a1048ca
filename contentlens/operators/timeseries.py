"""Daily series over a date spine.

Each series is: filter the child table to the spine's date range (the
timestamp bounds reach the Parquet scan), reduce to one row per day (or per
key and day) with a partial aggregate, then left-join the pre-aggregate to
the spine so days without activity read 0.  The spine has ``days + 1`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import coalesce0, day_text
from contentlens.operators.categories import check_semantics
from contentlens.sources.spine import as_of_literal, date_spine


def _window(as_of, days: int) -> tuple[Column, Column]:
    """[start, end) timestamp bounds of the spine's calendar days."""
    end_day = F.to_date(as_of_literal(as_of))
    start = F.to_timestamp_ntz(F.date_sub(end_day, int(days)))
    end = F.to_timestamp_ntz(F.date_add(end_day, 1))
    return start, end


def _in_window(col: str, as_of, days: int) -> Column:
    start, end = _window(as_of, days)
    return (F.col(col) >= start) & (F.col(col) < end)


def new_users_daily(users: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Date (text), new_users, by date; every spine day present."""
    spark = users.sparkSession
    per_day = (
        users.where(_in_window("created_at", as_of, days))
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("new_users"))
    )
    return (
        date_spine(spark, as_of, days)
        .join(per_day, "date", "left")
        .select(day_text("date").alias("date"), coalesce0("new_users").alias("new_users"))
        .orderBy("date")
    )


def user_activity_timeline(
    users: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    as_of,
    days: int = 30,
    user_id=None,
    semantics: str = "true",
) -> DataFrame:
    """Per user and day: posts, comments, likes_given, likes_received.
    One user's series is ordered by date; the table of all users is left
    unordered (sort it when it is written, if a reader needs that).

    With ``user_id`` only that user (an unknown user yields no rows).  Each
    selected user gets ``days + 1`` rows from a per-row generator over its
    own date range, so no users x spine join is planned.  ``literal`` gives
    the reference's per-day fan-out sums (each post counted once per
    comment of the same day, and vice versa).
    """
    check_semantics(semantics)
    if user_id is not None:
        users = users.where(F.col("id") == F.lit(user_id))
        posts = posts.where(F.col("author_id") == F.lit(user_id))
        comments = comments.where(F.col("author_id") == F.lit(user_id))
    end_day = F.to_date(as_of_literal(as_of))
    grid = users.select(
        F.col("id").alias("user_id"),
        F.explode(F.sequence(F.date_sub(end_day, int(days)), end_day)).alias("date"),
    )
    p = (
        posts.where(_in_window("created_at", as_of, days))
        .groupBy(F.col("author_id").alias("user_id"), F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("p_n"), F.sum(F.col("like_count").cast("bigint")).alias("p_likes"))
    )
    c = (
        comments.where(_in_window("created_at", as_of, days))
        .groupBy(F.col("author_id").alias("user_id"), F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("c_n"), F.sum(F.col("like_count").cast("bigint")).alias("c_likes"))
    )
    j = grid.join(p, ["user_id", "date"], "left").join(c, ["user_id", "date"], "left")
    if semantics == "true":
        given, received = F.col("c_likes"), F.col("p_likes")
    else:
        one = F.lit(1).cast("bigint")
        given = F.col("c_likes") * F.greatest(coalesce0("p_n"), one)
        received = F.col("p_likes") * F.greatest(coalesce0("c_n"), one)
    out = j.select(
        "user_id",
        day_text("date").alias("date"),
        coalesce0("p_n").alias("posts"),
        coalesce0("c_n").alias("comments"),
        coalesce0(given).alias("likes_given"),
        coalesce0(received).alias("likes_received"),
    )
    return out if user_id is None else out.orderBy("date")


def category_growth(
    categories: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    as_of,
    days: int = 30,
    semantics: str = "true",
) -> DataFrame:
    """D3: per day new_posts, new_comments, new_views, new_likes over posts
    whose category exists, by date.  Views and likes are the counters of posts
    *created* that day; comments count by their own creation day.

    Comments are first reduced to (post, day) counts, so a post holding a
    third of all comments costs one row per map task before the shuffle.
    """
    check_semantics(semantics)
    spark = posts.sparkSession
    cat_ids = categories.select(F.col("id").alias("category_id"))
    categorised = posts.where(F.col("category_id").isNotNull()).join(cat_ids, "category_id", "left_semi")

    new_posts = categorised.where(_in_window("created_at", as_of, days)).select(
        "id", F.to_date("created_at").alias("date"), "view_count", "like_count"
    )
    if semantics == "literal":
        n_c = comments.groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("n_c"))
        w = F.greatest(coalesce0("n_c"), F.lit(1).cast("bigint"))
        new_posts = new_posts.join(n_c, "id", "left").withColumn("w", w)
    else:
        new_posts = new_posts.withColumn("w", F.lit(1).cast("bigint"))
    p = new_posts.groupBy("date").agg(
        F.count(F.lit(1)).alias("new_posts"),
        F.sum(F.col("view_count").cast("bigint") * F.col("w")).alias("new_views"),
        F.sum(F.col("like_count").cast("bigint") * F.col("w")).alias("new_likes"),
    )
    c = (
        comments.where(_in_window("created_at", as_of, days))
        .groupBy(F.col("post_id").alias("id"), F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(categorised.select("id"), "id", "left_semi")
        .groupBy("date")
        .agg(F.sum("n").alias("new_comments"))
    )
    return (
        date_spine(spark, as_of, days)
        .join(p, "date", "left")
        .join(c, "date", "left")
        .select(
            day_text("date").alias("date"),
            coalesce0("new_posts").alias("new_posts"),
            coalesce0("new_comments").alias("new_comments"),
            coalesce0("new_views").alias("new_views"),
            coalesce0("new_likes").alias("new_likes"),
        )
        .orderBy("date")
    )


def to_long(series: DataFrame, key_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Wide series -> long (key..., series, value), as the reference's four
    named lists."""
    return series.unpivot(key_cols, value_cols, "series", "value")
