"""Tiny literal frames with hand-computed answers (FIXTURES.md, unit frames)."""

from __future__ import annotations

import datetime as dt

from contentlens.sources.tables import ContentTables

D = dt.datetime

USERS = "id bigint, email string, username string, role string, is_active boolean, is_verified boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
CATS = "id int, name string, slug string, parent_id int, `order` int"
POSTS = (
    "id bigint, title string, content string, author_id bigint, status string, tags array<string>, "
    "category_id int, view_count int, like_count int, is_featured boolean, allow_comments boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
COMMENTS = (
    "id bigint, content string, author_id bigint, post_id bigint, parent_id bigint, is_edited boolean, "
    "like_count int, created_at timestamp_ntz, updated_at timestamp_ntz"
)
LIKES = "user_id bigint, comment_id bigint, created_at timestamp_ntz"


def user(i, role="user", created=D(2024, 1, 1), updated=None):
    return (i, f"u{i}@x.org", f"user{i}", role, True, False, created, updated)


def post(i, author, status="published", tags=("a",), cat=None, views=0, likes=0, created=D(2024, 1, 5), updated=None,
         title=None, featured=False, allow=True):
    return (i, title or f"post {i}", "body", author, status, list(tags) if tags is not None else None, cat, views,
            likes, featured, allow, created, updated)


def comment(i, author, post_id, parent=None, likes=0, created=D(2024, 1, 6), updated=None, content="hi"):
    return (i, content, author, post_id, parent, False, likes, created, updated)


def tables(spark, users=(), cats=(), posts=(), comments=(), likes=()) -> ContentTables:
    return ContentTables(
        users=spark.createDataFrame(list(users), USERS),
        categories=spark.createDataFrame(list(cats), CATS),
        posts=spark.createDataFrame(list(posts), POSTS),
        comments=spark.createDataFrame(list(comments), COMMENTS),
        comment_likes=spark.createDataFrame(list(likes), LIKES),
    )


def fanout(spark) -> ContentTables:
    """One user, 2 posts (likes 10, 20), 3 comments (likes 1, 2, 3)."""
    return tables(
        spark,
        users=[user(1), user(2)],
        cats=[(10, "c", "c", None, 0), (11, "empty", "empty", None, 1)],
        posts=[post(100, 1, likes=10, views=5, cat=10), post(101, 1, likes=20, views=7, cat=10, created=D(2024, 1, 6))],
        comments=[comment(1000, 1, 100, likes=1), comment(1001, 1, 100, likes=2), comment(1002, 1, 100, likes=3)],
    )
