"""Declared schemas of the five content tables and the fixed enum values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference model (enums are lower case).
POST_STATUSES = ("draft", "published", "archived")
USER_ROLES = ("admin", "user")
STATUS_DRAFT, STATUS_PUBLISHED, STATUS_ARCHIVED = POST_STATUSES
ROLE_ADMIN, ROLE_USER = USER_ROLES

# Fixed field limits of the request schemas (inclusive bounds).
USERNAME_LEN = (3, 50)
FULL_NAME_MAX = 100
CATEGORY_NAME_LEN = (1, 100)
CATEGORY_SLUG_LEN = (1, 100)
CATEGORY_DESCRIPTION_MAX = 500
SLUG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
POST_TITLE_LEN = (1, 255)
POST_EXCERPT_MAX = 500
COMMENT_CONTENT_LEN = (1, 1000)
# Simplified address shape: one "@", no spaces, a dot in the domain part.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# Paging defaults of the listing endpoints.
PAGE_SIZE_DEFAULT = 10
PAGE_SIZE_MAX = 100
TOP_K_DEFAULT = 10

TS = T.TimestampNTZType()

USERS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("email", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("bio", T.StringType()),
        T.StructField("avatar_url", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("is_verified", T.BooleanType()),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
    ]
)

CATEGORIES = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
    ]
)

POSTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("excerpt", T.StringType()),
        T.StructField("featured_image", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("view_count", T.IntegerType()),
        T.StructField("like_count", T.IntegerType()),
        T.StructField("is_featured", T.BooleanType()),
        T.StructField("allow_comments", T.BooleanType()),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
    ]
)

COMMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("post_id", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("is_edited", T.BooleanType()),
        T.StructField("like_count", T.IntegerType()),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
    ]
)

COMMENT_LIKES = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("comment_id", T.LongType()),
        T.StructField("created_at", TS),
    ]
)

TABLE_SCHEMAS = {
    "users": USERS,
    "categories": CATEGORIES,
    "posts": POSTS,
    "comments": COMMENTS,
    "comment_likes": COMMENT_LIKES,
}

# Columns of each response shape (listing items), in output order.
RESPONSE_COLUMNS = {
    "post": (
        "id", "title", "content", "excerpt", "featured_image", "tags", "category_id", "is_featured",
        "allow_comments", "author_id", "status", "view_count", "like_count", "created_at", "updated_at",
    ),
    "category": (
        "id", "name", "slug", "description", "parent_id", "order", "created_at", "updated_at", "post_count",
    ),
    "comment": (
        "id", "content", "parent_id", "post_id", "author_id", "created_at", "updated_at", "is_edited",
        "like_count", "reply_count",
    ),
    "user": ("id", "email", "username", "full_name", "bio", "avatar_url", "role", "is_active", "is_verified",
             "created_at", "updated_at"),
}
