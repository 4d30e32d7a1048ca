"""Lookups, listings and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.functions.columns import tag_contains, title_matches
from contentlens.functions.visibility import Viewer, visible_in_listing, visible_single
from contentlens.operators.skew import split_left_join
from contentlens.schema import PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX, RESPONSE_COLUMNS, STATUS_PUBLISHED

PAGE_ORDER = ("created_at", "id")


# ---------------------------------------------------------------- lookups


def lookup(df: DataFrame, keys, on: str | Sequence[str] = "id") -> DataFrame:
    """Rows whose key is in ``keys``.

    ``keys`` is a scalar or a list of scalars / tuples (an IN predicate, which
    reaches the scan), or a DataFrame of key columns (bulk lookup, a left
    semi join).
    """
    cols = [on] if isinstance(on, str) else list(on)
    if isinstance(keys, DataFrame):
        return df.join(keys.select(*cols).distinct(), cols, "left_semi")
    if not isinstance(keys, (list, tuple, set)) or (
        len(cols) > 1 and keys and not isinstance(next(iter(keys)), (list, tuple))
    ):
        keys = [keys]
    keys = list(keys)
    if len(cols) == 1:
        return df.where(F.col(cols[0]).isin(keys))
    if not keys:
        return df.where(F.lit(False))
    cond = F.struct(*cols).isin([F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(cols, key))) for key in keys])
    for i, c in enumerate(cols):  # each column alone, for the scan
        cond = cond & F.col(c).isin([key[i] for key in keys])
    return df.where(cond)


def by_id(df: DataFrame, ids) -> DataFrame:
    return lookup(df, ids, "id")


def by_slug(categories: DataFrame, slug) -> DataFrame:
    return lookup(categories, slug, "slug")


def by_email(users: DataFrame, email) -> DataFrame:
    return lookup(users, email, "email")


def by_username(users: DataFrame, username) -> DataFrame:
    return lookup(users, username, "username")


def like_by_user_and_comment(likes: DataFrame, user_id, comment_id) -> DataFrame:
    return lookup(likes, [(user_id, comment_id)], ["user_id", "comment_id"])


# ---------------------------------------------------------------- paging


def check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= size <= PAGE_SIZE_MAX:
        raise ValueError(f"size must be within 1..{PAGE_SIZE_MAX}")


def page(
    df: DataFrame,
    page: int = 1,
    size: int = PAGE_SIZE_DEFAULT,
    order: Sequence[str | Column] = PAGE_ORDER,
) -> DataFrame:
    """One page in a total order (the key columns close every tie).

    Planned as a top-(page*size) per partition plus one merge
    (TakeOrderedAndProject with an offset), never a full sort.
    """
    check_page(page, size)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, after: tuple | None, size: int = PAGE_SIZE_DEFAULT) -> DataFrame:
    """P1 by key: the ``size`` rows that follow ``after = (created_at, id)``
    in page order (the first page when ``None``).

    Same rows as :func:`page` for the page after the one ending at
    ``after``, but every page costs a filter plus a top-``size``, however
    deep the listing goes; OFFSET paging has to rank ``page * size`` rows.
    """
    check_page(1, size)
    rows = df
    if after is not None:
        ts, key = after
        at = F.lit(ts).cast(df.schema["created_at"].dataType)
        rows = df.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > F.lit(key))))
    return rows.orderBy(*PAGE_ORDER).limit(size)


def page_info(df: DataFrame, page: int = 1, size: int = PAGE_SIZE_DEFAULT) -> DataFrame:
    """Paging envelope over the *unsliced* filtered rows."""
    check_page(page, size)
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        F.ceil(F.col("total") / F.lit(size)).cast("bigint").alias("pages"),
    )


def respond(df: DataFrame, shape: str) -> DataFrame:
    """Project ``df`` to a response shape (columns the frame lacks are
    skipped, so fixture tables without optional columns still work)."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in RESPONSE_COLUMNS[shape] if c in have])


# ---------------------------------------------------------------- F5-F20


def children(categories: DataFrame, parent_id) -> DataFrame:
    """F5 (F6 with :func:`page`)."""
    return categories.where(F.col("parent_id") == F.lit(parent_id))


def root_categories(categories: DataFrame) -> DataFrame:
    """F7."""
    return categories.where(F.col("parent_id").isNull())


def posts_by_author(posts: DataFrame, author_id) -> DataFrame:
    """F8."""
    return posts.where(F.col("author_id") == F.lit(author_id))


def posts_by_category(posts: DataFrame, category_id) -> DataFrame:
    """direct category only."""
    return posts.where(F.col("category_id") == F.lit(category_id))


def posts_by_status(posts: DataFrame, status: str) -> DataFrame:
    """F10."""
    return posts.where(F.col("status") == F.lit(status))


def featured_posts(posts: DataFrame) -> DataFrame:
    """F11."""
    return posts.where(F.col("is_featured"))


def search_title(posts: DataFrame, query: str) -> DataFrame:
    """case-insensitive substring (wildcards in ``query`` kept)."""
    return posts.where(title_matches(query))


def search_tag(posts: DataFrame, tag: str) -> DataFrame:
    """exact, case-sensitive tag containment."""
    return posts.where(tag_contains(tag))


def comments_by_post(comments: DataFrame, post_id) -> DataFrame:
    """F14."""
    return comments.where(F.col("post_id") == F.lit(post_id))


def comments_by_author(comments: DataFrame, author_id) -> DataFrame:
    """F15."""
    return comments.where(F.col("author_id") == F.lit(author_id))


def replies(comments: DataFrame, parent_id) -> DataFrame:
    """F16: direct replies only."""
    return comments.where(F.col("parent_id") == F.lit(parent_id))


def root_comments(comments: DataFrame, post_id) -> DataFrame:
    """F17."""
    return comments.where((F.col("post_id") == F.lit(post_id)) & F.col("parent_id").isNull())


def likes_by_comment(likes: DataFrame, comment_id) -> DataFrame:
    """F19."""
    return likes.where(F.col("comment_id") == F.lit(comment_id))


def likes_by_user(likes: DataFrame, user_id) -> DataFrame:
    """F20."""
    return likes.where(F.col("user_id") == F.lit(user_id))


# ---------------------------------------------------------------- F21/F22


def filter_posts(
    posts: DataFrame,
    viewer: Viewer | None = None,
    status: str | None = None,
    category_id=None,
    author_id=None,
    tag: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """F21 without paging: visibility rule, then every given filter ANDed.

    Anonymous callers are pinned to published posts; a non-admin user is
    pinned to own posts and asking for someone else's is an error.
    """
    if viewer is None:
        status = STATUS_PUBLISHED
    elif not viewer.is_admin:
        if author_id is not None and author_id != viewer.id:
            raise ValueError("a non-admin viewer can only list own posts")
        author_id = viewer.id
    cond = visible_in_listing(viewer)
    if search:
        cond = cond & title_matches(search)
    if tag:
        cond = cond & tag_contains(tag)
    if status:
        cond = cond & (F.col("status") == F.lit(status))
    if category_id is not None:
        cond = cond & (F.col("category_id") == F.lit(category_id))
    if author_id is not None:
        cond = cond & (F.col("author_id") == F.lit(author_id))
    return posts.where(cond)


def list_posts(
    posts: DataFrame,
    viewer: Viewer | None = None,
    page_no: int = 1,
    size: int = PAGE_SIZE_DEFAULT,
    **filters,
) -> tuple[DataFrame, DataFrame]:
    """F21 + P1 + P2: (items, page_info)."""
    rows = filter_posts(posts, viewer, **filters)
    return page(rows, page_no, size), page_info(rows, page_no, size)


def visible_posts_for(posts: DataFrame, viewer: Viewer | None) -> DataFrame:
    """F22 single-post rule applied to a set of posts for one viewer."""
    return posts.where(visible_single(viewer))


def visibility_of_requests(posts: DataFrame, requests: DataFrame, split_hot: bool = False) -> DataFrame:
    """F22 in bulk: ``requests(viewer_id, viewer_role, post_id)`` joined to
    posts on ``post_id`` (an equi join, never viewers x posts); NULL viewer
    means anonymous.  Unknown posts get ``found = false``.  ``split_hot`` counts
    the requests of each post first and keeps those of hot posts out of the shuffle."""
    p = posts.select(
        F.col("id").alias("__pid"), "author_id", "status", F.lit(True).alias("found")
    )
    if split_hot:
        r = split_left_join(requests, p, "post_id", "__pid")
    else:
        r = requests.join(p, F.col("post_id") == F.col("__pid"), "left")
    published = F.col("status") == STATUS_PUBLISHED
    allowed = published | (F.col("viewer_id").isNotNull() & (
        (F.col("viewer_id") == F.col("author_id")) | (F.col("viewer_role") == "admin")
    ))
    return r.select(
        *requests.columns,
        F.coalesce("found", F.lit(False)).alias("found"),
        (F.coalesce("found", F.lit(False)) & F.coalesce(allowed, F.lit(False))).alias("visible"),
    )
