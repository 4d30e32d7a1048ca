"""Composed reports.

Each report is a dict of sections: a one-row ``totals`` frame plus the
breakdowns, built when a section is asked for (:class:`Report`).  Totals over several tables are one global aggregate over a
union of tagged rows, so no join (and no one-row cross product) is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.operators import categories as cat
from contentlens.operators import comments as com
from contentlens.operators import filters as flt
from contentlens.operators import hierarchy as hier
from contentlens.operators import posts as pst
from contentlens.functions.columns import coalesce0
from contentlens.operators.preagg import replies_per_comment
from contentlens.schema import PAGE_SIZE_DEFAULT, TOP_K_DEFAULT
from contentlens.sources.tables import ContentTables

class Report(Mapping):
    """Sections by name; a section's DataFrame is built at its first use, so
    asking for the totals does not run the depth rounds of another section."""

    def __init__(self, sections: dict[str, Callable[[], DataFrame]]):
        self._sections, self._built = sections, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._sections[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sections)

    def __len__(self) -> int:
        return len(self._sections)

    def rows(self) -> DataFrame:
        """All sections as one flat table: section, key, measure, value (one
        row for each number of a section's row)."""
        out = None
        for name in self:
            part = long_rows(name, self[name])
            out = part if out is None else out.unionByName(part)
        return out


# What names a section's row (the first one present), and its numbers.
KEYS = ("status", "category_id", "tag", "depth", "hour", "id", "author_id")
MEASURES = ("post_count", "count", "category_count", "comment_count", "like_count", "reply_count", "posts", "views", "comments", "likes")


def long_rows(section: str, df: DataFrame) -> DataFrame:
    key = next((F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS if c in df.columns), F.lit(""))
    numbers = [c for c in df.columns if c in MEASURES or c.startswith("total_")]
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in numbers])
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(pairs))


def _zero():
    return F.lit(0).cast("bigint")


def _one():
    return F.lit(1).cast("bigint")


def post_totals(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """R1 scalar part: total_posts, total_views, total_likes, total_comments
    over the whole tables (the reference stops at 100 rows and reports 0
    comments)."""
    rows = posts.select(
        _one().alias("p"), F.col("view_count").cast("bigint").alias("v"),
        F.col("like_count").cast("bigint").alias("l"), _zero().alias("c"),
    ).unionByName(comments.select(_zero().alias("p"), _zero().alias("v"), _zero().alias("l"), _one().alias("c")))
    return rows.agg(
        F.sum("p").alias("total_posts"),
        F.coalesce(F.sum("v"), _zero()).alias("total_views"),
        F.coalesce(F.sum("l"), _zero()).alias("total_likes"),
        F.sum("c").alias("total_comments"),
    ).na.fill(0)


def post_overview(t: ContentTables, top: int = TOP_K_DEFAULT) -> Report:
    """R1."""
    return Report({
        "totals": lambda: post_totals(t.posts, t.comments),
        "by_status": lambda: pst.post_counts_by_status(t.posts),
        "by_category": lambda: pst.post_counts_by_category(t.posts),
        "popular_tags": lambda: pst.popular_tags(t.posts, top),
    })


def category_totals(categories: DataFrame, posts: DataFrame) -> DataFrame:
    """R2 scalar part: total_categories, total_posts and total_views of
    posts whose category exists (sums of A10 and A11)."""
    ids = categories.select(F.col("id").alias("category_id"))
    categorised = posts.where(F.col("category_id").isNotNull()).join(ids, "category_id", "left_semi")
    rows = categories.select(_one().alias("c"), _zero().alias("p"), _zero().alias("v")).unionByName(
        categorised.select(_zero().alias("c"), _one().alias("p"), F.col("view_count").cast("bigint").alias("v"))
    )
    return rows.agg(
        F.sum("c").alias("total_categories"),
        F.sum("p").alias("total_posts"),
        F.coalesce(F.sum("v"), _zero()).alias("total_views"),
    ).na.fill(0)


def category_overview(t: ContentTables, top: int = TOP_K_DEFAULT, semantics: str = "true") -> Report:
    """R2."""
    return Report({
        "totals": lambda: category_totals(t.categories, t.posts),
        "by_depth": lambda: hier.depth_stats(t.categories),
        "most_active": lambda: cat.most_active_categories(t.categories, t.posts, t.comments, top, semantics),
    })


def comment_totals(comments: DataFrame) -> DataFrame:
    """R3 scalar part."""
    return comments.agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.count_if(F.col("parent_id").isNull()).alias("total_root_comments"),
        F.count_if(F.col("parent_id").isNotNull()).alias("total_replies"),
        F.coalesce(F.sum(F.col("like_count").cast("bigint")), _zero()).alias("total_likes"),
    )


def comment_overview(t: ContentTables, top: int = TOP_K_DEFAULT) -> Report:
    """R3."""
    return Report({
        "totals": lambda: comment_totals(t.comments),
        "by_hour": lambda: com.comments_by_hour(t.comments),
        "top_commenters": lambda: com.top_commenters(t.comments, top),
        "most_liked": lambda: com.most_liked_comments(t.comments, top),
        "most_replied": lambda: com.most_replied_comments(t.comments, top),
    })


def list_categories(
    categories: DataFrame, posts: DataFrame, parent_id=None, page: int = 1, size: int = PAGE_SIZE_DEFAULT
) -> dict[str, DataFrame]:
    """Roots (or children of ``parent_id``) with post_count, paged."""
    rows = flt.root_categories(categories) if parent_id is None else flt.children(categories, parent_id)
    items = flt.page(rows, page, size, order=("order", "id"))
    # only posts of the page's categories (at most a page of ids) are counted
    own = posts.join(items.select(F.col("id").alias("category_id")), "category_id", "left_semi")
    return {
        "items": cat.with_post_count(items, own).orderBy("order", "id").limit(size),
        "page_info": flt.page_info(rows, page, size),
    }


def list_comments(
    comments: DataFrame, post_id, parent_id=None, page: int = 1, size: int = PAGE_SIZE_DEFAULT
) -> dict[str, DataFrame]:
    """Root comments of a post (or replies of ``parent_id``) with
    reply_count, paged."""
    rows = flt.root_comments(comments, post_id) if parent_id is None else flt.replies(comments, parent_id)
    items = flt.page(rows, page, size)
    # only replies to the page's comments (at most a page of ids) are counted
    own = comments.join(items.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    items = items.join(replies_per_comment(own), "id", "left").withColumn("reply_count", coalesce0("reply_count"))
    return {
        "items": items.orderBy(*flt.PAGE_ORDER).limit(size),
        "page_info": flt.page_info(rows, page, size),
    }
