"""Statistics kept up to date from change batches.

The statistics are sums over posts and comments, by author and by category.  A
change of a row is its old image taken away and its new image added, so a batch
of inserts, updates and deletes becomes a few signed sums per key:

* comments change the number of comments of their posts and their author's sums;
* a post that changed, or whose number of comments did, takes its old share out
  of its author's and its category's sums and puts its new share in.

Four summaries are kept, each with one row per key: ``posts`` (the columns that
sums need and the number of comments), ``authors``, ``commenters`` and
``categories``.  A batch reads the keys that it touches; nothing else is
recomputed.  The one figure that is no sum, an author's latest update, is taken
anew from the summary of posts (from the comments) for those authors alone whose
latest row was changed.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.functions.columns import coalesce0, elapsed_days, round_ratio_half_up
from contentlens.operators.users import EPOCH
from contentlens.schema import STATUS_ARCHIVED, STATUS_DRAFT, STATUS_PUBLISHED
from contentlens.session import stored
from contentlens.sources.spine import as_of_literal

POST_COLUMNS = ("id", "author_id", "category_id", "status", "view_count", "like_count", "updated_at")
COMMENT_COLUMNS = ("id", "post_id", "author_id", "parent_id", "like_count", "updated_at")

AUTHOR_SUMS = ("n", "views", "likes", "comments", "drafts", "published", "archived")
COMMENTER_SUMS = ("n", "replies", "likes", "n_likes")
CATEGORY_SUMS = ("n", "views", "likes", "comments", "views_literal", "likes_literal")


@dataclass(frozen=True)
class Change:
    """A batch's rows of one table: ``old`` images (of updated and deleted rows)
    and ``new`` images (of inserted and updated rows)."""

    old: DataFrame
    new: DataFrame


@dataclass(frozen=True)
class Summaries:
    posts: DataFrame
    authors: DataFrame
    commenters: DataFrame
    categories: DataFrame

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("errorifexists").parquet(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Summaries:
        return Summaries(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(Summaries)])

    def stored(self) -> Summaries:
        return Summaries(*[stored(getattr(self, f.name), f"summary-{f.name}") for f in fields(self)])


def _long(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))


def _signed(change: Change, columns: tuple[str, ...]) -> DataFrame:
    rows = [df.select(*columns, F.lit(s).cast("bigint").alias("sign")) for df, s in ((change.old, -1), (change.new, 1))]
    return rows[0].unionByName(rows[1])


def _author_shares(posts: DataFrame) -> DataFrame:
    """Signed sums by author of posts with ``sign`` and ``n_comments``."""
    s, one = F.col("sign"), F.lit(0).cast("bigint")
    of = lambda status: F.sum(F.when(F.col("status") == status, s).otherwise(one))
    return posts.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(
        F.sum("sign").alias("n"), F.sum(s * _long("view_count")).alias("views"), F.sum(s * _long("like_count")).alias("likes"),
        F.sum(s * F.col("n_comments")).alias("comments"),
        of(STATUS_DRAFT).alias("drafts"), of(STATUS_PUBLISHED).alias("published"), of(STATUS_ARCHIVED).alias("archived"),
    )


def _category_shares(posts: DataFrame) -> DataFrame:
    s, weight = F.col("sign"), F.greatest(F.col("n_comments"), F.lit(1).cast("bigint"))
    return posts.where("category_id IS NOT NULL").groupBy(F.col("category_id").alias("id")).agg(
        F.sum("sign").alias("n"), F.sum(s * _long("view_count")).alias("views"), F.sum(s * _long("like_count")).alias("likes"),
        F.sum(s * F.col("n_comments")).alias("comments"),
        F.sum(s * _long("view_count") * weight).alias("views_literal"), F.sum(s * _long("like_count") * weight).alias("likes_literal"),
    )


def _commenter_shares(comments: DataFrame) -> DataFrame:
    s, none = F.col("sign"), F.lit(0).cast("bigint")
    return comments.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(
        F.sum("sign").alias("n"), F.sum(F.when(F.col("parent_id").isNotNull(), s).otherwise(none)).alias("replies"),
        F.sum(s * _long("like_count")).alias("likes"), F.sum(F.when(F.col("like_count").isNotNull(), s).otherwise(none)).alias("n_likes"),
    )


def _latest(rows: DataFrame) -> DataFrame:
    return rows.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(F.max("updated_at").alias("last_update"))


def build(posts: DataFrame, comments: DataFrame) -> Summaries:
    """The summaries of whole tables."""
    per_post = comments.where("post_id IS NOT NULL").groupBy(F.col("post_id").alias("id")).agg(F.count(F.lit(1)).alias("n_comments"))
    kept = posts.select(*POST_COLUMNS).join(per_post, "id", "left").withColumn("n_comments", coalesce0("n_comments"))
    signed = kept.withColumn("sign", F.lit(1).cast("bigint"))
    own = comments.select(*COMMENT_COLUMNS).withColumn("sign", F.lit(1).cast("bigint"))
    return Summaries(
        kept,
        _author_shares(signed).join(_latest(kept), "id"),
        _commenter_shares(own).join(_latest(own), "id"),
        _category_shares(signed),
    )


def _added(summary: DataFrame, shares: DataFrame, sums: tuple[str, ...], latest: DataFrame | None = None) -> DataFrame:
    """``summary`` with signed ``shares`` added; keys without rows go.  ``latest``
    (id, last_update) holds what the touched keys' figure now is."""
    change = shares.select("id", *[F.col(c).alias(f"__d_{c}") for c in sums], F.lit(True).alias("__hit"))
    both = summary.join(change, "id", "full")
    cols = [(coalesce0(c) + coalesce0(f"__d_{c}")).alias(c) for c in sums]
    if latest is not None:
        both = both.join(latest.select("id", F.col("last_update").alias("__last")), "id", "left")
        cols.append(F.when(F.col("__hit"), F.col("__last")).otherwise(F.col("last_update")).alias("last_update"))
    return both.select("id", *cols).where("n > 0")


def _latest_of_touched(summary: DataFrame, signed: DataFrame, every: DataFrame) -> DataFrame:
    """(id, last_update) after the batch of each author in ``signed``: the larger of
    the old figure and the new rows', unless a row with the old figure went;
    then it is taken from ``every`` row of these authors."""
    when = lambda sign: F.max(F.when(F.col("sign") == sign, F.col("updated_at")))
    touched = signed.where("author_id IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(when(-1).alias("gone"), when(1).alias("came"))
    known = stored(touched.join(summary.select("id", "last_update"), "id", "left"), "touched")
    back = F.coalesce(F.col("came") >= F.col("gone"), F.lit(False))
    lost = F.coalesce(F.col("gone") >= F.col("last_update"), F.lit(False)) & ~back
    anew = _latest(every.join(known.where(lost).select(F.col("id").alias("author_id")), "author_id", "left_semi"))
    simple = known.where(~lost).select("id", F.greatest("last_update", "came").alias("last_update"))
    return simple.unionByName(anew)


def refresh(s: Summaries, posts: Change, comments: Change, comments_after: DataFrame) -> Summaries:
    """The summaries after a batch of changes.

    ``posts``, ``comments``: the batch's old and new images, one per row and side.
    ``comments_after``: the comments after the batch, of which only rows of
    authors that lost their latest update are read.  Next summaries are written
    once and read by the statistics; the batch is folded into one row per
    touched key before it meets a summary.
    """
    told = stored(_signed(comments, COMMENT_COLUMNS), "comment-images")
    count = told.where("post_id IS NOT NULL").groupBy(F.col("post_id").alias("id")).agg(F.sum("sign").alias("d")).where("d <> 0")
    old, new = posts.old.select("id"), posts.new.select(*POST_COLUMNS)
    ids = stored(old.unionByName(new.select("id")).unionByName(count.select("id")).distinct(), "touched-posts")
    before = stored(s.posts.join(ids, "id", "left_semi"), "posts-before")
    # a post keeps its row unless it was deleted or has a new image
    images = new.unionByName(
        before.select(*POST_COLUMNS).join(new.select("id"), "id", "left_anti").join(old, "id", "left_anti")
    )
    numbers = before.select("id", "n_comments").join(count, "id", "full").select("id", (coalesce0("n_comments") + coalesce0("d")).alias("n_comments"))
    after = stored(images.join(numbers, "id", "left").withColumn("n_comments", coalesce0("n_comments")), "posts-after")
    signed = before.withColumn("sign", F.lit(-1).cast("bigint")).unionByName(after.withColumn("sign", F.lit(1).cast("bigint")))
    signed = stored(signed, "post-shares")
    next_posts = s.posts.join(ids, "id", "left_anti").unionByName(after)
    return Summaries(
        next_posts,
        _added(s.authors, _author_shares(signed), AUTHOR_SUMS, _latest_of_touched(s.authors, signed, next_posts)),
        _added(s.commenters, _commenter_shares(told), COMMENTER_SUMS, _latest_of_touched(s.commenters, told, comments_after)),
        _added(s.categories, _category_shares(signed), CATEGORY_SUMS),
    ).stored()


def images(before: DataFrame, after: DataFrame, ids: DataFrame) -> Change:
    """Old and new images of the rows with the given ids."""
    return Change(before.join(ids.select("id").distinct(), "id", "left_semi"), after.join(ids.select("id").distinct(), "id", "left_semi"))


# ---------------------------------------------------------------- reading


def author_stats(s: Summaries, users: DataFrame) -> DataFrame:
    """A4 for every user, from the summaries."""
    out = users.select("id").join(s.authors, "id", "left")
    names = {"n": "total_posts", "views": "total_views", "likes": "total_likes", "comments": "total_comments"}
    return out.select(F.col("id").alias("author_id"), *[coalesce0(c).alias(names.get(c, c)) for c in AUTHOR_SUMS])


def comment_stats_by_author(s: Summaries, users: DataFrame) -> DataFrame:
    """A7 for every user, from the summaries."""
    out = users.select("id").join(s.commenters, "id", "left")
    return out.select(
        F.col("id").alias("author_id"), coalesce0("n").alias("total_comments"), coalesce0("replies").alias("total_replies"),
        coalesce0("likes").alias("total_likes_received"),
        F.coalesce(round_ratio_half_up("likes", "n_likes", 2), F.lit(0.0)).alias("average_likes_per_comment"),
    )


def category_stats(s: Summaries, categories: DataFrame, semantics: str = "true") -> DataFrame:
    """A10-A13 before the cut: categories.* with posts, views, comments, likes."""
    views, likes = ("views", "likes") if semantics == "true" else ("views_literal", "likes_literal")
    own = s.categories.select("id", F.col("n").alias("__n"), *[F.col(c).alias(f"__{c}") for c in ("comments", views, likes)])
    return categories.join(own, "id", "left").select(
        *[F.col(f"`{c}`") for c in categories.columns], coalesce0("__n").alias("posts"), coalesce0(f"__{views}").alias("views"),
        coalesce0("__comments").alias("comments"), coalesce0(f"__{likes}").alias("likes"),
    )


def user_engagement(s: Summaries, users: DataFrame, as_of) -> DataFrame:
    """A14 and A15 for every user, from the summaries."""
    a = s.authors.select("id", F.col("n").alias("p_n"), F.col("likes").alias("p_likes"), F.col("views").alias("p_views"), F.col("last_update").alias("p_last"))
    c = s.commenters.select("id", F.col("n").alias("c_n"), F.col("likes").alias("c_likes"), F.col("last_update").alias("c_last"))
    now, epoch = as_of_literal(as_of), F.to_timestamp_ntz(F.lit(EPOCH))
    last = F.greatest(F.coalesce("p_last", epoch), F.coalesce("c_last", epoch), F.col("created_at"))
    return users.select("id", "created_at").join(a, "id", "left").join(c, "id", "left").select(
        F.col("id").alias("user_id"), coalesce0("p_n").alias("total_posts"), coalesce0("c_n").alias("total_comments"),
        coalesce0("c_likes").alias("total_likes_given"), coalesce0("p_likes").alias("total_likes_received"),
        coalesce0("p_views").alias("total_views_received"),
        elapsed_days("created_at", now).alias("days_since_join"), elapsed_days(last, now).alias("days_since_last_activity"),
    )
